"""Ranks, tops and latest rows (W)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cap_per_document(hits: DataFrame, most: int, by: Sequence[str] = ("query_id", "id")) -> DataFrame:
    """The best most chunks of each document (Catalyst cuts each group before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank_in_doc", F.row_number().over(w)).where(F.col("rank_in_doc") <= most)


def top_documents(hits: DataFrame, n: int) -> DataFrame:
    """Hits of the n documents with the best chunks, for each query."""
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("best"))
    w = Window.partitionBy("query_id").orderBy(F.desc("best"), "id")
    best = best.withColumn("doc_rank", F.row_number().over(w)).where(F.col("doc_rank") <= n)
    return hits.join(best, ["query_id", "id"])


def collapse_summaries(hits: DataFrame) -> DataFrame:
    """Of a document's summary chunks only the best; others as they are."""
    w = Window.partitionBy("id", F.col("family") == "summary").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("__r", F.row_number().over(w)).where("family <> 'summary' or __r = 1").drop("__r")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return one.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def global_rank(hits: DataFrame, n: int) -> DataFrame:
    """The n best chunks of each query with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def order_results(docs: DataFrame, n: int) -> DataFrame:
    """W6."""
    return docs.orderBy(F.desc("score"), "id").limit(n)


def sample_candidates(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """N rows in an order that key and seed fix."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
