"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their byte length, then by successive digits of their UTF-8 bytes. A digit is a run of bytes
whose width grows from level to level, so a text of n bytes ends after O(log n) levels. A group that is down to one
document, or whose texts have ended, leaves the recursion; only the rest of the bytes of the documents that are still
in company goes on. Equality is decided by the bytes alone.

Each level is one aggregation by (group, digit), which combines on the map side, and one join of the rows with the
groups of two and more, broadcast while these are few and their digits take few bytes, and hash-joined otherwise. No task
holds a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fitted

#: Bytes of the first digit; each next digit is WIDEN times as wide.
FIRST_DIGIT, WIDEN = 64, 32
#: What a column can hold, and a position in it can be.
WIDEST = 2**31 - 1


def _groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups of two rows and more: size n, the id that stays, and mark, which tells groups with the same such id apart."""
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where("n > 1")
    return found.withColumn("mark", F.row_number().over(Window.partitionBy("keep").orderBy(*by)))


def exact_dedup(docs: DataFrame, first_digit: int = FIRST_DIGIT, widen: int = WIDEN) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs needs doc_id (any ordered type) and text; other columns are ignored. A null text counts as empty, and empty
    texts are equal. Of equal texts the largest doc_id stays; a null doc_id is smaller than any other, and a group of
    nulls only keeps them all, as do rows that share both text and the largest doc_id. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    text = F.coalesce(F.col("text"), F.lit(""))
    active = docs.select(
        "doc_id",
        F.sha2(text, 256).alias("sha"),
        F.octet_length(text).alias("size"),
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("grp"),
        F.lit(0).alias("twin"),
        text.cast("binary").alias("rest"),
    )
    by, at, width, done = ["grp", "twin", "size", "digit"], 0, first_digit, []
    while True:
        rows = active.withColumn("digit", F.substring("rest", 1, width))
        groups = scratch.keep(_groups(rows, by))
        g = fitted(groups).alias("g")
        at += width
        goes_on = F.col("g.n").isNotNull() & (rows["size"] > at)
        level = scratch.keep(
            rows.join(g, [rows[c].eqNullSafe(F.col(f"g.{c}")) for c in by], "left").select(
                rows["doc_id"],
                rows["sha"],
                rows["size"],
                F.coalesce("g.n", F.lit(1)).cast("long").alias("n"),
                F.when(F.col("g.n").isNull(), rows["doc_id"]).otherwise(F.col("g.keep")).alias("grp"),
                F.coalesce("g.mark", F.lit(0)).alias("twin"),
                F.when(goes_on, F.substring(rows["rest"], width + 1, WIDEST)).alias("rest"),
            )
        )
        done.append(level.where("rest is null"))
        active = level.where("rest is not null")
        if not active.limit(1).count():
            break
        width = min(width * widen, WIDEST)
    return reduce(DataFrame.unionByName, done).select(
        "doc_id",
        F.col("grp").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("grp")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
