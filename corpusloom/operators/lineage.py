"""Tables that cut lineage, and components of a graph, for operators that work in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """spark.checkpoint.dir, which all executors see; a temporary folder only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet below the shared folder and read back; a lost executor costs its own tasks only."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, for the nodes of edges (a, b).

    Edges that stand alone are done at once. The others hand on the smallest label seen, to their neighbours and to the
    node that is their label, until nothing changes; each round combines before its shuffle.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    alone = both.groupBy("a").agg((F.count(F.lit(1)) == 1).alias("alone"))
    marked = cut(both.join(alone, "a").join(alone.select(F.col("a").alias("b"), F.col("alone").alias("b_alone")), "b"))
    single = marked.where("alone and b_alone").select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    both = marked.where("not (alone and b_alone)").select("a", "b")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("root"))
        step = cut(step.join(jump, "via").select("node", "old", F.least("via", "root").alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return single.union(labels)
