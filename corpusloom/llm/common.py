"""Shared pieces of the training-data operators: scratch tables, size-checked joins, components.

Scratch tables stand in for ``checkpoint()``: they cut lineage with Parquet files in the folder the cluster names in
``spark.checkpoint.dir``, which every executor can read, so a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; it is counted first, and a shuffle join follows beyond it.
BROADCAST_ROWS = 200_000
#: Bytes of a side's columns up to which it is broadcast, however few its rows are.
BROADCAST_BYTES = 64 << 20

#: What separates words in the contracts on words.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one operator call below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}  # by id of the table, which is held so that its id stays taken

    def keep(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """Write df and return it read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path, back
        return back

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files behind kept tables now, not when the driver happens to collect."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            if found := self.paths.pop(id(t), None):
                p = jvm.org.apache.hadoop.fs.Path(found[0])
                p.getFileSystem(conf).delete(p, True)


def _bytes_of_row(df: DataFrame) -> Column:
    """About the bytes of a row: 8 for each column, and what strings, binaries and arrays hold."""
    held = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: 8 * F.size(c)}
    parts = [F.coalesce(held[f.dataType.typeName()](F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in held]
    return sum(parts, F.lit(8 * len(df.columns)))


def fitted(small: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if it has at most limit rows and most_bytes bytes, else with a hash-join hint.

    Rows are counted up to limit only. A hash join leaves a side with a hot key to AQE, which splits it.
    """
    seen = small.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(_bytes_of_row(small).cast("long")).alias("bytes")).first()
    few = seen["n"] <= limit and (seen["bytes"] or 0) <= most_bytes
    return F.broadcast(small) if few else small.hint("shuffle_hash")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): a row (node, label) per node, label its component's smallest node.

    Min-label propagation with pointer jumping. Each round is two hash joins and an aggregation that combines on the
    map side; nothing is collected but a count of changes.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        seen = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("root"))
        step = scratch.keep(step.join(jump, "via").select("node", "old", F.least("via", "root").alias("label")))
        scratch.drop(labels)
        labels = step
        if not step.where("label <> old").limit(1).count():
            scratch.drop(both)
            return labels.select("node", "label")


def numbered(rows: DataFrame, group: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """rows with pos, the place of a row (from 0) in the order of its group, and size, the rows of the group.

    rows is a kept table, and group a column without nulls. Rows are dealt out by ranges of (group, order), so neither a
    hot group nor a value that very many rows share is one task; rows that are alike in all of these are numbered as
    they stand in the table. Only counts for each range and group are summed up by window.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(group).asc(), *order, F.col("__as_read").asc()]
    laid = rows.withColumn("__as_read", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    laid = scratch.keep(laid.drop("__as_read").withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = laid.groupBy(group, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.keep(counts.select(group, "__range", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("size")))
    placed = laid.join(fitted(starts), [group, "__range"])
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__range", "__at", "__shift")


def beside_ids(batch: pa.RecordBatch, columns: dict[str, pa.Array], rows: list[int] | None = None, carried: tuple[str, ...] = ("doc_id",)) -> pa.RecordBatch:
    """columns beside the carried ones of batch, taken at rows if they are given; ids stay Arrow, so nulls cost them no digit."""
    at = None if rows is None else pa.array(rows, pa.int64())
    kept = {c: batch.column(c) if at is None else batch.column(c).take(at) for c in carried}
    return pa.RecordBatch.from_pydict(kept | columns)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
