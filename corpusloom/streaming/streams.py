"""Streaming forms of the incremental jobs (T), on Structured Streaming with event time and watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.scalars import content_hash
from ..operators.lineage import shared_folder
from ..operators.ranking import latest_by

#: Folders that the state of merge_latest is dealt out to by key.
STATE_BUCKETS = 64
#: Rows of a file of a replayed table, and bytes of its values; a part gets as many files as either asks for.
FILE_ROWS, FILE_BYTES = 25_000, 128_000_000


def read_stream(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    """The files of a table as a stream, so many at a time; ts becomes a timestamp with zone."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def dedup_ingest(docs: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The first of rows with equal content within the watermark."""
    return docs.withColumn("content_hash", content_hash(F.col("text"))).withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls of each tool and day."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("day"), "event_type", "calls")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Calls of a user with no longer gap between them."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("calls")).select("user_id", F.col("session_window.start").alias("first_call"), F.col("session_window.end").alias("until"), "calls")


def latency(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sliding median and 95th percentile of each tool, exact: the state of a window counts its different values."""
    w = F.window("ts", "1 hour", "10 minutes")
    p = F.expr("percentile_disc(array(0.5, 0.95)) WITHIN GROUP (ORDER BY value)")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(p.alias("p")).select(F.col("window.start").alias("begin"), "event_type", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"))


def merge_latest(path: str, keys: list[str], seq: str, buckets: int = STATE_BUCKETS) -> Callable[[DataFrame, int], None]:
    """T4: a foreachBatch sink that keeps the row with the highest seq of each key, in buckets below path.

    A batch reads and writes the buckets of its own keys only, into a folder of its own; then it writes the pointer
    (bucket, version), which says for each bucket which batch wrote it last. Nothing that an earlier pointer names is
    touched, so a batch that is run again, or dies half-way, changes nothing but its own folder. Batches count from 0,
    each on the pointer of the one before it. Rows equal in key and seq are one by any of them.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest_by(batch, keys, [seq])
        touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # buckets at most
        known = {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/pointer/{n - 1}").collect()} if n else {}
        old = [f"{path}/data/{known[b]}/bucket={b}" for b in touched if b in known]
        if old:
            new = latest_by(spark.read.schema(new.schema).parquet(*old).unionByName(new), keys, [seq])
        if touched:
            new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{n}")
        rows = sorted((known | dict.fromkeys(touched, n)).items())
        spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer/{n}")

    return merge


def read_latest(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    """T4: the rows that merge_latest holds after batch n; None before any row has come."""
    known = spark.read.parquet(f"{path}/pointer/{n}").collect()
    folders = [f"{path}/data/{r['version']}/bucket={r['bucket']}" for r in known]
    return spark.read.parquet(*folders) if folders else None


def run_to_table(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Run a stream over what is there now into a new table below the shared folder, and return it."""
    path = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def replayed(rows: DataFrame, part: Column, parts: int, name: str = "arrivals") -> DataFrame:
    """A table as a stream that arrives in parts, one a batch, in order of part (from 0): rows with the same part come together.

    Each part is as many files as the largest one needs at FILE_ROWS and FILE_BYTES a file, so that a batch, which takes up so many files,
    is read and written by as many tasks, however long the texts are; files without rows make up the number.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    held = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in rows.dtypes), F.lit(0).cast("long"))
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(held).alias("b")).where(F.col("part").isin(*range(parts)))
    most = sizes.agg(F.max("n"), F.max("b")).first()
    files = max(-(-(x or 1) // y) for x, y in zip(most, (FILE_ROWS, FILE_BYTES), strict=True))
    for i in range(parts):
        rows.where(part == i).repartition(files).write.mode("append").parquet(path)
        for _ in range((i + 1) * files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(path)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there now into a table in memory."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def chunk_stream(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """T5: new documents chunked as they land; each batch has a folder of its own, so a repeated batch replaces itself."""
    write = lambda b, n: chunker(b).write.mode("overwrite").parquet(f"{out}/batch={n}")
    q = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stuck_holds(decisions: DataFrame, hours: int = 24) -> DataFrame:
    """An alert (raw_id, since) for each document that is held and gets no other decision for so many hours of event time.

    decisions has raw_id, state and ts. The state of a document is the time of its hold; a later decision ends it, and
    the watermark's timer raises the alert once.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({"raw_id": [key[0]], "since": [pd.Timestamp(since, unit="us")]})
            return
        last = max((r for b in batches for r in zip(b["ts"], b["state"], strict=True)), default=None)
        if last is None:
            return
        at = last[0].value // 1000
        if state.exists and state.get[0] > at:
            return
        if last[1] != "held":
            if state.exists:
                state.remove()
            return
        state.update((at,))
        due = at // 1000 + hours * 3_600_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return decisions.withWatermark("ts", "1 hour").groupBy("raw_id").applyInPandasWithState(watch, "raw_id long, since timestamp", "since long", "append", "EventTimeTimeout")
