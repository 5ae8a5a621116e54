"""Tables of a knowledge base as DataFrames, and the sources and syncs that fill them (S)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_hash, sanitize
from ..operators.dedup import merge_batch
from .html_pages import read_page

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names: Sequence[str] = NAMES) -> dict[str, DataFrame]:
    """The named tables, unread until used."""
    return {n: read_table(spark, folder, n) for n in names}


def as_documents(docs: DataFrame) -> DataFrame:
    """The documents table in the document model: source_id, parser_id (from lang), doc_type, metadata as JSON text."""
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("-", F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("parser_id"),
        F.when(F.col("n_chars") < 200, "table").when(F.col("n_chars") < 800, "section").otherwise("text").alias("doc_type"),
        "text",
        "n_chars",
        F.to_json(F.struct(F.col("lang").alias("lang"), F.col("n_chars").cast("string").alias("n_chars"))).alias("meta"),
    )


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out evenly if it is read in fewer parts than there are cores; larger ones stay as they are.

    A small file of one row group is read by one task, whose heavy expressions would leave the other cores idle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def as_chunks(docs: DataFrame) -> DataFrame:
    """Each line of a document as a chunk (chunk_id, id, chunk_index, text)."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    return lines.where("length(text) > 0").withColumn("chunk_id", F.col("id") * 1_000_000 + F.col("chunk_index"))


def directory_source(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below path as (file_path, doc_id, folder, file_size, modified); doc_id joins the relative path with '--'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")
    root = path.rstrip("/")
    relative = F.element_at(F.split("path", root.rsplit(":", 1)[-1].replace(".", r"\.") + "/", 2), 2)
    parts = F.split(relative, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return files.select(F.col("path").alias("file_path"), F.concat_ws("--", folders, stem).alias("doc_id"), F.array_join(folders, "/").alias("folder"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def parse_source_time(c: Column, zone: str = "UTC") -> Column:
    """The earliest instant of ISO times with zone, dates, months and years; local times are of zone; else null."""
    whole = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))
    local = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM", "yyyy")])
    return F.coalesce(whole, F.to_utc_timestamp(local, zone))


def changed_items(listing: DataFrame, raw: DataFrame) -> DataFrame:
    """Items of listing (entry, listed) that are new, or newer than the newest stored revision (entry, revised)."""
    newest = raw.groupBy("entry").agg(F.max("revised").alias("newest"))
    return listing.join(newest, "entry", "left").where("newest is null or listed > newest")


def import_run_summary(items: DataFrame, failures: int = 5) -> DataFrame:
    """Items (run, item, status) counted by run, with its first failures by item."""
    status = F.col("status")
    failed = F.slice(F.array_sort(F.collect_list(F.when(status == "failed", F.col("item")))), 1, failures)
    return items.groupBy("run").agg(F.count(F.lit(1)).alias("found"), *[F.count_if(status == s).alias(s) for s in ("processed", "skipped", "failed")], failed.alias("first_failures"))


def export_by_class(raw: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each raw document with its text and folder; the newest label (seq) wins, unlabelled ones need review."""
    newest = labels.groupBy("raw_id").agg(F.max_by("label", "seq").alias("label"))
    folder = F.when(F.col("label") == "public", "public").when(F.col("label") == "private", "private").otherwise("needs-review")
    return raw.join(docs, "raw_id", "left").join(newest, "raw_id", "left").withColumn("privacy_class", folder)


def sync_missing(src: DataFrame, dst: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of src whose key isn't in dst; nothing is updated."""
    return src.join(dst.select(*key), list(key), "left_anti")


def verify_sync(tables: dict[str, tuple[DataFrame, DataFrame]], links: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows of each table on both sides, and of each link the rows whose key has no parent."""
    out = None
    for name, (a, b) in tables.items():
        row = a.agg(F.count(F.lit(1)).alias("src_rows")).crossJoin(b.agg(F.count(F.lit(1)).alias("dst_rows"))).select(F.lit(name).alias("name"), "src_rows", "dst_rows", F.lit(None).cast("long").alias("orphans"))
        out = row if out is None else out.unionByName(row)
    for name, (child, c, parent, p) in links.items():
        lost = child.where(F.col(c).isNotNull()).join(parent.select(F.col(p).alias(c)).distinct(), c, "left_anti")
        row = lost.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("name"), F.lit(None).cast("long").alias("src_rows"), F.lit(None).cast("long").alias("dst_rows"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def replace_plan(src: DataFrame, dst: DataFrame, dependents: DataFrame, key: str) -> DataFrame:
    """Rows to insert and delete to make dst equal to src; a row that dependents name stays and is marked blocked."""
    insert = src.exceptAll(dst).withColumn("action", F.lit("insert"))
    delete = dst.exceptAll(src).join(dependents.select(key).distinct().withColumn("used", F.lit(True)), key, "left")
    delete = delete.withColumn("action", F.when(F.col("used"), "blocked").otherwise("delete")).drop("used")
    return insert.unionByName(delete)


def ingest_parsed(docs: DataFrame, existing: DataFrame, level: int = 3) -> DataFrame:
    """Documents as they are to be stored: sanitised, hashed, and merged with existing ones and each other by dedup level.

    docs and existing have id, source_id, doc_id, parser_id, title, text, meta (JSON text). NULs go from title, text and all
    of meta; the content hash is that of the text, null for none. No row of docs is lost: each comes back with target_id,
    action, stored_hash, stored_parser and latest, as merge_batch says; those with latest are what the store holds in the
    end. A batch of one row is a single ingest.
    """
    clean = docs.withColumns({c: sanitize(F.col(c)) for c in ("title", "text")})
    clean = clean.withColumn("meta", F.regexp_replace(sanitize(F.col("meta")), r"\\u0000", "")).withColumn("content_hash", content_hash(F.col("text")))
    known = existing if "content_hash" in existing.columns else existing.withColumn("content_hash", content_hash(F.col("text")))
    return clean.join(merge_batch(clean, known, level), "id")


def page_source(pages: DataFrame, markdown: bool = True) -> DataFrame:
    """S3: HTML pages (url, html) as documents: doc_id, title, text, links.

    All text is kept, that of header, navigation and footer too; scripts, styles, templates, ruby notes, comments and
    the wiki's edit marks go, and entities become their letters. text is Markdown, with # for headings and - for list
    items; or, without markdown, the page's strings as they follow each other, a line for each stretch between line
    breaks and double spaces. links are addresses as they stand, without what follows #. A null page has null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [(None, None, None) if h is None else read_page(h, markdown) for h in b.column("html").to_pylist()]
            columns = zip(*read, strict=True) if read else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
            made = {n: pa.array(c, k) for n, c, k in zip(("title", "text", "links"), columns, kinds, strict=True)}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("url")} | made)

    return spread(pages).select("url", "html").mapInArrow(run, "doc_id string, title string, text string, links array<string>")


def export_comparisons(comparisons: DataFrame) -> DataFrame:
    """For each source one Markdown text with a section for each compared document, by doc_id: (source_id, doc_id, title, body)."""
    section = F.concat(F.lit("## "), F.col("doc_id"), F.when(F.col("title") != "", F.concat(F.lit(": "), F.col("title"))).otherwise(""), F.lit("\n\n"), F.col("body"))
    rows = comparisons.where("body <> ''").select("source_id", F.struct("doc_id", section.alias("md")).alias("s"))
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["md"]), "\n\n").alias("text"))
