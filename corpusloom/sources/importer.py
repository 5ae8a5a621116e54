"""Importers: what a source must offer, and one run over it."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import changed_items, directory_source, import_run_summary, page_source


class Importer(Protocol):
    """A source of items. listing() has a row per item (entry, listed); fetch() takes rows of a listing and gives a row
    for each: entry, the columns of a document, and error, null where the item could be had.
    """

    source_id: str

    def listing(self, spark: SparkSession) -> DataFrame: ...

    def fetch(self, items: DataFrame) -> DataFrame: ...


class FolderImporter:
    """Text files below a folder; a file of white space alone is an error, one of no bytes isn't listed, as Spark's file sources pass over it."""

    def __init__(self, source_id: str, path: str, glob: str = "*.txt") -> None:
        self.source_id, self.path, self.glob = source_id, path, glob

    def listing(self, spark: SparkSession) -> DataFrame:
        return directory_source(spark, self.path, self.glob).select(F.col("doc_id").alias("entry"), F.col("modified").alias("listed"), "file_path")

    def fetch(self, items: DataFrame) -> DataFrame:
        files = items.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", self.glob).load(self.path)
        text = F.decode("content", "UTF-8")
        rows = items.join(files.select(F.col("path").alias("file_path"), text.alias("text")), "file_path")
        return rows.select("entry", F.lit(None).cast("string").alias("title"), "text", F.when(~F.col("text").rlike(r"\S"), "empty").alias("error"))


class PageImporter:
    """A table of HTML pages (page_id, url, html, listed); a page without a title is an error."""

    def __init__(self, source_id: str, pages: DataFrame) -> None:
        self.source_id, self.pages = source_id, pages

    def listing(self, spark: SparkSession) -> DataFrame:
        return self.pages.select(F.col("url").alias("entry"), "listed")

    def fetch(self, items: DataFrame) -> DataFrame:
        pages = self.pages.join(items.select(F.col("entry").alias("url")), "url", "left_semi")
        return page_source(pages).select(F.col("doc_id").alias("entry"), "title", "text", F.when(F.coalesce("title", F.lit("")) == "", "no title").alias("error"))


def run_import(importer: Importer, spark: SparkSession, raw: DataFrame, failures: int = 5) -> tuple[DataFrame, DataFrame]:
    """One run: items that are new or newer than in raw (entry, revised) are fetched.

    Returns the documents (source_id, entry, title, text) and the run's summary (S6): found, processed, skipped, failed and
    the first failures. An item that fetch() gives no row for has failed. Each listed row is an item; those with one entry share its state.
    """
    listing = importer.listing(spark)
    wanted = changed_items(listing, raw)
    got = importer.fetch(wanted)
    # one row for each entry, so that an entry that is listed or fetched several times doesn't multiply
    state = got.groupBy("entry").agg(F.bool_and(F.col("error").isNull()).alias("ok"))
    asked = wanted.groupBy("entry").agg(F.lit(True).alias("wanted"))
    items = listing.select("entry").join(asked, "entry", "left").join(state, "entry", "left")
    status = F.when(F.col("wanted").isNull(), "skipped").when(F.col("ok"), "processed").otherwise("failed")
    summary = import_run_summary(items.select(F.lit(importer.source_id).alias("run"), F.col("entry").alias("item"), status.alias("status")), failures)
    return got.where("error is null").select(F.lit(importer.source_id).alias("source_id"), "entry", "title", "text"), summary
