"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Quality selection, line deduplication, near-duplicate removal, mixing to target weights, packing. Stages 1 to 4 return
the columns of documents; the last returns a row per piece of a packed sequence. Each stage takes nulls in any column,
repeated rows, an empty table, extra columns and texts of any length as its operator's docstring says; missing labels
refuse no document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import Scratch
from corpusloom.llm.line_dedup import MIN_EQUAL, line_dedup
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.ngram_join import one_of_each
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import quality_filter
from corpusloom.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones refuses go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand, equal or from 12 characters on within two edits, earlier in the corpus go; documents that lose all they have go too."""
    return line_dedup(docs, min_equal=MIN_EQUAL)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row of the document with the smallest id stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets take them, in training order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2,048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the quality models, the edit join and the packing; tests hold near duplicates against brute force,
#: the others against labels, known answers and each other's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
