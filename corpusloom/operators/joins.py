"""Backlogs, lookups and cascades as joins (J)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(embeddings: DataFrame, chunks: DataFrame, docs: DataFrame, where: Column) -> DataFrame:
    """Embeddings with their chunk and document under a filter."""
    return embeddings.join(chunks, "chunk_id").join(docs.where(where), "id")


def backlog(items: DataFrame, done: DataFrame, key: str | Sequence[str], accepted: Column | None = None) -> DataFrame:
    """Items without a row in done (of those that are accepted)."""
    done = done if accepted is None else done.where(accepted)
    keys = [key] if isinstance(key, str) else list(key)
    return items.join(done.select(*keys), keys, "left_anti")


def backlog_records(docs: DataFrame, chunks: DataFrame, doc_type: str) -> DataFrame:
    """Image or table records (id, doc_type, text, meta as JSON) with text and without any chunk.

    Decorative images, those whose meta has a boilerplate that isn't null, keep their record but are never due.
    """
    due = docs.where((F.col("doc_type") == doc_type) & (F.col("text") != ""))
    if doc_type == "image":
        due = due.where(F.get_json_object("meta", "$.boilerplate").isNull())
    return due.join(chunks.select("id"), "id", "left_anti")


def backlog_unsummarised(docs: DataFrame, types: Sequence[str], parser: str | None = None) -> DataFrame:
    """Documents of the types with text and no summary (null or empty), of one parser if it is given; images never, as their text describes them."""
    due = docs.where(F.col("doc_type").isin(list(types)) & (F.col("doc_type") != "image") & (F.col("text") != "") & (F.coalesce("summary", F.lit("")) == ""))
    return due if parser is None else due.where(F.col("parser_id") == parser)


def resolved_parser(source_type: Column, parser: str | None, layout_types: Sequence[str], layout: str = "layout", auto: Sequence[str | None] = (None, "", "auto")) -> Column:
    """The parser that a file of a type goes to: parser itself, or where it is one of auto the layout parser for layout_types, else parser as it stands."""
    own = F.lit(parser).cast("string")
    return F.when(source_type.isin(list(layout_types)), layout).otherwise(own) if parser in auto else own


def backlog_unparsed(
    raw: DataFrame, docs: DataFrame, parser: Column, doc_ids: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int | None = None, again: bool = False
) -> DataFrame:
    """Raw files (raw_id, doc_id, source_type, file_size) without a document (raw_id, parser_id) by the parser that their type goes to.

    parser is an expression over raw, such as resolved_parser; where it is null no document counts. doc_ids keeps those
    only, exclude leaves some out, max_bytes leaves out larger files and those of unknown size; again takes files that
    have been parsed too.
    """
    due = raw.where(F.col("doc_id").isin(list(doc_ids))) if doc_ids else raw
    due = due.where(~F.col("doc_id").isin(list(exclude))) if exclude else due
    due = due if max_bytes is None else due.where(F.col("file_size") <= max_bytes)
    if again:
        return due
    done = docs.select("raw_id", F.col("parser_id").alias("__parser"))
    return due.withColumn("__parser", parser).join(done, ["raw_id", "__parser"], "left_anti").drop("__parser")


def scan_candidates(docs: DataFrame, scans: DataFrame, version: str, most_chars: int) -> DataFrame:
    """Counts of documents to scan under a prompt version, done already, and too large."""
    done = scans.where(F.col("version") == version).select("id").distinct().withColumn("__done", F.lit(True))
    seen = docs.join(done, "id", "left").select(F.coalesce("__done", F.lit(False)).alias("d"), (F.length("text") > most_chars).alias("big"))
    return seen.agg(F.count_if(~F.col("d") & ~F.col("big")).alias("to_scan"), F.count_if("d").alias("skipped"), F.count_if(~F.col("d") & F.col("big")).alias("too_large"))


def audited_results(results: DataFrame, audits: DataFrame, kind: str) -> DataFrame:
    """Results whose question has a valid audit of the kind."""
    return results.join(audits.where((F.col("audit_type") == kind) & F.col("is_valid")).select("question_id"), "question_id", "left_semi")


def usable_questions(questions: DataFrame, audits: DataFrame) -> DataFrame:
    """Questions whose latest human verdict is valid, or without one those with a valid audit and no invalid one."""
    human = F.col("audit_type") == "human"
    verdict = audits.groupBy("question_id").agg(
        F.max_by(F.when(human, F.col("is_valid")), F.when(human, F.col("created_time"))).alias("human"),
        F.bool_or("is_valid").alias("some"),
        F.bool_and("is_valid").alias("every"),
    )
    return questions.join(verdict.where(F.coalesce("human", F.col("some") & F.col("every"))).select("question_id"), "question_id", "left_semi")


def attach_parent(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with title and summary of their parent."""
    parent = docs.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"), F.col("summary").alias("parent_summary"))
    return hits.join(parent, "parent_id", "left")


def neighbours(items: DataFrame, window: int) -> DataFrame:
    """For each item (document_id, pos) those up to window places before and after, with their distance."""
    near = items.select("document_id", F.col("pos").alias("near"), F.col("cref").alias("near_cref"))
    far = F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("distance")
    steps = items.select("document_id", "pos", far).where("distance <> 0").withColumn("near", F.col("pos") + F.col("distance"))
    return steps.join(near, ["document_id", "near"]).select("document_id", "pos", "distance", "near_cref")


def verify_citations(cites: DataFrame, docs: DataFrame) -> DataFrame:
    """Cites (cite_id, number, reference) with whether an entry of that number exists, and its age.

    docs has doc_id; an entry n has the documents n, and n followed by a dash, a slash or an underscore. Numbers grow
    with time, so a number over that which reference begins with is newer; age is null if reference has no number.
    """
    lead = lambda c: F.regexp_extract(c, r"^(\d+)(?:[-/_]|$)", 1)
    known = docs.select(lead(F.col("doc_id")).alias("entry")).where("entry <> ''").distinct().withColumn("exists", F.lit(True))
    out = cites.join(known, F.col("number").cast("string") == F.col("entry"), "left")
    mine = lead(F.col("reference")).try_cast("long")
    age = F.when(F.col("number") > mine, "newer").when(F.col("number") < mine, "older").when(F.col("number") == mine, "same")
    return out.select("cite_id", "number", F.coalesce("exists", F.lit(False)).alias("exists"), age.alias("age"))


def runs_with_privacy(runs: DataFrame, privacy: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Import runs with the counters of their privacy runs, by log path."""
    sums = privacy.groupBy("log_path").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds])
    return runs.join(sums, "log_path", "left").fillna(0, list(kinds))


def paired_results(results: DataFrame, runs: Sequence[object] | None = None) -> DataFrame:
    """Results of questions that every run answered."""
    results = results if runs is None else results.where(F.col("run_id").isin(list(runs)))
    n = results.agg(F.count_distinct("run_id").alias("n"))
    common = results.groupBy("question_id").agg(F.count_distinct("run_id").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n"))
    return results.join(common.select("question_id"), "question_id", "left_semi")


def parser_pairs(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Token counts of the same source document by two parsers."""
    side = lambda p, c: docs.where(F.col("parser_id") == p).select("raw_id", F.col("tokens").alias(c))
    return side(a, "tokens_a").join(side(b, "tokens_b"), "raw_id")


def repairable_dates(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents without a date whose raw row has one."""
    return docs.where("doc_time is null").join(raw.where("stored_time is not null"), "raw_id").select("id", F.col("stored_time").alias("doc_time"))


def split_known_images(images: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with the description of their hash, and one row per hash that the registry lacks."""
    known = images.join(registry.select("hash", "description"), "hash", "left")
    return known, images.join(registry.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("copies"))


def drop_cascade(tables: Mapping[str, DataFrame], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows whose key is in gone, and how many each lost."""
    kept, counts = {}, None
    gone = gone.select(key).distinct()
    for name, df in tables.items():
        kept[name] = df.join(gone, key, "left_anti")
        row = df.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("name"), "removed")
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts
