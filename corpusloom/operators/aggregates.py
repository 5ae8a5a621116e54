"""Corpus, usage and pipeline statistics (A)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Values of a group that are sorted at once, and intervals that the others are counted in.
AT_ONCE, BINS = 50_000, 4096


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Counts over all, by source and by (source, parser, type) in one pass."""
    return docs.groupingSets([[], ["source_id"], ["source_id", "parser_id", "doc_type"]], "source_id", "parser_id", "doc_type").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def summaries(docs: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Documents and chunks for each (source_id, doc_type), and the metadata keys; chunks name their document as id."""
    count = F.count(F.lit(1)).alias("n")
    kinds = docs.select("id", "source_id", "doc_type")
    per_doc = chunks.groupBy("id").agg(count)
    return {
        "document_counts": kinds.groupBy("source_id", "doc_type").agg(count),
        "chunk_counts": kinds.join(per_doc, "id").groupBy("source_id", "doc_type").agg(F.sum("n").alias("n")),
        "metadata_keys": metadata_keys(docs).select("key"),
    }


def refresh_summaries(docs: DataFrame, chunks: DataFrame, folder: str) -> None:
    """The summary tables anew, each as Parquet below folder; run it after an import."""
    for name, table in summaries(docs, chunks).items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def filter_options(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """A2: documents of each source, those without any included."""
    return sources.join(docs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n"))


def coverage_grid(chunks: DataFrame, embedded: DataFrame, strategies: DataFrame, names: DataFrame) -> DataFrame:
    """A3, A4: documents, chunks and embeddings for each strategy and embedding name, empty cells included."""
    made = chunks.groupBy("strategy").agg(F.count_distinct("id").alias("documents"), F.count(F.lit(1)).alias("chunks"))
    has = chunks.join(embedded, "chunk_id").groupBy("strategy", "embedding").agg(F.count(F.lit(1)).alias("embeddings"))
    grid = strategies.crossJoin(F.broadcast(names)).join(made, "strategy", "left").join(has, ["strategy", "embedding"], "left")
    return grid.na.fill(0, ["documents", "chunks", "embeddings"]).withColumn("missing", F.col("chunks") - F.col("embeddings"))


def metadata_keys(docs: DataFrame) -> DataFrame:
    """A5: distinct top-level keys of meta."""
    return docs.select(F.explode(F.json_object_keys("meta")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def length_stats(docs: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Number, sum, mean, deviation of the population, median, least and most."""
    v = docs.select(*by, value.cast("double").alias("v"))
    return v.groupBy(*by).agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev"), F.percentile("v", 0.5).alias("median"), F.min("v").alias("least"), F.max("v").alias("most"))


def token_usage(usage: DataFrame) -> DataFrame:
    """Calls and tokens by stage and model, by stage, and in all."""
    return usage.rollup("stage", "model").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in ("input", "output", "total", "cached")])


def silent_stages(usage: DataFrame) -> DataFrame:
    """Stages with calls of a model of which no token was ever reported, with those calls: their usage is undercounted."""
    rows = usage.groupBy("stage", "model").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return rows.where("total = 0").groupBy("stage").agg(F.sum("calls").alias("calls"))


def normalise_usage(usage: DataFrame) -> DataFrame:
    """A10: a missing total is input and output; cached is input at most; main is what isn't cached."""
    total = F.coalesce("total", F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0)))
    cached = F.least(F.coalesce("cached", F.lit(0)), F.coalesce("input", F.lit(0)))
    return usage.withColumn("total", total).withColumn("cached", cached).withColumn("main", F.coalesce("input", F.lit(0)) - cached)


def value_at(df: DataFrame, by: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by and, for each name, the value at a place (from 0) of the group's sorted values; places are expressions over n, their number.

    Groups of AT_ONCE values and less are sorted as they are. In larger ones the place is looked for by counts in BINS
    intervals between the least and the largest value left, again and again, until so few are left or all are equal: no
    task holds or sorts a group. Nulls are no values; a group without values has nulls, and a null is a group of its own.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    same = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in by]
    on = functools.reduce(lambda x, y: x & y, same, F.lit(True))
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places.items()]))
    targets = groups.select(*by, "n", "low", "high", wanted.alias("x")).select(*by, "n", "low", "high", "x.name", "x.place")
    large = (F.col("n") > AT_ONCE) & (F.col("low") < F.col("high"))
    searched = not groups.where(large).isEmpty()
    targets = cut(targets) if searched else targets
    while searched and not targets.where(large).isEmpty():
        left = rows.alias("r").join(targets.where(large).alias("t"), on & F.col("v").between(F.col("low"), F.col("high")))
        bin_ = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        keys = [F.col(f"t.`{c}`").alias(c) for c in by]
        counts = left.groupBy(*keys, "name", "place", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*by, "name").orderBy("bin")) - F.col("n")  # BINS rows at most
        counts = counts.withColumn("place", F.col("place") - upto).where((F.col("place") >= 0) & (F.col("place") < F.col("n")))
        targets = cut(counts.select(*by, "n", "low", "high", "name", "place").unionByName(targets.where(~large)))
    small = rows.alias("r").join(targets.alias("t"), on & F.col("v").between(F.col("low"), F.col("high")) & (F.col("low") < F.col("high")))
    sorted_ = F.sort_array(F.collect_list("v"))
    found = small.groupBy(*[F.col(f"t.`{c}`").alias(c) for c in by], "name", "place").agg(F.get(sorted_, F.first("place").cast("int")).alias("v"))
    found = found.select(*by, "name", "v").unionByName(targets.where("low = high").select(*by, "name", F.col("low").alias("v")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])


def indexed_percentile(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at place min(n - 1, floor(q * n)) of the sorted values of each group, for each name's share q."""
    return value_at(df, by, value, {name: F.least(F.col("n") - 1, F.floor(F.col("n") * q)) for name, q in shares.items()})


def interpolated_percentile(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at place q * (n - 1) of the sorted values of each group, between two places in proportion, for each name's share q."""
    at = {name: (F.col("n") - 1) * q for name, q in shares.items()}
    ends = value_at(df, by, value, {f"{name}_{end}": f(place) for name, place in at.items() for end, f in (("below", F.floor), ("above", F.ceil))})
    sizes = df.groupBy(*by).agg(F.count(value).alias("n"))
    rows = ends.alias("r").join(sizes.alias("t"), functools.reduce(lambda x, y: x & y, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in by], F.lit(True)))
    part = lambda name: at[name] - F.floor(at[name])
    between = lambda name: F.col(f"{name}_below") * (1 - part(name)) + F.col(f"{name}_above") * part(name)
    return rows.select(*[F.col(f"r.`{c}`").alias(c) for c in by], *[between(name).alias(name) for name in shares])


def tool_usage(calls: DataFrame, since: Column | None = None) -> DataFrame:
    """Calls, sessions, errors, median, p95 and last use of each tool."""
    calls = calls if since is None else calls.where(F.col("created_time") >= since)
    base = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("status") == "error").alias("errors"), F.max("created_time").alias("last_used"))
    return base.join(indexed_percentile(calls, ["tool"], "duration_ms", {"median_ms": 0.5, "p95_ms": 0.95}), "tool", "left")


def transport_usage(calls: DataFrame, since: Column | None = None) -> DataFrame:
    """Calls of each transport, unknown for none."""
    calls = calls if since is None else calls.where(F.col("created_time") >= since)
    name = F.when(F.coalesce("transport", F.lit("")) != "", F.col("transport")).otherwise("unknown")
    return calls.groupBy(name.alias("transport")).agg(F.count(F.lit(1)).alias("calls"))


def session_usage(calls: DataFrame) -> DataFrame:
    """First and last call of each session, calls, and calls of each tool as a map."""
    per = calls.groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.min("created_time").alias("a"), F.max("created_time").alias("b"))
    tools = F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n"))))
    return per.groupBy("session_id").agg(F.min("a").alias("first_call"), F.max("b").alias("last_call"), F.sum("n").alias("calls"), tools.alias("per_tool"))


def tool_usage_daily(calls: DataFrame, first: str, last: str, zone: str = "UTC") -> DataFrame:
    """Calls, sessions and errors of each day in a zone, days without any as zeros."""
    day = F.to_date(F.from_utc_timestamp(F.col("created_time").cast("timestamp"), zone))
    used = calls.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("status") == "error").alias("errors"))
    days = calls.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.join(used, "day", "left").fillna(0)


def stage_stats(logs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Spread of a stage's times and its share of the whole."""
    v = F.col(value)
    out = logs.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stdev"), F.min(v).alias("least"), F.max(v).alias("most"))
    shares = interpolated_percentile(logs, by, value, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    on = functools.reduce(lambda x, y: x & y, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in by], F.lit(True))
    out = out.alias("r").join(shares.alias("t"), on, "left").select("r.*", "median", "p10", "p90")
    whole = out.agg(F.sum("total").alias("__all"))
    columns = [*by, "n", "total", "mean", "median", "stdev", "least", "p10", "p90", "most"]
    return out.crossJoin(F.broadcast(whole)).select(*columns, (F.col("total") / F.col("__all")).alias("share"))


def image_registry(images: DataFrame) -> DataFrame:
    """Copies, documents, entries and bytes of each image hash, and its first usable description.

    images has hash, image_id, doc_id, document_id, bytes, description. An entry is the number that a doc_id begins with; bytes are those of
    the first copy by image_id.
    """
    usable = F.length(F.coalesce("description", F.lit(""))) > 0
    entry = F.regexp_extract("doc_id", r"^(\d+)(?:[-/_]|$)", 1)
    return images.where("hash is not null").groupBy("hash").agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct("document_id").alias("documents"), F.count_distinct(F.when(entry != "", entry)).alias("entries"),
        F.min_by("bytes", "image_id").alias("bytes"), F.min_by(F.when(usable, F.col("description")), F.when(usable, F.col("image_id"))).alias("description"),
    )


def repeat_candidates(registry: DataFrame, copies: int, n: int = 100) -> DataFrame:
    """Hashes with so many copies and a description, most copied first."""
    return registry.where((F.col("copies") >= copies) & F.col("description").isNotNull()).orderBy(F.desc("copies"), "hash").limit(n)


def label_stats(labels: DataFrame) -> DataFrame:
    """Number and share of each label."""
    out = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return out.crossJoin(F.broadcast(out.agg(F.sum("n").alias("__all")))).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


#: The labels of the privacy filter.
LABELS = ("public", "needs_review", "private")


def label_summary(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (raw_id, label, meta as JSON) of raw documents (raw_id, source_id), for each source and in all (level 1): total_raw, classified, unclassified, errors and a column for each label.

    A source's counts are those of its documents' labels; errors are labels whose meta has error true. A label of a
    document that isn't there counts nowhere.
    """
    error = F.coalesce(F.get_json_object("meta", "$.error") == "true", F.lit(False))
    said = labels.select("raw_id", "label", error.alias("error")).join(raw.select("raw_id", "source_id"), "raw_id")
    one = [F.count_if(F.col("label") == x).alias(x) for x in LABELS]
    by_label = said.rollup("source_id").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("classified"), F.count_if("error").alias("errors"), *one)
    whole = raw.rollup("source_id").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("total_raw")).alias("w")
    on = F.col("w.source_id").eqNullSafe(F.col("l.source_id")) & (F.col("w.level") == F.col("l.level"))
    rows = whole.join(by_label.alias("l"), on, "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("w.source_id", "w.level", "total_raw", count("classified"), (F.col("total_raw") - F.coalesce("classified", F.lit(0))).alias("unclassified"), count("errors"), *map(count, LABELS))


def oversized(docs: DataFrame, limit: int, types: Sequence[str]) -> DataFrame:
    """Raw documents of the types whose longest text is over the limit."""
    found = docs.where(F.col("source_type").isin(list(types))).groupBy("raw_id").agg(F.max(F.length("text")).alias("longest"))
    return found.where(F.col("longest") > limit)


def node_mentions(relations: DataFrame) -> DataFrame:
    """How often each node is an end of a relation of each document."""
    ends = relations.select("document_id", F.explode(F.array("source_node", "target_node")).alias("node"))
    return ends.groupBy("node", "document_id").agg(F.count(F.lit(1)).alias("mentions"))


def built_in_checks() -> dict[str, Column]:
    """The checks that come with the library, over (doc_type, text): markers that a parser left in place of images and formulas, and texts of nothing but space."""
    left = lambda mark: (F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))) / len(mark)
    blank = (F.col("doc_type") == "text") & (F.coalesce(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("")) == "")
    return {"image-markers": left("<!-- image -->"), "formula-markers": left("<!-- formula-not-decoded -->"), "empty-text": blank}


def run_checks(docs: DataFrame, checks: dict[str, Column] | None = None, names: Sequence[str] = ()) -> DataFrame:
    """A row for each document and check with a count above 0; the built-in checks if no others are given, those of names only if some are.

    An unknown name raises.
    """
    checks = built_in_checks() if checks is None else checks
    if unknown := [n for n in names if n not in checks]:
        raise ValueError(f"unknown checks {unknown}, there are {sorted(checks)}")
    checks = {n: c for n, c in checks.items() if not names or n in names}
    found = F.array(*[F.struct(F.lit(n).alias("issue"), c.cast("long").alias("n")) for n, c in checks.items()])
    return docs.select("id", F.explode(found).alias("x")).select("id", "x.issue", "x.n").where("n > 0")


def conflict_findings(cites: DataFrame) -> DataFrame:
    """For each question the most models that cite one newer document: cites (question_id, model, document_id, newer)."""
    agreed = cites.where("newer").groupBy("question_id", "document_id").agg(F.count_distinct("model").alias("models"))
    return agreed.groupBy("question_id").agg(F.count(F.lit(1)).alias("newer_documents"), F.max("models").alias("models"))


def hold_summary(current: DataFrame, now: Column, hours: int) -> DataFrame:
    """Documents held, and held for longer than so many hours."""
    held = F.col("state") == "held"
    old = F.col("updated") < now - F.expr(f"INTERVAL {hours} HOURS")
    return current.agg(F.count_if(held).alias("held"), F.count_if(held & old).alias("stuck"))


def oversize_chunk_docs(docs: DataFrame, chunks: DataFrame, tokens: int) -> DataFrame:
    """Documents with a chunk above so many tokens."""
    return docs.join(chunks.where(F.col("tokens") > tokens).select("id"), "id", "left_semi")
