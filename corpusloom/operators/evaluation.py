"""Retrieval quality and answer evaluation (E)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entry_key, words


def hit_rate(results: DataFrame, by: Sequence[str] = ("run_id",), flag: str = "is_hit") -> DataFrame:
    """Share of hits among rows with a flag."""
    return results.groupBy(*by).agg(F.count(flag).alias("n"), F.avg(F.col(flag).cast("double")).alias("hit_rate"))


def latest_hit_rate(runs: DataFrame, results: DataFrame, flag: str = "is_hit") -> DataFrame:
    """For each generation the hit rate of its newest run (run_id, generation_id, created_time), ties to the larger run_id; null without a flag."""
    newest = runs.where("generation_id is not null").groupBy("generation_id").agg(F.max_by("run_id", F.struct("created_time", "run_id")).alias("run_id"))
    return newest.join(hit_rate(results, ("run_id",), flag), "run_id", "left").select("generation_id", "run_id", F.coalesce("n", F.lit(0)).alias("n"), "hit_rate")


def rank_distribution(results: DataFrame) -> DataFrame:
    """E2."""
    return results.groupBy("hit_rank").agg(F.count(F.lit(1)).alias("n"))


def recall_at_k(results: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Share of questions with a hit at rank k or better; no rank never counts."""
    one = lambda k: F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)).alias(f"k{k}")
    wide = results.agg(*[one(k) for k in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("recall")) for k in ks])).alias("x")).select("x.k", "x.recall")


def run_summary(results: DataFrame) -> DataFrame:
    """Questions, hits, misses and judged hits of each run."""
    return results.groupBy("run_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"), F.count("is_judge_hit").alias("judged"), F.count_if("is_judge_hit").alias("judge_hits"))


def score_retrieval(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """E5: first rank of the exact document and of its entry, for each question."""
    exact = F.min(F.when(F.col("document_id") == F.col("source_document_id"), F.col("rank")))
    entry = F.min(F.when(F.col("entry") == F.col("source_entry"), F.col("rank")))
    seen = questions.join(retrieved, "question_id", "left").groupBy("question_id").agg(exact.alias("hit_rank"), entry.alias("entry_rank"), F.max("score").alias("best_score"))
    return seen.withColumn("is_hit", F.col("hit_rank").isNotNull())


def retrieval_ablation(results: DataFrame, k: int) -> DataFrame:
    """Hits within k and mean reciprocal rank of each variant."""
    rank = F.col("hit_rank")
    return results.groupBy("variant").agg(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias("hit_at_k"), F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"))


def compare_runs(results: DataFrame, usage: DataFrame) -> DataFrame:
    """Each run's metrics side by side; null where a metric was never recorded."""
    out = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.col("is_hit").cast("int")).alias("hits"), F.sum(F.col("is_judge_hit").cast("int")).alias("judge_hits"), F.avg("seconds").alias("seconds"))
    return out.join(usage.groupBy("run_id").agg(F.sum("tokens").alias("tokens")), "run_id", "left")


#: What the steps of an agent's trace may say; the last step with a summary is the trace's.
TRACE = "array<struct<summary:boolean,saw_source:boolean,opened_source:boolean,hit_turn_limit:boolean,stopped_by:string,tool_calls:int>>"


def trace_summary(trace: Column) -> Column:
    """The summary step of a trace in JSON, the last one that says it is; null without any."""
    return F.try_element_at(F.filter(F.from_json(trace, TRACE), lambda x: F.coalesce(x["summary"], F.lit(False))), F.lit(-1))


def compare_runs_in_full(results: DataFrame, usage: DataFrame) -> DataFrame:
    """Runs side by side, a row for each run_id of results.

    results has run_id, is_hit, is_judge_hit, source_entry_key, entry_hit_rank, answer_time, trace (JSON), source_relation and
    acknowledges_conflict; usage has run_id, stage (answer or judge) and total. What a run never recorded is null, not 0:
    entry hits without any entry key, what the agent did without any trace summary, relations without any relation, tokens without usage.
    """
    s = trace_summary(F.col("trace"))
    rows = results.withColumn("s", s)
    said = F.count("s") > 0
    ever = lambda c: F.count(F.when(F.col(c) != "", 1)) > 0
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    related = [F.when(ever("source_relation"), F.count_if(F.col("source_relation") == x)).alias(x) for x in ("newer_source", "older_source", "conflicting_source")]
    out = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("questions"), yes(F.col("is_hit")).alias("exact_hits"),
        F.when(ever("source_entry_key"), F.count_if(F.col("entry_hit_rank") > 0)).alias("entry_hits"),
        F.count("is_judge_hit").alias("judged"), yes(F.col("is_judge_hit")).alias("judge_correct"),
        F.when(said, yes(F.col("s.saw_source"))).alias("agent_saw_source"), F.when(said, yes(F.col("s.opened_source"))).alias("agent_opened_source"),
        F.when(said, yes(F.col("s.hit_turn_limit"))).alias("turn_limit"), F.when(said, F.count_if(F.col("s.stopped_by") != "")).alias("stopped"),
        F.avg("answer_time").alias("avg_answer_seconds"), *related,
        F.when(ever("source_relation"), yes(F.col("acknowledges_conflict"))).alias("acknowledges_conflict"),
    )
    spent = lambda stage: F.sum(F.when((F.col("stage") == stage) & (F.col("total") > 0), F.col("total"))).alias(f"{stage}_tokens")
    return out.join(usage.groupBy("run_id").agg(spent("answer"), spent("judge")), "run_id", "left")


def question_matrix(results: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Questions by runs, hardest first."""
    out = results.groupBy("question_id").pivot("run_id", list(runs)).agg(F.max(F.col("is_hit").cast("int")))
    solved = sum((F.coalesce(F.col(f"`{r}`"), F.lit(0)) for r in runs), F.lit(0))
    return out.withColumn("solved", solved).orderBy("solved", "question_id")


def run_groups(runs: DataFrame) -> DataFrame:
    """Runs (name, search_type, created_time) by the part of their name before -<search_type>-, newest group first.

    Runs without such a part, or with an empty one, are in no group.
    """
    at = F.expr("instr(name, concat('-', search_type, '-'))")
    prefix = F.when(at > 1, F.expr("left(name, instr(name, concat('-', search_type, '-')) - 1)"))
    rows = runs.where("search_type <> ''").select(prefix.alias("prefix"), "created_time").where("prefix is not null")
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("runs"), F.max("created_time").alias("newest")).orderBy(F.desc("newest"), "prefix")


def question_funnel(questions: DataFrame, rejected: DataFrame, usable: DataFrame) -> DataFrame:
    """Questions generated, rejected for overlap, rejected by audits, usable."""
    q = questions.join(rejected.select("question_id").distinct().withColumn("r", F.lit(1)), "question_id", "left").join(usable.select("question_id").distinct().withColumn("u", F.lit(1)), "question_id", "left")
    return q.agg(F.count(F.lit(1)).alias("generated"), F.count("r").alias("overlap_rejected"), F.count_if(F.col("r").isNull() & F.col("u").isNull()).alias("audit_rejected"), F.count_if(F.col("r").isNull() & F.col("u").isNotNull()).alias("usable"), F.count_distinct("document_id").alias("documents"))


def accuracy_breakdown(results: DataFrame) -> DataFrame:
    """Accuracy by mode and model, by each alone, and in all."""
    return results.cube("mode", "model").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def wrong_breakdown(results: DataFrame, conflicts: DataFrame) -> DataFrame:
    """What a model's wrong answers are, and its accuracy beside those of source conflicts, a row for each model.

    results has model, question_id, is_judge_hit (null: not judged, left out), source_relation and source_verified; conflicts, as
    conflict_findings gives them, has question_id and models. Answers from a verified newer document count as right in
    accuracy_newer_ok; questions that several models contradict with one newer document are left out in accuracy_without_corroborated.
    """
    shared = conflicts.where("models > 1").select("question_id").distinct().withColumn("corroborated", F.lit(True))
    rows = results.where("is_judge_hit is not null").join(shared, "question_id", "left")
    wrong = ~F.col("is_judge_hit")
    kind = lambda x: F.coalesce(wrong & (F.col("source_relation") == x), F.lit(False))
    kept = F.col("corroborated").isNull()
    out = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(kind("newer_source")).alias("newer"),
        F.count_if(kind("newer_source") & F.coalesce("source_verified", F.lit(False))).alias("newer_verified"),
        F.count_if(kind("older_source")).alias("older"), F.count_if(kind("conflicting_source")).alias("conflicting"),
        F.count_if(kept).alias("n_without_corroborated"), F.avg(F.when(kept, F.col("is_judge_hit").cast("double"))).alias("accuracy_without_corroborated"),
    )
    right = F.col("n") - F.col("wrong")
    other = F.col("wrong") - F.col("newer") - F.col("older") - F.col("conflicting")
    return out.select("*", other.alias("other"), (right / F.col("n")).alias("accuracy"), ((right + F.col("newer_verified")) / F.col("n")).alias("accuracy_newer_ok"))


def flip_rate(verdicts: DataFrame) -> DataFrame:
    """Share of pairs of repeated verdicts on a question that differ; from counts, not from pairs."""
    per = verdicts.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("verdict").alias("y"))
    return per.agg(F.sum(F.col("y") * (F.col("n") - F.col("y"))).alias("flips"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs")).withColumn("flip_rate", F.col("flips") / F.col("pairs"))


def agent_behaviour(traces: DataFrame) -> DataFrame:
    """Mean turns and tool calls of each conversation's steps (conv_id, turn, role, text)."""
    per = traces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(F.length("text")).alias("chars"))
    return per.agg(F.count(F.lit(1)).alias("conversations"), F.avg("turns").alias("turns"), F.avg("answers").alias("answers"), F.avg("chars").alias("chars"))


def answer_behaviour(results: DataFrame, usage: DataFrame) -> DataFrame:
    """How each model answers: results (model, answer_time, trace as JSON), usage (model, question_id, total).

    n, seconds_per_answer over answers with a time, tool_calls_per_answer (0 without a trace summary), the shares of answers
    that opened and that saw the source, and tokens_per_question over the questions that usage names, null without usage.
    """
    rows = results.withColumn("s", trace_summary(F.col("trace")))
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    out = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("answer_time").alias("seconds_per_answer"), F.avg(F.coalesce("s.tool_calls", F.lit(0)).cast("double")).alias("tool_calls_per_answer"),
        share("s.opened_source").alias("opened_source"), share("s.saw_source").alias("saw_source"),
    )
    spent = usage.where("question_id is not null").groupBy("model").agg((F.sum("total") / F.count_distinct("question_id")).alias("tokens_per_question"))
    return out.join(spent, "model", "left")


def plan_grid(sets: DataFrame, modes: DataFrame, models: DataFrame, complete: DataFrame) -> DataFrame:
    """Names of the runs that are still to do; the sides of the product are small dimensions."""
    name = F.concat_ws("-", "question_set", "mode", "model")
    return sets.crossJoin(F.broadcast(modes)).crossJoin(F.broadcast(models)).withColumn("name", name).join(complete.select("name"), "name", "left_anti")


def generation_hash(settings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A stable hash of settings, whatever the order of columns."""
    return settings.withColumn("generation", F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)])), 256))


def build_context(hits: DataFrame, budget: int = 720_000) -> DataFrame:
    """The texts of a question's documents by rank, each cut to an equal share of a budget of characters.

    Each text stands under its doc_id in brackets, with a rule between two; documents without text don't count.
    """
    hits = hits.where("text <> ''").withColumn("n", F.count(F.lit(1)).over(_by_question()))
    part = F.struct("rank", F.expr(f"concat('[', doc_id, ']\n', substring(text, 1, CAST({budget} DIV n AS INT)))").alias("t"))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def _by_question():
    return Window.partitionBy("question_id")


def rejudge_items(results: DataFrame, resumed: DataFrame) -> DataFrame:
    """Answers without a verdict in the resumed run."""
    return results.join(resumed.where("verdict is not null").select("question_id"), "question_id", "left_anti")


def list_audits(audits: DataFrame, kind: str | None = None, valid: bool | None = None) -> DataFrame:
    """E20."""
    out = audits if kind is None else audits.where(F.col("audit_type") == kind)
    return out if valid is None else out.where(F.col("is_valid") == valid)


#: Function words, which say nothing about a shared wording.
FUNCTION_WORDS = (
    "a an and are as at be by can did do does for from has have how in is it its of on or "
    "that the their these this to was were what when where which who why will with"
).split()
_FUNCTION_WORDS = frozenset(FUNCTION_WORDS)


def longest_run(a: list[str], b: list[str]) -> int:
    """The length of the longest run of words that both have, in time proportional to both.

    The states of a suffix automaton of a stand for its runs; b is read word by word, falling back along suffix links.
    """
    step: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for word in a:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    best = at = n = 0
    for word in b:
        while at and word not in step[at]:
            at = link[at]
            n = size[at]
        if word in step[at]:
            at, n = step[at][word], n + 1
            best = max(best, n)
    return best


def question_overlap(pairs: DataFrame) -> DataFrame:
    """P25: pairs (id, question, document) with bigram_overlap and longest_shared_words.

    The first is the share of the question's pairs of neighbouring content words that the document has too, to three places; the second the
    length of the longest run of words that the question has from the document. A row for each pair, in one pass.
    """
    # exploded as one value, so that the words are taken from the texts once
    both = F.struct(words(F.col("question")).alias("q"), words(F.col("document")).alias("d"))
    rows = pairs.select("id", F.explode(F.array(both)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share, longest = [], []
            for q, d in zip(b.column("q").to_pylist(), b.column("d").to_pylist(), strict=True):
                asked, said = ([w for w in side if w not in _FUNCTION_WORDS] for side in (q, d))
                bigrams, known = list(zip(asked, asked[1:], strict=False)), set(zip(said, said[1:], strict=False))
                share.append(round(sum(x in known for x in bigrams) / len(bigrams), 3) if bigrams else 0.0)
                longest.append(longest_run(q, d))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "bigram_overlap": pa.array(share, pa.float64()), "longest_shared_words": pa.array(longest, pa.int64())})

    kind = pairs.schema["id"].dataType.simpleString()
    return rows.select("id", "w.q", "w.d").mapInArrow(run, f"id {kind}, bigram_overlap double, longest_shared_words long")


def overlap_audit(pairs: DataFrame, most: float = 0.5) -> DataFrame:
    """Audit rows (id, audit_type, is_valid, bigram_overlap): a question that shares more than most of its bigrams with its document is invalid."""
    return question_overlap(pairs).select("id", F.lit("overlap").alias("audit_type"), (F.col("bigram_overlap") <= most).alias("is_valid"), "bigram_overlap")


def mentions_source(results: DataFrame) -> DataFrame:
    """Results (id, tool_result, source_document_id, source_entry_key) with whether a result shows its question's source.

    It does by the document's id as it stands, or by any doc_id in it, as JSON or after ID:, that belongs to the source's entry.
    """
    ids = F.concat(F.regexp_extract_all("tool_result", F.lit(r'"doc_id":\s*"([^"]+)"'), 1), F.regexp_extract_all("tool_result", F.lit(r"(?m)^ID:\s*(\S+)"), 1))
    source = F.substring_index("source_entry_key", ":", 1)
    by_id = F.contains("tool_result", F.col("source_document_id"))
    by_entry = F.exists(ids, lambda i: entry_key(source, i) == F.col("source_entry_key"))
    return results.select("id", (F.coalesce(by_id, F.lit(False)) | F.coalesce(by_entry, F.lit(False))).alias("mentioned"))
