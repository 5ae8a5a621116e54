"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs are counted: one of target text (labelled as good), one of all
text. A document's importance is the ratio of the two for an excerpt of EXCERPT tokens that is like the whole: the mean
log ratio of its tokens times EXCERPT, so that long and short texts of one kind weigh the same. Gumbel noise on the
logarithm of the importance turns the k largest keys into a sample without replacement, of probability in proportion to
importance. k is given, or comes from the labels: as many documents as have a key above the cut that best parts the keys
of the labelled ones.

Two passes over all texts. BUCKETS counts and a histogram of labelled scores reach the driver; the k-th key is found by
counting keys in ever finer intervals, not by a sort.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside_ids, fitted

BUCKETS, PAIR = 10_000, np.uint64(0x9E3779B97F4A7C15)
#: Labelled documents that are used at most: those whose doc_id has the smallest hash.
MOST_LABELLED = 20_000
#: Tokens of the excerpt whose importance is a document's.
EXCERPT, SEED, BINS = 64, 17, 2000
#: Ids of refused documents up to which they are broadcast.
FETCH_ROWS = 2_000_000

_TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\s]+")


def features(text: str | None, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Buckets of the words and word pairs of a text, in blocks."""
    if not text:
        return
    crc, last = zlib.crc32, np.empty(0, np.uint64)
    tokens = _TOKEN.findall(text.lower().encode("utf-8", "ignore"))
    for i in range(0, len(tokens), most):
        h = np.fromiter(map(crc, tokens[i : i + most]), np.uint64)
        run = np.concatenate([last, h])
        yield (h * PAIR >> np.uint64(20)).astype(np.int64) % (BUCKETS // 2)
        if len(run) > 1:
            yield (((run[:-1] * PAIR + run[1:]) * PAIR) >> np.uint64(20)).astype(np.int64) % (BUCKETS // 2) + BUCKETS // 2
        last = h[-1:]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b in batches:
        for text, good in zip(b["text"], b["good"], strict=True):
            for f in features(text):
                c = np.bincount(f, minlength=BUCKETS)
                raw += c
                if good == 1:
                    target += c
    yield pd.DataFrame({"bucket": np.arange(BUCKETS, dtype=np.int32), "raw": raw, "target": target})


def log_ratios(rows: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, from rows (text, good); words and pairs are two distributions."""
    got = rows.mapInPandas(_counts, "bucket int, raw double, target double").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    out, half = np.zeros(BUCKETS), BUCKETS // 2
    for part in (slice(0, half), slice(half, BUCKETS)):
        p, q = target[part] + 1, raw[part] + 1
        out[part] = np.log(p / p.sum()) - np.log(q / q.sum())
    return out


def score(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """rows (doc_id, good, text) with n_tokens and mean_ratio in place of text; a text without tokens has mean 0."""
    sent = rows.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        for b in batches:
            total, n = np.zeros(len(b)), np.zeros(len(b), np.int64)
            for i, text in enumerate(b.column("text").to_pylist()):
                for f in features(text):
                    total[i] += r[f].sum()
                    n[i] += len(f)
            yield beside_ids(b, {"n_tokens": pa.array(n), "mean_ratio": pa.array(total / np.maximum(n, 1))}, carried=("doc_id", "good"))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "good", "text").mapInArrow(run, f"doc_id {kind}, good int, n_tokens long, mean_ratio double")


def best_cut(scored: DataFrame) -> float:
    """The cut of key that parts labelled documents best, of equally good ones the lowest; -inf without both labels.

    A wrongly refused good document weighs as much as ten wrongly kept bad ones, in shares of each kind.
    """
    known = scored.where("good is not null and n_tokens > 0")
    ends = known.agg(F.min("key"), F.max("key"), F.min("good"), F.max("good")).first()
    if ends[0] is None or ends[2] == ends[3]:
        return float("-inf")
    low, step = ends[0], max((ends[1] - ends[0]) / BINS, 1e-12)
    bin_ = F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1)).cast("int")
    h = np.zeros((2, BINS))
    for r in known.groupBy(bin_.alias("bin"), "good").count().collect():  # 2 BINS rows at most
        h[int(r["good"] == 1), r["bin"]] += r["count"]
    share = h / h.sum(axis=1, keepdims=True)
    cost = 10 * np.concatenate([[0], np.cumsum(share[1])]) + np.concatenate([np.cumsum(share[0][::-1])[::-1], [0]])
    at = np.flatnonzero(cost <= cost.min() + 1e-9)
    return low + step * at[0]


def kth_largest(keys: DataFrame, k: int, bins: int = 512) -> float:
    """The k-th largest of the column key, by counts in ever finer intervals; -inf if there are no more than k."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n <= k:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while low < high:
        step = (high - low) / bins
        part = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        at = F.least(F.floor((F.col("key") - low) / step), F.lit(bins - 1))
        got = sorted(part.groupBy(at.alias("bin")).agg(F.count("key").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect(), reverse=True)
        for r in got:
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["a"], r["b"]) == (low, high) and len(got) == 1:
            break
        low, high = r["a"], r["b"]
    return low


def importance_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, excerpt: int = EXCERPT, seed: int = SEED, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, mean_ratio, gumbel_key, sampled.

    labels has doc_id and quality (1 good, 0 bad; a null is no label). At most most_labelled of them, those of the
    smallest hash, are used. k is the size of the sample, by default the number of documents with a key above the best cut; ties
    at the k-th key are all sampled. Noise is a hash of doc_id and seed, so reruns agree. A text that is null or has no
    tokens has a mean of 0. Without good labels the models are equal but for smoothing; without labels of both
    kinds every document is sampled unless k says otherwise.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    few = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    few = scratch.keep(few.withColumnRenamed("doc_id", "__doc"))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__doc"), "left").select("doc_id", "good", "text")
    scored = score(rows, log_ratios(rows.select("text", "good")))
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    scored = scratch.keep(scored.withColumn("key", F.col("mean_ratio") * excerpt - F.log(-F.log(unit))))
    if k is None:
        k = scored.where(F.col("key") >= best_cut(scored)).count()
    return scored.select("doc_id", "n_tokens", "mean_ratio", F.col("key").alias("gumbel_key"), (F.col("key") >= kth_largest(scored, k)).alias("sampled"))


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The sampled documents, with the columns of docs; rows that share a doc_id stay if any of them is sampled."""
    out = importance_sample(docs, labels, **options).groupBy("doc_id").agg(F.max("sampled").alias("__in")).where("not __in")
    refused = Scratch(docs.sparkSession, "refused").keep(out.select(F.col("doc_id").alias("__doc")))
    return docs.join(fitted(refused, FETCH_ROWS), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_anti")
