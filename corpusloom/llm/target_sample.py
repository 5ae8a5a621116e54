"""Importance resampling towards the distribution of a target text set.

Features are runs of one to three consecutive words, hashed into BUCKETS. The gain of a bucket is the log ratio of its
smoothed share in the target texts and in all documents; a document's weight is the sum of the gains of its features,
read from one array. Gumbel noise from a hash of the document's id turns the highest scores into a sample without
replacement.

The cutoff is found without sorting all scores: a quantile sketch brackets the k-th highest one; exact counts above and
within the bracket show whether it is there, else the bracket is widened; only what is within is sorted to find the row
at which the sample ends. The drawn rows alone are then numbered, by ranges.

Texts are read twice, as bytes: words become spans of one array, and checksums of all runs grow byte by byte over all
spans at once. A text longer than BLOCK is taken in stretches that share two words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside_ids, numbered

BUCKETS, ORDERS = 10_000, 3
#: A document needs so many words to be drawn, and DRAWN percent of those that have them are.
LEAST_WORDS, DRAWN = 20, 5
SALT = "42:"
#: Share of all rows that the sketch may be off by.
SKETCH_ERROR = 0.002
BLOCK = 1 << 21
#: Bytes of a word from which on its checksum is continued by itself.
LONG = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_LOWER_BYTES = _LOWER.tobytes()
_ALL = np.uint32(0xFFFFFFFF)


def _extended(state: np.ndarray, b: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The states after the bytes of one word each."""
    order = np.argsort(-length, kind="stable")
    s, begin, length = state[order], begin[order], length[order]
    longest = int(length[0]) if len(length) else 0
    for j in range(min(longest, LONG)):
        k = int(np.searchsorted(-length, -j, side="left"))  # words longer than j
        now = s[:k]
        s[:k] = _CRC[(now ^ b[begin[:k] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for i in range(int(np.searchsorted(-length, -LONG, side="left"))):
        rest = b[begin[i] + LONG : begin[i] + length[i]]
        s[i] = ~np.uint32(zlib.crc32(rest, int(~s[i])))
    out = np.empty_like(s)
    out[order] = s
    return out


def _features(b: np.ndarray, begin: np.ndarray, length: np.ndarray, owner: np.ndarray, known: int, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, owners) of the runs of each order that end behind the first known words."""
    state = np.full(len(begin), _ALL)
    state = _extended(state, b, begin, length)
    for n in range(1, orders + 1):
        if n > 1:
            joined = owner[n - 1 :] == owner[: len(owner) - n + 1]
            # state has a run of n - 1 words for each word at which one begins
            space = _CRC[(state[: len(begin) - n + 1] ^ np.uint32(32)) & np.uint32(255)] ^ (state[: len(begin) - n + 1] >> np.uint32(8))
            state = _extended(space, b, begin[n - 1 :], length[n - 1 :])
        else:
            joined = np.ones(len(begin), bool)
        use = joined & (np.arange(len(state)) + n > known)
        yield (~state[use] % np.uint32(BUCKETS)).astype(np.int64), owner[: len(state)][use]
        if len(begin) <= n:
            return


def _spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], _IN_WORD[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def _stretches(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A long text in stretches of whole words, each with the last words of the one before it, and how many those are."""
    at, last = 0, []
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and _IN_WORD[text[end]] and _IN_WORD[text[end - 1]]:
            end += 1
        part = text[at:end]
        yield b" ".join([*last, part]), len(last)
        begin, length = _spans(np.frombuffer(part, np.uint8))
        last = [*last, *(part[x : x + n] for x, n in zip(begin[-(ORDERS - 1) :], length[-(ORDERS - 1) :], strict=True))][-(ORDERS - 1) :]
        at = end


def text_features(texts: list[str | None], orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, owners, words of each text) in blocks; owners are places in texts."""
    raw = [(t or "").encode("utf-8", "ignore").translate(_LOWER_BYTES) for t in texts]
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) <= BLOCK):
            size += len(raw[j]) + 1
            j += 1
        parts = [(raw[i], 0)] if j > i + 1 or len(raw[i]) <= BLOCK else _stretches(raw[i])
        for part, known in parts if j == i + 1 else [(b"\n".join(raw[i:j]), 0)]:
            b = np.frombuffer(part, np.uint8)
            begin, length = _spans(b)
            ends = np.cumsum([len(t) + 1 for t in raw[i:j]]) if j > i + 1 else np.array([len(b) + 1])
            owner = i + np.searchsorted(ends, begin, side="right")
            words = np.bincount(owner[known:], minlength=len(raw))
            for k, (buckets, own) in enumerate(_features(b, begin, length, owner, known, orders)):
                yield buckets, own, words if k == 0 else np.zeros_like(words)
        i = j


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts (column text) in each bucket; BUCKETS sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for buckets, _, _ in text_features(b.column("text").to_pylist()):
                total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, for each bucket."""
    t, s = target.astype(np.float64) + 1, raw.astype(np.float64) + 1
    return np.floor(1000 * np.log(t * float(raw.sum() + BUCKETS) / (s * float(target.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value.astype(np.float64)
        for b in batches:
            n = len(b)
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for buckets, owner, w in text_features(b.column("text").to_pylist()):
                words += w
                features += np.bincount(owner, minlength=n)
                weight += np.bincount(owner, g[buckets], n)
            yield beside_ids(b, {"n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(weight.astype(np.int64))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, salt: str = SALT) -> Column:
    """floor(1000 g) of standard Gumbel noise g from a hash of the id; a null id hashes as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def bracket(rows: DataFrame, k: int, n: int, error: float = SKETCH_ERROR) -> tuple[float, float, int]:
    """(low, high, rows above high) such that the k-th highest score is from low to high; rows has n scores, k from 1 to n.

    The sketch is asked for the shares two errors to each side of the k-th. Exact counts decide: a bracket that misses is
    widened fourfold, until it has all.
    """
    while True:
        lower, upper = 1 - k / n - 2 * error, 1 - k / n + 2 * error
        accuracy = int(max(100, 1 / error))
        low, high = rows.agg(F.percentile_approx("score", [max(lower, 0.0), min(upper, 1.0)], accuracy)).first()[0]
        low, high = low if lower > 0 else float("-inf"), high if upper < 1 else float("inf")
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        error *= 4


def target_sample(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, least_words: int = LEAST_WORDS, salt: str = SALT, error: float = SKETCH_ERROR) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_features, weight, score, rank.

    Of the N rows with at least least_words words, floor(drawn * N / 100) of the highest scores are drawn, ties to the
    smaller doc_id, a null one last; rank is their place from 1, and null for all others. Rows alike in score and doc_id
    are ranked by weight and features. A null or empty text has no features and weight 0. Whole texts are read, whatever
    their length; without target texts all gains follow from the smoothing. Extra columns are ignored; an empty table
    has no rows.
    """
    scratch = Scratch(docs.sparkSession, "target_sample")
    gain = gains(bucket_counts(target), bucket_counts(docs))
    rows = scratch.keep(weigh(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), salt)))
    able = F.col("n_words") >= least_words
    n = rows.where(able).count()
    k = drawn * n // 100
    unranked = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return rows.select(*columns, unranked)
    low, high, above = bracket(rows.where(able), k, n, error)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc(), F.col("n_words").asc()]
    inside = scratch.keep(rows.where(able & F.col("score").between(low, high)).withColumn("all", F.lit("")))
    cut = numbered(inside, "all", order, scratch).where(F.col("pos") == k - above - 1).first()
    tied = F.col("score") == F.lit(cut["score"])
    if cut["doc_id"] is not None:
        tied = tied & (F.col("doc_id") <= F.lit(cut["doc_id"]))
    drawn_ = F.coalesce(able & ((F.col("score") > F.lit(cut["score"])) | tied), F.lit(False))
    best = numbered(scratch.keep(rows.where(drawn_).withColumn("all", F.lit(""))), "all", order, scratch)
    # rows that tie in all of score and doc_id may be more than there is room for
    ranked = best.select(*columns, F.when(F.col("pos") < k, F.col("pos") + 1).alias("rank"))
    return rows.where(~drawn_).select(*columns, unranked).unionByName(ranked)


