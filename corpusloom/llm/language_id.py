"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit, a binary classifier over hashed byte n-grams predicts it: its
weights are the log ratio of the mean n-gram distributions of the languages on either side. A text's bits are decoded to
the codeword of least loss, each classifier weighed by how well it does on the language in question; the runner-up
tells whether the decision is ambiguous.

Counting is one pass over the training rows, with one vector per language and task; a second pass over a fifth of them
weighs the classifiers. What reaches the driver is languages x BUCKETS numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_ids

#: n-gram lengths in bytes, counters of the hash, and bytes that are looked at together.
GRAMS, BUCKETS, BLOCK = (2, 3, 4), 1 << 16, 1 << 20
#: Scale of a classifier's output before the loss, and the score gap under which a decision is ambiguous.
SCALE, CLEAR = 3.0, 0.2
UNDETERMINED = "und"

_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords: all ways to split up to 7 languages in two, else random columns, 12 for each doubling of n at least.

    Columns are added until any two codewords differ in a third of them, so that a sixth of the bits may be wrong.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    rng, cols = np.random.default_rng(seed), []
    while len(cols) < 12 * int(np.ceil(np.log2(n))) or 3 * _nearest(np.array(cols).T) < len(cols):
        c = rng.permutation(np.where(np.arange(n) % 2, 1, -1))
        if not any(np.array_equal(c, x) or np.array_equal(-c, x) for x in cols):
            cols.append(c)
    return np.array(cols, float).T


def _nearest(code: np.ndarray) -> int:
    """Bits in which the two nearest codewords differ."""
    apart = (code.shape[1] - code @ code.T) / 2
    return int((apart + np.eye(len(code)) * code.shape[1]).min())


def _bytes_of(text: str | None) -> bytes:
    return b" " + text.lower().encode("utf-8", "ignore").translate(_LETTERS_ONLY) + b" " if text else b""


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _hashes(b: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of each length that start at each byte; a run of spaces makes none but one of its own."""
    out, h = [], np.zeros(len(b), np.uint32)
    x = b.astype(np.uint32) + np.uint32(1)
    for n in range(1, max(GRAMS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] * _ODD[(n - 1) % 4]
        if n in GRAMS:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int32))
    return out


def _blocks(raw: bytes) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of each length that start in each block of raw; every n-gram comes once."""
    b = np.frombuffer(raw, np.uint8)
    for i in range(0, len(b), BLOCK):
        for h in _hashes(b[i : i + BLOCK + max(GRAMS) - 1]):
            yield h[:BLOCK]


def _distribution(raw: bytes) -> np.ndarray:
    """Share of each bucket in a text's n-grams."""
    total = np.zeros(BUCKETS)
    for h in _blocks(raw):
        total += np.bincount(h, minlength=BUCKETS)
    n = total.sum()
    return total / n if n else total


def _outputs(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams of each text, for each bit; small texts go through together."""
    out, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        if j == i + 1:
            for h in _blocks(texts[i]):
                out[i] += weights[h].sum(axis=0, dtype=np.float64)
                n[i] += len(h)
        else:
            b = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            owner = np.repeat(np.arange(i, j), [len(t) for t in texts[i:j]])
            for g, h in zip(GRAMS, _hashes(b), strict=False):
                inside = owner[: len(h)] == owner[g - 1 : g - 1 + len(h)]  # n-grams within one text
                own = owner[: len(h)][inside]
                for bit in range(weights.shape[1]):
                    out[:, bit] += np.bincount(own, weights[h[inside], bit], len(texts))
                n += np.bincount(own, minlength=len(texts))
        i = j
    return out / np.maximum(n, 1)[:, None]


@dataclass
class LanguageModel:
    """languages in order, codewords (language x bit), weights (bucket x bit), trust (language x bit)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, its score, gap to the runner-up) by the exponential loss, weighed by trust."""
        f = np.clip(outputs * SCALE, -3, 3)
        loss = np.einsum("lb,nlb->nl", self.trust, np.exp(-self.code[None] * f[:, None, :]))
        e = np.exp(-2 * (loss - loss.min(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, top - p.max(axis=1)


def fit(docs: DataFrame, trained: Column, calibrate: Column) -> LanguageModel | None:
    """A model from text and lang of the rows where trained holds and neither is null; None if there are none.

    Each text counts as one, whatever its length. calibrate picks the rows that weigh the classifiers.
    """
    rows = docs.select("text", "lang", calibrate.alias("calibrate")).where(trained & F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                if _has_letter(text):
                    if lang not in total:
                        total[lang] = np.zeros(BUCKETS)
                    raw = _bytes_of(text)
                    if len(raw) < 20_000:
                        h = np.concatenate(_hashes(np.frombuffer(raw, np.uint8)))
                        np.add.at(total[lang], h, 1.0 / len(h))
                    else:
                        total[lang] += _distribution(raw)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "w": t[at]})

    sums = rows.select("text", "lang").mapInPandas(count, "lang string, bucket int, w double").groupBy("lang", "bucket").agg(F.sum("w").alias("w")).toPandas()
    languages = sorted(sums["lang"].unique())
    if not languages:
        return None
    p = np.zeros((len(languages), BUCKETS))
    p[sums["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(), sums["bucket"].to_numpy()] = sums["w"].to_numpy()
    p = p / p.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    side = lambda s: np.stack([p[code[:, b] == s].mean(axis=0) if (code[:, b] == s).any() else np.zeros(BUCKETS) for b in range(code.shape[1])], axis=1)
    tiny = 0.02 / BUCKETS
    weights = np.log((side(1) + tiny) / (side(-1) + tiny)).astype(np.float32)
    model = LanguageModel(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))
    if len(languages) > 1:
        model.trust = _trust(rows.where("calibrate").select("text", "lang"), model)
    return model


def _trust(rows: DataFrame, model: LanguageModel) -> np.ndarray:
    """For each language and bit, the classifier's share of right answers, as shares of one for each language."""
    number, bits = {x: i for i, x in enumerate(model.languages)}, model.code.shape[1]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, n = np.zeros(model.code.shape), np.zeros(len(number))
        for b in batches:
            use = [(_bytes_of(t), number[x]) for t, x in zip(b["text"], b["lang"], strict=True) if _has_letter(t) and x in number]
            if use:
                lang = np.array([x for _, x in use])
                np.add.at(right, lang, _outputs([t for t, _ in use], model.weights) * model.code[lang] > 0)
                np.add.at(n, lang, 1)
        at = np.indices(right.shape).reshape(2, -1)
        yield pd.DataFrame({"l": at[0].astype(np.int32), "b": at[1].astype(np.int32), "hits": right.ravel(), "n": np.repeat(n, bits)})

    got = rows.mapInPandas(check, "l int, b int, hits double, n double").groupBy("l", "b").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toPandas()
    share = np.full(model.code.shape, 0.5)
    share[got["l"], got["b"]] = (got["hits"] + 1) / (got["n"] + 2)
    gain = np.maximum(share - 0.5, 0.01)
    return gain / gain.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row of docs, from its text alone.

    A text that is null or has no letter is 'und' with score 0, and so is every text if there is no model. Whole texts
    are read, whatever their length. Extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts, n = b.column("text").to_pylist(), len(b)
            lang, score, clear = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n)
            at = np.array([i for i, t in enumerate(texts) if m is not None and _has_letter(t)], int)
            if len(at):
                best, top, gap = m.decode(_outputs([_bytes_of(texts[i]) for i in at], m.weights))
                lang[at], score[at], clear[at] = np.array(m.languages, object)[best], top, gap
            yield beside_ids(b, {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "ambiguous": pa.array(clear < CLEAR)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
