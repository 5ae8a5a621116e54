"""Toxicity by a subsequence string kernel, a support vector machine and Nystrom landmarks.

Two words are compared by the subsequences of ORDER letters that both have, gaps and all: a subsequence counts DECAY to
the power of its span in each word. Signs between letters are gaps too, so 'i.d-i*o t' has the subsequences of 'idiot',
and a letter put in or left out leaves most of them. A sentence is the set of its words, and the kernel of two sentences
sums a power of the word kernel over their pairs (a convolution kernel, so again a sum of products of features).

LANDMARKS words stand for all: those that the toxic documents of the training rows have most unlike the others, and
common ones. A sentence's kernel values with the landmarks, whitened by the inverse root of the landmarks' own
kernel matrix, are its Nystrom features. A linear support vector machine is trained on sentences, each with the label of
its document. With the machine's weights a word's part of the decision is one number, which a worker remembers.
A document is as toxic as its worst sentence; a logistic curve over that, fitted on the training documents, is the score.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside_ids

ORDER, DECAY, POWER = 3, 0.7, 3
#: Letters that the letters of one subsequence may lie apart, first to last.
SPAN = 9
LANDMARKS = 48
REG = 1e-5
#: Directions in which landmarks differ by less than this are not blown up to unit length.
LEAST_EIGENVALUE = 0.02
#: What a sentence of a toxic document weighs beside one of another in training.
TOXIC_WEIGHT = 1.5
#: Decisions from the negative of this to it count for the score; the machine's margin is 1.
CLEAR = 2.0
#: Labelled documents that the machine is trained on at most: those whose doc_id has the smallest hash.
MOST_LABELLED = 10_000
#: A sentence is cut after so many words, a word is looked at in windows of so many letters, half a window apart.
SENTENCE, WINDOW = 32, 24
THRESHOLD = 0.3
#: Words whose part of the decision a worker remembers at most; then it starts anew.
REMEMBERED = 1_000_000

_LETTERS = 27  # and the gap, 0
_CODE = np.zeros(256, np.int16)
_CODE[97:123] = np.arange(1, _LETTERS)
_WORD_TABLE = bytes(c if 97 <= c < 123 else 35 for c in range(256))
_MARKS = re.compile("[̀-ͯ]+")
#: Single letters with up to three other signs between them.
_SPACED = re.compile(rb"[ \n][a-z](?:[^a-z\n]{1,3}[a-z](?![a-z])){2,}")


def plain(text: str | None) -> bytes:
    """A text in lower case, without accents and without letters that then aren't ASCII."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.encode("ascii", "ignore")


def sentences(text: str | None) -> Iterator[dict[bytes, None]]:
    """The distinct words of each sentence; letters that stand alone in a row are a sentence of one word.

    A sentence ends with its line, or where a stop, an exclamation or a question mark is followed by a space.
    """
    raw = plain(text)
    for s in raw.replace(b". ", b"\n").replace(b"! ", b"\n").replace(b"? ", b"\n").split(b"\n"):
        words = s.split()
        if len(words) <= SENTENCE:
            yield dict.fromkeys(words)
        else:
            for i in range(0, len(words), SENTENCE):
                yield dict.fromkeys(words[i : i + SENTENCE])
    for s in _SPACED.findall(b" " + raw):
        yield {s: None}


def windows(word: bytes) -> list[bytes]:
    """A word as letters and gaps, long ones in overlapping windows."""
    w = word.translate(_WORD_TABLE).strip(b"#")
    if len(w) <= WINDOW:
        return [w] if len(w) >= ORDER else []
    return [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]


def _places(length: int) -> list[tuple[int, int, int]]:
    return [p for p in itertools.combinations(range(length), ORDER) if p[-1] - p[0] < SPAN]


def _codes(words: list[bytes], size: int) -> np.ndarray:
    """Letters as numbers from 1, gaps as 0: a row for each place, a column for each word."""
    raw = np.frombuffer(b"".join([w.ljust(size, b"#") for w in words]), np.uint8)
    return np.ascontiguousarray(_CODE[raw].reshape(len(words), size).T)


def subsequences(words: list[bytes], size: int) -> Iterator[tuple[np.ndarray, float]]:
    """(the subsequence of each word or 0, its weight) for each choice of places; no word is longer than size."""
    codes = _codes(words, size)
    for i, j, k in _places(size):
        a, b, c = codes[i], codes[j], codes[k]
        u = (a * _LETTERS + b) * _LETTERS + c
        u *= (a > 0) & (b > 0) & (c > 0)
        yield u, DECAY ** (k - i + 1)


def _squares(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each word's kernel with itself: equal subsequences of a row add up before they are squared; code 0 is none."""
    order = np.argsort(codes, axis=1, kind="stable")
    run, w = np.take_along_axis(codes, order, 1), weights[order]
    first = np.ones(run.shape, bool)
    first[:, 1:] = run[:, 1:] != run[:, :-1]
    at = np.flatnonzero(first)
    sums = np.add.reduceat(w.ravel(), at)
    sums[run.ravel()[at] == 0] = 0
    return np.bincount(at // run.shape[1], sums * sums, len(codes))


@dataclass
class WordKernel:
    """The normalised subsequence kernel of words with landmarks."""

    landmarks: list[bytes]
    table: np.ndarray = field(init=False)
    known: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.table = np.zeros((_LETTERS**ORDER, len(self.landmarks)), np.float32)
        for j, w in enumerate(self.landmarks):
            for u, weight in subsequences([w], len(w)):
                self.table[u, j] += weight
        self.table[0] = 0
        self.table /= np.maximum(np.sqrt((self.table**2).sum(axis=0)), 1e-12)
        self.known = self.table.any(axis=1)

    def values(self, words: list[bytes]) -> np.ndarray:
        """Kernel values (word x landmark), to the power of POWER; a word without subsequences has 0."""
        out, square = np.zeros((len(words), len(self.landmarks)), np.float32), np.zeros(len(words))
        steps = np.array((6, 8, 10, 13, 17, WINDOW))
        sizes = steps[np.searchsorted(steps, np.fromiter(map(len, words), np.int64, len(words)))]
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for begin in range(0, len(at), 1 << 13):
                some = at[begin : begin + (1 << 13)]
                sums, codes, weights = np.zeros((len(some), len(self.landmarks)), np.float32), [], []
                for u, weight in subsequences([words[i] for i in some], int(size)):
                    hit = np.flatnonzero(self.known[u])
                    sums[hit] += np.float32(weight) * self.table[u[hit]]
                    codes.append(u)
                    weights.append(weight)
                out[some], square[some] = sums, _squares(np.stack(codes, axis=1), np.array(weights))
        return (out / np.sqrt(np.maximum(square, 1e-12))[:, None].astype(np.float32)) ** POWER


@dataclass
class ToxicityModel:
    """weights of landmarks, the machine's intercept, and the logistic curve over a document's worst sentence."""

    kernel: WordKernel
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0
    parts: dict[bytes, float] = field(default_factory=dict)

    def learn(self, words: Set[bytes]) -> None:
        """Remember the parts of words, and of these alone where others beside them would be too many."""
        new = [w for w in words if w not in self.parts]
        if len(self.parts) + len(new) > REMEMBERED:
            self.parts.clear()
            new = list(words)
        cut = [(w, x) for w in new for x in windows(w)]
        self.parts.update(dict.fromkeys(new, 0.0))
        if cut:
            once = sorted({x for _, x in cut})
            value = dict(zip(once, (self.kernel.values(once).astype(np.float64) @ self.weights).tolist(), strict=True))
            for w, x in cut:
                self.parts[w] += value[x]

    def decisions(self, texts: list[str | None], block: int = 1 << 22) -> list[float]:
        """The largest decision of a sentence of each text; without any, that of an empty one."""
        out: list[float] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= block):
                size += len(texts[j] or "")
                j += 1
            split = [list(sentences(t)) for t in texts[i:j]]
            words = {w for text in split for s in text for w in s}
            if any(w not in self.parts for w in words):
                self.learn(words)
            part = self.parts.__getitem__
            out += [self.intercept + max((sum(map(part, s)) for s in text), default=0.0) for text in split]
            i = j
        return out

    def scores(self, decisions: list[float]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.clip(decisions, -CLEAR, CLEAR) + self.shift)))


def _word_labels(rows: DataFrame) -> DataFrame:
    """(word, toxic, others): toxic and other documents of rows (text, toxic) that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = Counter[bytes](), Counter[bytes]()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                counts[toxic].update({x for s in sentences(text) for w in s for x in windows(w)})
            words = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in words], pa.string()), "toxic": pa.array([counts[1][w] for w in words], pa.int64()), "others": pa.array([counts[0][w] for w in words], pa.int64())})

    out = rows.select("text", "toxic").mapInArrow(run, "word string, toxic long, others long")
    return out.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))


def choose_landmarks(rows: DataFrame, n_toxic: int, n_others: int, landmarks: int, scratch: Scratch) -> list[bytes]:
    """Two thirds of the landmarks are the words most bound to toxic documents, the others common ones that aren't, by hash."""
    counts = scratch.keep(_word_labels(rows).where(F.col("toxic") + F.col("others") >= 2))
    n = n_toxic + n_others
    share = (F.col("toxic") + F.col("others")) / n
    z = (F.col("toxic") / n_toxic - F.col("others") / n_others) / F.sqrt(share * (1 - share + 1 / n) * (1 / n_toxic + 1 / n_others))
    ranked = counts.withColumn("z", z)
    bound = [r["word"] for r in ranked.orderBy(F.desc("z"), "word").limit(2 * landmarks // 3).collect()]
    common = ranked.where(~F.col("word").isin(bound)).orderBy(F.desc(F.floor(F.log2(F.col("toxic") + F.col("others")))), F.xxhash64("word"), "word")
    return [w.encode() for w in bound + [r["word"] for r in common.limit(landmarks - len(bound)).collect()]]


def disturbed(word: bytes) -> bytes:
    """A word with one more letter within it; place and letter follow from its checksum."""
    if len(word) < ORDER + 1:
        return word
    h = zlib.crc32(word)
    at = 1 + h % (len(word) - 1)
    return word[:at] + bytes([97 + (h >> 8) % 26]) + word[at:]


def fit(rows: DataFrame, landmarks: int = LANDMARKS, disturb: bool = True) -> ToxicityModel | float:
    """A model from rows (doc_id, text, toxic 0 or 1), as labelled() bounds them; without both labels the share of toxic ones, 0 for none.

    What reaches the driver is bounded by landmarks and by two numbers for each row.
    """
    scratch = Scratch(rows.sparkSession, "toxicity")
    rows = scratch.keep(rows.select("doc_id", "text", "toxic"))
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or n_toxic in (0, n):
        return float(n_toxic / n) if n else 0.0
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    chosen = choose_landmarks(rows, n_toxic, n - n_toxic, landmarks, scratch)
    if not chosen:
        return float(n_toxic / n)
    kernel = WordKernel(chosen)
    values, vectors = np.linalg.eigh(kernel.values(chosen).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, LEAST_EIGENVALUE)) @ vectors.T  # inverse root of the landmarks' kernel matrix

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(s, t) for text, t in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True) for s in sentences(text)]
            kept += [({disturbed(w): None for w in s}, t) for s, t in kept] if disturb else []
            cut = [[x for w in s for x in windows(w)] for s, _ in kept]
            once = {x: i for i, x in enumerate(sorted({x for s in cut for x in s}))}
            value = kernel.values(list(once)).astype(np.float64) @ root if once else np.zeros((0, len(chosen)))
            for begin in range(0, len(kept), 10_000):
                sums = [value[[once[x] for x in s]].sum(axis=0) if s else np.zeros(len(chosen)) for s in cut[begin : begin + 10_000]]
                yield pa.RecordBatch.from_pydict({"label": pa.array([float(t) for _, t in kept[begin : begin + 10_000]]), "z": pa.array([x.tolist() for x in sums], pa.list_(pa.float64()))})

    trained = scratch.keep(rows.select("text", "toxic").mapInArrow(features, "label double, z array<double>"))
    machine = LinearSVC(maxIter=100, regParam=REG, standardization=False, weightCol="weight").fit(
        trained.select("label", (1 + (TOXIC_WEIGHT - 1) * F.col("label")).alias("weight"), array_to_vector("z").alias("features"))
    )
    model = ToxicityModel(kernel, root @ machine.coefficients.toArray(), float(machine.intercept))
    seen = decide(rows.select("doc_id", "text", "toxic"), model, ("toxic",)).select("decision", "toxic").toPandas()  # a row for each of rows
    model.slope, model.shift = _logistic(np.clip(seen["decision"].to_numpy(), -CLEAR, CLEAR), seen["toxic"].to_numpy(np.float64))
    scratch.drop(trained)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope, not below 0, and shift of a logistic curve, by Newton's method with a small penalty on the slope."""
    spread = max(x.std(), 1e-9)
    u = (x - x.mean()) / spread
    a, b = 1.0, float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * u).sum() + 0.1 * a, (p - y).sum()])
        h = np.array([[(w * u * u).sum() + 0.1, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    a = max(a, 0.0)
    return a / spread, b - a * float(x.mean()) / spread


def decide(docs: DataFrame, model: ToxicityModel, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, decision) of each row of docs, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield beside_ids(b, {"decision": pa.array(m.decisions(b.column("text").to_pylist()), pa.float64())}, carried=("doc_id", *carried))

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carried))
    return docs.select("doc_id", *carried, "text").mapInArrow(run, f"{kinds}, decision double")


def toxicity(docs: DataFrame, model: ToxicityModel | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from threshold on, else 0) of each row of docs.

    Whole texts are read, whatever their length; null and empty ones have the score of a text without a word. Without a
    model every score is the share that stands in its place. Extra columns and repeated ids don't matter.
    """
    if isinstance(model, float):
        rows = docs.select("doc_id", F.lit(model).alias("score"))
    else:
        at = F.greatest(F.lit(-CLEAR), F.least(F.lit(CLEAR), F.col("decision"))) * model.slope + model.shift
        rows = decide(docs, model).select("doc_id", F.round(1 / (1 + F.exp(-at)), 6).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame, trained: Column, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, toxic) of documents with a label, for the ids where trained, an expression over doc_id, holds.

    A label given twice counts as its largest, null as none. The most_labelled ids of the smallest hash are used, and
    broadcast, so that no text but theirs moves; of rows that share an id the smallest text is taken.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(trained).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).withColumnRenamed("doc_id", "__doc")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__doc"))
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
