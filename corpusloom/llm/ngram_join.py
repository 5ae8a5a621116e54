"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the distinct 5-word shingles of its whole text, as 64-bit hashes. All sets are sorted by one
global order, rare shingles first. If two sets overlap by ``t``, their prefixes of ``size - t + l`` shingles share at
least ``l`` of them. Each document chooses its own ``l`` by the estimated cost of its candidates: a longer prefix is
read more, but asks for more shared shingles before a pair is verified. A pair is held to the smaller of its two ``l``.

The global order comes from a table of BUCKETS counters for hashed shingles, summed over all documents: its size is
fixed, so it can be sent to all tasks, and any order gives right results. Equal sets are one class from the start.

The count of shared prefix shingles also bounds the overlap: what is left of either set after its prefix is all that can
be added. So a pair is asked for ``t_xy - rest`` of them, with t_xy the overlap that its two sizes need, and a class that
has fewer prefix shingles in common with any other than a pair asks for can't be in it.

A shingle that many classes share would bring a square of pairs. So each of HUB_ROUNDS rounds pairs every class with one
class of each of its shingles, the hub, verifies the pairs that may link, and merges what links. The first hubs are the
classes with the least of their own, as the original of many near copies is. Only pairs whose ends are still in
different components matter afterwards; all of them are counted, held to what they are asked for, and verified. Links
within a component, which would change no result, are the only ones left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, beside_ids, components, fitted

SHINGLE, PERCENT = 5, 80
#: Counters of the table of shingle frequencies, and the largest l.
BUCKETS, MOST_MATCHES = 1 << 17, 4
#: Cost of verifying one pair, in reads of a prefix entry, for each shingle of the document.
VERIFY_COST = 0.2
#: Rounds of hubs before all remaining pairs are looked at.
HUB_ROUNDS = 2
#: Ids up to which those of candidates are broadcast to fetch their text.
FETCH_ROWS = 2_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes of texts."""

    def __init__(self, k: int = SHINGLE):
        self.k = k

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the k-word shingles of text; of the whole sequence if it has fewer words."""
        from xxhash import xxh3_64_digest as digest

        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        hashed, k = np.frombuffer(b"".join(map(digest, words)), np.uint64), min(len(words), self.k)
        n = len(words) - k + 1
        total = np.full(n, np.uint64(k))
        for i in range(k):
            total += hashed[i : i + n] * (_ODD[i % 5] + np.uint64(2 * (i // 5)))
        # sorting and comparing neighbours takes a tenth of the time of np.unique
        total = _mix(total)
        total.sort()
        return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), np.concatenate([*parts, np.empty(0, np.int64)]))


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Counts of shingles over all documents by BUCKETS hashed counters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, total, held, n = Shingler(), np.zeros(BUCKETS, np.int64), [], 0
        for b in batches:
            for text in b["text"]:
                held.append(_bucket(shingles(text)))
                n += len(held[-1])
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
        total += np.bincount(np.concatenate([*held, np.empty(0, np.int64)]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    counts = docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)  # at most BUCKETS rows come to the driver
    out[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return out


def prefix_of(h: np.ndarray, extra: np.ndarray, percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """(l, prefix) of a set: extra are the estimated numbers of other sets for each counter."""
    n = len(h)
    least = -(-percent * n // 100)
    df = extra[_bucket(h)]
    rank = np.lexsort((h, np.frexp(df)[1]))
    most = min(MOST_MATCHES, least)
    reads = np.cumsum(df[rank])
    best, chosen = None, 1
    for m in range(1, most + 1):
        load = float(reads[min(n, n - least + m) - 1])
        cost = load + VERIFY_COST * n * load / (m * m)
        if best is None or cost < 0.9 * best:
            best, chosen = cost, m
    return chosen, h[rank[: n - least + chosen]]


def signatures(docs: DataFrame, counts: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n, class, matches, prefix) of each row: class is a 128-bit digest of the set, null if it is empty."""
    used = counts[counts > 0]
    usual = float(np.median(used)) if len(used) else 0.0
    sent = docs.sparkSession.sparkContext.broadcast(np.maximum(0.0, counts - usual - 3 * np.sqrt(usual + 1)).astype(np.float32))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingles, extra = Shingler(), sent.value
        for b in batches:
            n, cls, ms, prefixes = [], [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text)
                m, p = prefix_of(h, extra, percent) if len(h) else (0, h)
                n.append(len(h))
                cls.append(xxh3_128_digest(h.tobytes()) if len(h) else None)
                ms.append(m)
                prefixes.append(p.view(np.int64))
            yield beside_ids(b, {"n": pa.array(n, pa.int64()), "class": pa.array(cls, pa.binary()), "matches": pa.array(ms, pa.int32()), "prefix": _lists(prefixes)}, carried=("doc_id", "key"))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(), "text").mapInArrow(sign, f"doc_id {kind}, key long, n long, class binary, matches int, prefix array<long>")


def text_key() -> Column:
    """Tells the text of a row apart where doc_id is null or repeated."""
    return F.xxhash64("text").alias("key")


def same_row(x: str, y: str) -> Column:
    """Whether rows of x and y have the same doc_id, null included, and the same text."""
    return F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.key") == F.col(f"{y}.key"))


def class_sets(docs: DataFrame, wanted: DataFrame, repeated: bool = True) -> DataFrame:
    """(cid, set) of the wanted classes (doc_id, key, cid), from the whole text of one row of each.

    repeated: whether rows may share doc_id and key; one of them is taken then.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for b in batches:
            yield beside_ids(b, {"set": _lists([shingles(t).view(np.int64) for t in b.column("text").to_pylist()])}, carried=("cid",))

    rows = docs.select("doc_id", text_key(), "text").alias("d").join(fitted(wanted, FETCH_ROWS).alias("w"), same_row("d", "w")).select("w.cid", "d.text")
    if repeated:
        rows = rows.groupBy("cid").agg(F.min("text").alias("text"))
    return rows.mapInArrow(sets, "cid long, set array<long>")


def _asked(x: str, y: str, percent: int) -> str:
    """Prefix shingles that classes x and y must share if they link."""
    return f"(({percent}L * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent} - greatest({x}.rest, {y}.rest))"


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes, counts and marks of shared prefix shingles let two classes of different components link.

    A mark that one class has and the other hasn't stands for a shingle at least that they don't share.
    """
    size = f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
    most = lambda a, b: f"{a}.common - bit_count({a}.m0 & ~{b}.m0) - bit_count({a}.m1 & ~{b}.m1)"
    return F.expr(f"{x}.label <> {y}.label and {size} and least({most(x, y)}, {most(y, x)}) >= greatest(least({x}.matches, {y}.matches), {_asked(x, y, percent)})")


def ngram_jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id.

    docs needs doc_id (an integer, unique; rows that share one should share the text) and text. A-Z is lower-cased, words
    are runs of anything but ASCII white space. Two documents link when 100 * overlap >= percent * union of their sets;
    component_id is the smallest doc_id reachable by links, itself included. A document without words or text has no
    set and links with nothing. A null doc_id is its own component only if nothing with an id links with it.
    """
    groups = jaccard_groups(docs, percent)
    return groups.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: of its smallest doc_id, null only where all are. Rows without words all stay."""
    scratch = Scratch(docs.sparkSession, "unique")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    rows = scratch.keep(jaccard_groups(docs, percent).where("label is not null").groupBy("label", "doc_id", "key").agg(F.count(F.lit(1)).alias("times")))
    best = rows.groupBy("label").agg(first).select(F.col("label").alias("of"), "first.doc_id", "first.key")
    rows = rows.alias("r").join(best.alias("b"), (F.col("r.label") == F.col("b.of")) & same_row("r", "b"), "left")
    # rows that go, and those of which one stays
    rows = scratch.keep(rows.select("r.doc_id", "r.key", F.col("of").isNotNull().alias("best"), "times").where("not best or times > 1"))
    keyed = docs.select("doc_id", text_key(), F.struct(*docs.columns).alias("row")).alias("d")
    out = keyed.join(fitted(rows).alias("r"), same_row("d", "r"), "left_anti").select("row.*")
    again = rows.where("best")
    if again.limit(1).count():
        again = keyed.join(fitted(again).alias("r"), same_row("d", "r"), "left_semi")
        out = out.union(again.groupBy("doc_id", "key").agg(F.min("row").alias("row")).select("row.*"))
    return out


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, key, n_shingles, label, component_id.

    Rows of one component have one label, null without words; component_id is the smallest doc_id, null if all are null.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    sig = scratch.keep(signatures(docs, shingle_counts(docs), percent))
    salt = 0
    while True:  # a class is a long from here on; another salt if ever two classes should get the same
        cid = F.xxhash64("class", F.lit(salt))
        by = sig.where("class is not null").groupBy(cid.alias("cid"))
        classes = by.agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("row"), F.min("n").alias("n"), F.min("matches").alias("matches"),
            F.min(F.col("n") - F.size("prefix")).alias("rest"), F.min("class").alias("lo"), F.max("class").alias("hi"),
        )
        classes = scratch.keep(classes.select("cid", "row.doc_id", "row.key", *classes.columns[2:]))
        if not classes.where("lo <> hi").limit(1).count():
            break
        salt += 1
    sig = sig.withColumn("cid", F.when(F.col("class").isNotNull(), cid))
    entries = sig.select(F.explode("prefix").alias("h"), "cid").repartition("h").distinct()
    of = Window.partitionBy("h")
    entries = scratch.keep(entries.where("cid is not null").withColumn("lo", F.min("cid").over(of)).withColumn("hi", F.max("cid").over(of)).where("lo <> hi").select("h", "cid"))
    # the prefixes are most of what was kept, and are in entries now
    long, sig = sig, scratch.keep(sig.select("doc_id", "key", "n", "cid"))
    scratch.drop(long)
    repeated = bool(sig.where("cid is not null").groupBy("doc_id", "key").count().where("count > 1").limit(1).count())
    # common: prefix shingles that a class shares with any other; m0 and m1: 128 marks, one set for each of these
    marks = [F.expr(f"bit_or(if(h >> 6 & 1 = {i}, shiftleft(1L, cast(h & 63 as int)), 0L))").alias(f"m{i}") for i in range(2)]
    info = entries.groupBy("cid").agg(F.count(F.lit(1)).cast("int").alias("common"), *marks)
    info = info.join(classes, "cid").select("cid", F.col("n").cast("int"), "matches", F.col("rest").cast("int"), "common", "m0", "m1")
    plain, entries = entries, scratch.keep(entries.join(info, "cid"))
    del info  # what holds a plan holds its shuffle files
    scratch.drop(plain)
    scratch.release()
    labels, tested = None, None  # (cid, label) of the classes that have links; pairs that were verified
    for turn in range(HUB_ROUNDS + 1):
        now = _labelled(entries, labels)
        parts = now.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
        now = scratch.keep(now.join(parts, "h"))
        pairs = _with_hubs(now, turn, percent) if turn < HUB_ROUNDS else _all_pairs(now, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        scratch.drop(now)
        del now, parts
        scratch.release()
        tested = pairs if tested is None else tested.union(pairs)
        labels = _merge(labels, _linked(docs, classes, pairs, percent, scratch, repeated), scratch)
        scratch.release()
    named = classes.select("cid", "doc_id")
    if labels is not None:
        named = named.join(labels, "cid", "left").select("cid", "doc_id", F.coalesce("label", "cid").alias("label"))
        named = scratch.keep(named)
        smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = named.join(smallest, "label").select("cid", "label", "component_id")
    else:
        named = named.select("cid", F.col("cid").alias("label"), F.col("doc_id").alias("component_id"))
    return sig.withColumnRenamed("n", "n_shingles").join(named, "cid", "left").select("doc_id", "key", "n_shingles", "label", "component_id")


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("label", F.col("cid"))
    return entries.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _merge(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """labels (cid, label) after links (a, b) between classes."""
    if not links.limit(1).count():
        return labels
    if labels is None:
        return scratch.keep(components(links, scratch).withColumnRenamed("node", "cid"))
    at = [links.select("a", "b").join(labels.withColumnsRenamed({"cid": x, "label": f"l{x}"}), x, "left").select("a", "b", F.coalesce(f"l{x}", x).alias(f"l{x}")) for x in "ab"]
    between = at[0].join(at[1], ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b")
    roots = scratch.keep(components(between, scratch))
    old = labels.join(roots.withColumnRenamed("node", "l").withColumnRenamed("label", "root").withColumnRenamed("l", "label"), "label", "left")
    old = old.select("cid", F.coalesce("root", "label").alias("label"))
    new = roots.select(F.col("node").alias("cid"), "label").join(labels, "cid", "left_anti")
    return scratch.keep(old.union(new))


def _with_hubs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a class and the hub of one of its shingles that may link."""
    own = F.col("n") - F.col("rest") - F.col("common") if turn == 0 else F.lit(0)
    best = F.struct((own / F.col("n")).alias("own"), F.xxhash64("cid", F.lit(turn)).alias("o"), *[F.col(c) for c in ("cid", "label", "n", "matches", "rest", "common", "m0", "m1")])
    hubs = entries.groupBy("h").agg(F.min(best).alias("y"))
    star = entries.alias("x").join(hubs, "h").where(_may_link("x", "y", percent))
    return star.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def _all_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes in different components that share as many prefix shingles as they are asked for."""
    x, y = entries.alias("x"), entries.alias("y")
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.cid") < F.col("y.cid")) & _may_link("x", "y", percent))
    asked = F.expr(f"greatest(least(x.matches, y.matches), {_asked('x', 'y', percent)})")
    met = met.groupBy(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(asked).alias("asked"))
    return met.where("shared >= asked").select("a", "b")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch, repeated: bool) -> DataFrame:
    """The pairs that link, by their whole sets."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = scratch.keep(classes.select("doc_id", "key", "cid").join(ids, "cid", "left_semi"))
    sets = class_sets(docs, wanted, repeated)  # made again for each side: cheaper than the disk for a table of sets
    a = sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")).join(fitted(pairs), "a")
    both = a.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
    found = scratch.keep(both.where(f"100 * i >= {percent} * (s - i)").select("a", "b"))
    scratch.drop(wanted)
    del sets, a, both
    scratch.release()
    return found
