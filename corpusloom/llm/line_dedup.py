"""Line deduplication by a segment-partition edit join.

Two lines are near copies if their edit distance is at most tau. A line of length n is cut into tau + 1 even segments;
a line within distance tau keeps one of them whole, near its place. Each distinct line puts its segments into an index
keyed by (segment number, length, segment) and probes it, for each length from n - tau to n, with the few substrings
that can meet a segment of that length (the multi-match-aware windows of the segment-partition join). A segment that very many different lines share would meet in the square of them: such lines
meet by the segments of what they hold beside it instead. Candidates whose counts of common letters differ too much for tau edits leave within the join. The rest are verified with the
edit automaton in a band of 2 tau + 1 diagonals, whose tau + 1 rows of states are packed into one long and advanced by
shifts and masks, a character a step.

Only DataFrame and SQL functions are used. Equal lines are collapsed by an aggregation that combines on the map side.
Candidates are looked up by the number of the line and verified on the lines themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fitted

#: Edits, characters from which near copies of a line are sought, and from which equal ones are in the query and pipeline.
TAU, MIN_CHARS, MIN_EQUAL = 2, 12, 1
#: Lines that share a segment from which on it is hot, the part of them that is counted, and how often rests are cut again.
HOT, SAMPLED, LEVELS = 4_096, 16, 6
#: Letters that are counted, modulo 16, into the signature of a line (fixed values; frequent in Latin scripts).
LETTERS = "etaonirslduc"
#: More letters, whose counts are compared once the lines of a pair are at hand (fixed values).
MORE_LETTERS = "mhgbpfvzkqwy.,"
#: Rows up to which the hashes of candidate lines are broadcast to fetch their text.
FETCH_ROWS = 2_000_000


def _segments(n: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each of the even segments of a line of length n; the longer ones come last."""
    base, long = F.floor(n / parts).cast("int"), n % parts
    out = []
    for i in range(parts):
        extra = F.greatest(F.lit(0), F.lit(i - parts) + long)
        out.append(((base * i + extra + 1).cast("int"), base + F.when(F.lit(i) >= F.lit(parts) - long, 1).otherwise(0)))
    return out


def _key(i: int, n: Column, piece: Column, *before: Column) -> Column:
    return F.xxhash64(F.lit(i), n, piece, *before)


def _index_places(line: Column, n: Column, tau: int, *before: Column) -> Column:
    """(key, at, k) of the tau + 1 segments of a line of length n; n is best a stored column, as it is used again and again.

    before goes into the keys: only lines that agree in it can meet.
    """
    places = [F.struct(_key(i, n, F.substring(line, s, k), *before).alias("key"), s.alias("at"), k.alias("k")) for i, (s, k) in enumerate(_segments(n, tau + 1))]
    return F.array(*places)


def _probes(line: Column, n: Column, tau: int, gap: int, own: bool, *before: Column) -> list[tuple[Column, Column, Column, Column]]:
    """Whether it fits, key, at and k of each substring of a line of length n that can meet a segment of a line gap characters shorter.

    Those that stand where a segment of a line of equal length stands are index keys, and left out unless own is set.
    """
    out, m = [], n - gap
    for i, (s, k) in enumerate(_segments(m, tau + 1)):
        low, high = max(-i, gap - (tau - i)), min(i, gap + (tau - i))
        for off in range(low, high + 1):
            if not own and not gap and not off:
                continue
            at = s + off
            out.append(((at >= 1) & (at + k - 1 <= n), _key(i, m, F.substring(line, at, k), *before), at, k))
    return out


def _probe_places(line: Column, n: Column, tau: int, gap: int, own: bool, *before: Column) -> list[Column]:
    """(key, gap, at, k) of these, null where one doesn't fit."""
    return [
        F.when((n >= gap) & fits, F.struct(key.alias("key"), F.lit(gap).alias("gap"), at.alias("at"), k.alias("k")))
        for fits, key, at, k in _probes(line, n, tau, gap, own, *before)
    ]


def index_keys(line: Column, n: Column, tau: int) -> Column:
    """Keys of the tau + 1 segments of a line of length n."""
    return F.array(*[_key(i, n, F.substring(line, s, k)) for i, (s, k) in enumerate(_segments(n, tau + 1))])


def probe_keys(line: Column, n: Column, tau: int) -> Column:
    """(key, gap) of the substrings of a line that can meet a segment of a line gap = 0 to tau characters shorter.

    Each is one plain case, so that its substring and hash are worked out once.
    """
    probes = [(gap, fits, key) for gap in range(tau + 1) for fits, key, _, _ in _probes(line, n, tau, gap, False)]
    return F.array_distinct(F.array_compact(F.array(*[F.when(fits, F.struct(key.alias("key"), F.lit(gap).alias("gap"))) for gap, fits, key in probes])))


def _count(line: Column, letter: str) -> Column:
    """How often an ASCII letter stands in a line, by bytes."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter)))


def signature(line: Column) -> Column:
    """Counts of LETTERS modulo 16, four bits each."""
    parts = [F.shiftleft((_count(line, c) % 16).cast("long"), 4 * i) for i, c in enumerate(LETTERS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def signatures_near(a: Column, b: Column, tau: int) -> Column:
    """Whether the counts allow tau edits: an edit takes one letter away and adds one at most."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        d = F.abs(F.shiftrightunsigned(a, 4 * i).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * i).bitwiseAND(F.lit(15)))
        total = total + F.least(d, F.lit(16) - d)
    return total <= 2 * tau


def banded_distance(a: str, b: str, tau: int) -> Column:
    """SQL on string columns a and b: their edit distance if it is at most tau (0 to 4), else null.

    Bit k of row d says that d edits turn the first j + k - tau characters of a into the first j of b. For the next
    character, row d is: kept where the characters agree, or row d - 1 for a substitution, shifted right for an
    insertion, or the new row d - 1 shifted left for a deletion. A null in a or b gives null.
    """
    w = 2 * tau + 1
    full = (1 << w) - 1
    start = sum(sum(1 << (tau + i) for i in range(d + 1)) << (w * d) for d in range(tau + 1))
    match = " | ".join(f"IF(get(A, j - {tau} + {k} - 1) = get(B, j - 1), {1 << k}L, 0L)" for k in range(w))
    # rows in turn as fields of nested lambdas would be slow; each is written out in the old long s and the mask m
    new, rows = "", []
    for d in range(tau + 1):
        old = f"(shiftright(s, {w * d}) & {full}L)"
        row = f"({old} & m)"
        if d:
            below = f"(shiftright(s, {w * (d - 1)}) & {full}L)"
            row = f"(({row} | {below} | shiftright({below}, 1) | shiftleft({rows[-1]}, 1)) & {full}L)"
        rows.append(row)
        new += (" | " if d else "") + f"shiftleft({row}, {w * d})"
    step = f"element_at(transform(array({match}), m -> {new}), 1)"
    arrays = f"named_struct('a', split({a}, ''), 'b', split({b}, ''))"
    step = step.replace("get(A, ", "get(x.a, ").replace("get(B, ", "get(x.b, ")
    walk = f"aggregate(sequence(1, greatest(length({b}), 1)), {start}L, (s, j) -> IF(j > length({b}), s, {step}))"
    last = f"({tau} + length({a}) - length({b}))"
    ends = " ".join(f"WHEN (shiftright(s, {w * d} + {last}) & 1L) = 1L THEN {d}" for d in range(tau + 1))
    body = f"element_at(transform(array({arrays}), x -> element_at(transform(array({walk}), s -> CASE {ends} END), 1)), 1)"
    return F.expr(f"CASE WHEN abs(length({a}) - length({b})) <= {tau} THEN {body} END")


def hot_keys(keyed: DataFrame, hot: int, scratch: Scratch) -> DataFrame | None:
    """Keys of keyed (key, id) that about hot lines share, or more; None if there are none.

    They are counted in the lines whose number has one hash in SAMPLED, as it decides how pairs are found, not which.
    """
    every = max(1, min(SAMPLED, hot // 64))
    counts = keyed.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = scratch.keep(counts.where(F.col("n") >= hot // every).select(F.col("key").alias("hot")))
    return None if found.isEmpty() else found


def _cold(keyed: DataFrame, hot: DataFrame | None) -> DataFrame:
    return keyed if hot is None else keyed.join(fitted(hot), F.col("key") == F.col("hot"), "left_anti")


def _rests(placed: DataFrame, hot: DataFrame, scratch: Scratch) -> DataFrame:
    """placed (key, at, k, line, ...) at hot keys, with what is left of the line beside its segment, and its length."""
    rest = F.concat(F.expr("substring(line, 1, at - 1)"), F.expr("substring(line, at + k)"))
    rows = placed.join(fitted(hot), F.col("key") == F.col("hot"), "left_semi").withColumn("line", rest).drop("at", "k")
    return scratch.keep(rows.withColumn("n", F.length("line")).withColumnRenamed("key", "before"))


def _pairs_at_hot_keys(index: DataFrame, probe: DataFrame, tau: int, hot: int, scratch: Scratch) -> list[DataFrame]:
    """Candidates (ia, ib) of index (before, line, n, id, sig) and probe, with gap also, lines being what is left.

    Lines that agree in a segment and are within tau edits are so in what is left beside it. The rests are cut into
    tau + 1 segments in their turn, and meet where they agree in one of these too; rests at keys which are hot again
    go on, up to LEVELS times.
    """
    out = []
    for level in range(LEVELS):
        at = index.select("id", "sig", "line", F.explode(_index_places(F.col("line"), F.col("n"), tau, F.col("before"))).alias("p"))
        at = at.select("id", "sig", "line", "p.*")
        places = [F.when(F.col("gap") == g, p) for g in range(tau + 1) for p in _probe_places(F.col("line"), F.col("n"), tau, g, True, F.col("before"))]
        by = probe.select("id", "sig", "line", F.explode(F.array_distinct(F.array_compact(F.array(*places)))).alias("p"))
        by = by.select("id", "sig", "line", "p.*")
        again = hot_keys(at, hot, scratch) if level < LEVELS - 1 else None
        r, s = _cold(at.select("key", "id", "sig"), again).alias("r"), _cold(by.select("key", "gap", "id", "sig"), again).alias("s")
        on = (F.col("r.key") == F.col("s.key")) & signatures_near(F.col("r.sig"), F.col("s.sig"), tau) & ((F.col("s.gap") > 0) | (F.col("r.id") < F.col("s.id")))
        out.append(r.join(s, on).select(F.col("r.id").alias("ia"), F.col("s.id").alias("ib")))
        if again is None:
            break
        index, probe = _rests(at, again, scratch), _rests(by, again, scratch)
    return out


def near_lines(classes: DataFrame, tau: int, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """Pairs of distinct lines within distance tau: (first_a, first_b, distance) of classes (line, id, n, sig, first).

    The index is shuffled once and joined with itself, for segments in their own place, and with the other probes. The
    number of a line stands last in the rows, as its high bytes are those of the row before and compress away. Segments
    that about hot lines share are left out there, and met by what is beside them.
    """
    # columns that can't be null get no filters of their own in either join, so that Spark sees one and the same shuffle
    sig, number = F.coalesce("sig", F.lit(0)).cast("long").alias("sig"), F.coalesce("id", F.lit(0)).cast("long").alias("id")
    line, n = F.col("line"), F.col("n")
    index = classes.select(F.explode(index_keys(line, n, tau)).alias("key"), sig, number)
    probe = classes.select("id", "sig", F.explode(probe_keys(line, n, tau)).alias("p"))
    # equal keys stand for lengths that differ by the gap, which travels above the signature
    gap_at = 4 * len(LETTERS)
    probe = probe.select("p.key", F.col("sig").bitwiseOR(F.shiftleft(F.col("p.gap").cast("long"), gap_at)).alias("sig"), "id")
    often = hot_keys(index, hot, scratch)
    found = []
    if often is not None:
        at = classes.select("id", "sig", "line", F.explode(_index_places(line, n, tau)).alias("p")).select("id", "sig", "line", "p.*")
        places = F.array(*[p for g in range(tau + 1) for p in _probe_places(line, n, tau, g, True)])
        by = classes.select("id", "sig", "line", F.explode(F.array_distinct(F.array_compact(places))).alias("p")).select("id", "sig", "line", "p.*")
        found = _pairs_at_hot_keys(_rests(at, often, scratch), _rests(by, often, scratch), tau, hot, scratch)
        index, probe = _cold(index, often), _cold(probe, often)
    # of two lines of equal length, the one with the larger number probes
    on = (F.col("r.key") == F.col("s.key")) & signatures_near(F.col("r.sig"), F.col("s.sig"), tau)
    later = F.col("r.id") < F.col("s.id")
    ends = [F.col("r.id").alias("ia"), F.col("s.id").alias("ib")]
    same = index.alias("r").join(index.alias("s"), on & later).select(*ends)
    moved = index.alias("r").join(probe.alias("s"), on & ((F.shiftright("s.sig", gap_at) > 0) | later)).select(*ends)
    for more in found:
        moved = moved.union(more)
    pairs = scratch.keep(same.union(moved).distinct())
    wanted = scratch.keep(pairs.select(F.col("ia").alias("id")).union(pairs.select("ib")).distinct())
    lines = scratch.keep(classes.join(fitted(wanted, FETCH_ROWS), "id", "left_semi"))
    a = lines.select(F.col("id").alias("ia"), F.col("line").alias("line_a"), F.col("first").alias("first_a"))
    b = lines.select(F.col("id").alias("ib"), F.col("line").alias("line_b"), F.col("first").alias("first_b"))
    both = pairs.join(a, "ia").join(b, "ib")
    gaps = [F.abs(_count(F.col("line_a"), c) - _count(F.col("line_b"), c)) for c in MORE_LETTERS]
    may = sum(gaps[1:], gaps[0]) <= 2 * tau
    return both.withColumn("distance", F.when(may, banded_distance("line_a", "line_b", tau))).where("distance is not null").select("first_a", "first_b", "distance")


def line_decisions(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, min_equal: int | None = None, hot: int = HOT) -> DataFrame:
    """A row for each doc_id with text: doc_id, n_lines, n_removed, kept (positions from 0 of the lines looked at that stay).

    Lines are what newlines separate. A line of min_chars characters and more goes if a line equal to it, or within
    tau edits of it, stands earlier in the corpus, by (doc_id, position), whether or not that earlier line itself stays.
    A line of min_equal characters up to that (by default none) goes if a line equal to it stands earlier: two edits can
    make any word of three letters. Lines under both always stay, as do empty ones where min_equal is above 0. A null text gives no row; a null doc_id comes before all others
    and its rows count as one document, as do rows that share a doc_id: their lines at equal positions stand equally
    early. min_chars is at least tau + 1.
    """
    if min_chars < tau + 1 or not 0 <= tau <= 4:
        raise ValueError("tau must be 0 to 4, and min_chars above tau")
    looked_at = min_chars if min_equal is None else min(min_equal, min_chars)
    scratch = Scratch(docs.sparkSession, "lines")
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    classes = lines.where(F.length("line") >= looked_at).groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    # numbers are stored with the lines, so a task that runs again can't give others
    classes = scratch.keep(classes.select("line", F.monotonically_increasing_id().alias("id"), F.length("line").alias("n"), signature(F.col("line")).alias("sig"), "first"))
    scratch.release()
    near = near_lines(classes.where(F.col("n") >= min_chars), tau, scratch, hot)
    # the later of two near lines goes; the same first place in two lines is possible only where rows share a doc_id
    late = scratch.keep(near.where("first_a <> first_b").select(F.greatest("first_a", "first_b").alias("first")).distinct())
    stay = classes.select("first").distinct().join(fitted(late, FETCH_ROWS), "first", "left_anti")
    stay = stay.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.sort_array(F.collect_list("first.pos")).alias("kept"))
    count = F.size(F.split("text", "\n", -1))
    n_looked = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= looked_at))
    per_doc = docs.where("text is not null").groupBy("doc_id").agg(F.sum(count).alias("n_lines"), F.sum(n_looked).alias("n_looked"))
    out = per_doc.alias("d").join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    kept = F.coalesce("s.kept", F.array().cast("array<int>"))
    return out.select("d.doc_id", F.col("n_lines").cast("long"), (F.col("n_looked") - F.size(kept)).cast("long").alias("n_removed"), kept.alias("kept"))


def line_dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, drop_empty: bool = True, min_equal: int | None = None) -> DataFrame:
    """docs without the lines that line_decisions() removes; its other columns are as they were.

    A document that loses all its lines, or has none but empty ones left, goes if drop_empty and any of its lines was
    removed; a document that had no text to begin with stays. n_chars, if there is such a column, is counted anew.
    """
    looked_at = min_chars if min_equal is None else min(min_equal, min_chars)
    d = line_decisions(docs, tau, min_chars, min_equal).where("n_removed > 0").select(F.col("doc_id").alias("__doc"), F.col("kept").alias("__kept"))
    d = Scratch(docs.sparkSession, "kept").keep(d)
    rows = docs.join(fitted(d), F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: (F.length(x) < looked_at) | F.array_contains(F.col("__kept"), i))
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    rows = rows.withColumn("__text", text)
    if drop_empty:
        rows = rows.where(F.col("__kept").isNull() | (F.length(F.trim(F.regexp_replace("__text", r"\s+", " "))) > 0))
    put = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[put.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
