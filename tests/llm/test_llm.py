"""Training-data operators against brute force, exact round trips, held-out accuracy and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, exact_dedup, html_text, language_id, license_scan, line_dedup, media, mixing, ngram_join, packing, quality, queries

EDGE = [
    (1, None, None, "s0"), (2, "", "en", None), (3, "same text here", "en", "s1"), (4, "same text here", None, "s1"), (4, "same text here", None, "s1"),
    (None, "no id", "fr", None), (5, "word " * 30_000, "en", "s2"), (6, "  \n\t ", "de", "s2"), (7, "é\x00ü 😀\nline two of it\nline two of it", "fr", "s0"),
]


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("label", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels_of(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 0), (6, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "license": lambda s, d: license_scan.license_scan(d),
    "language": lambda s, d: language_id.identify(d, language_id.fit(d, F.lit(True), F.lit(True))),
    "quality": lambda s, d: quality.importance_sample(d, labels_of(s)),
    "quality_filter": lambda s, d: quality.quality_filter(d, labels_of(s)),
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "packing": lambda s, d: packing.pack_documents(d, queries.tokenizer_path()),
    "jaccard": lambda s, d: ngram_join.ngram_jaccard_join(d),
    "mixing": lambda s, d: mixing.in_training_order(mixing.curriculum_mix(d)),
    "mixed": lambda s, d: mixing.mixed_documents(d),
    "lines": lambda s, d: line_dedup.line_decisions(d),
    "line_dedup": lambda s, d: line_dedup.line_dedup(d),
    "media": lambda s, d: media.media_digests(media.store_texts(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases(spark, name):
    n = OPERATORS[name](spark, frame(spark, EDGE)).count()
    if name in ("language", "quality", "exact", "jaccard", "mixing", "media"):
        assert n == len(EDGE)
    assert OPERATORS[name](spark, frame(spark, EDGE).limit(0)).count() == 0


# exact deduplication


def test_exact_dedup_of_long_and_near_texts(spark):
    base = "x" * 100_000
    rows = [(1, base), (2, base), (3, base[:-1] + "y"), (4, base + "z"), (5, None), (6, ""), (7, "x" * 64), (8, "x" * 64), (9, "x" * 65)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_with_wide_digits(spark, monkeypatch):
    base = "ab" * 40_000
    rows = [(1, base), (2, base), (3, base[:-1] + "x"), (4, base[:-1] + "x"), (5, base[1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df, first_digit=2, widen=1 << 15).collect()} == {1: 2, 2: 2, 3: 4, 4: 4, 5: 5}
    monkeypatch.setattr(exact_dedup, "fitted", lambda g: common.fitted(g, most_bytes=0))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()} == {1: (2, 2), 2: (2, 2), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


# line deduplication


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rng, s, n, letters="abcdé "):
    s = list(s)
    for _ in range(n):
        i, k = rng.randrange(len(s) + 1), rng.random()
        if k < 0.4:
            s.insert(i, rng.choice(letters))
        elif i < len(s):
            s[i : i + 1] = [] if k < 0.7 else [rng.choice(letters)]
    return "".join(s)


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_banded_distance(spark, tau):
    rng = random.Random(tau)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(14)))
        pairs.append((a, changed(rng, a, rng.randrange(5))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.banded_distance("a", "b", tau).alias("d")).collect()
    for r in got:
        d = edit_distance(r.a, r.b)
        assert r.d == (d if d <= tau else None)


@pytest.mark.parametrize("tau", [1, 2])
def test_line_decisions_against_brute_force(spark, tau):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(3, 30))) for _ in range(12)]
    rows = [(i, "\n".join(changed(rng, rng.choice(bases), rng.randrange(4)) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    got = {r.doc_id: r for r in line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string"), tau, 8).collect()}
    seen = []
    for i, text in rows:
        kept, removed = [], 0
        for pos, line in enumerate(text.split("\n")):
            if len(line) >= 8:
                if any(abs(len(x) - len(line)) <= tau and edit_distance(x, line) <= tau for x in seen):
                    removed += 1
                else:
                    kept.append(pos)
                seen.append(line)
        assert (got[i].kept, got[i].n_removed, got[i].n_lines) == (kept, removed, text.count("\n") + 1)


@pytest.mark.parametrize(("tau", "hot"), [(1, 3), (2, 20)])
def test_lines_with_hot_segments(spark, tau, hot):
    """Forms that differ in few places share nearly all their segments; every rest is cut again, down to short ones."""
    rng = random.Random(tau)
    form = lambda: f"posted by user {rng.randrange(400):0{rng.choice((3, 4))}d} on day {rng.randrange(30)}"
    kinds = [form, lambda: changed(rng, form(), 2), lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(4, 12))), lambda: rng.choice(["}", "", "ok", "no"])]
    rows = [(i, "\n".join(rng.choice(kinds)() for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, seen = {}, []
    for i, text in rows:
        kept = []
        for pos, line in enumerate(text.split("\n")):
            near = tau if len(line) >= 4 else 0
            if line and not any(x == line or (near and len(x) >= 4 and abs(len(x) - len(line)) <= near and edit_distance(x, line) <= near) for x in seen):
                kept.append(pos)
            seen.append(line)
        want[i] = kept
    assert {r.doc_id: r.kept for r in line_dedup.line_decisions(df, tau, 4, 1, hot).collect()} == want


def test_short_lines(spark):
    rows = [(1, "a\nb\n\na"), (2, "b\nab\n\nac"), (None, "ac\nx"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.line_decisions(df, min_equal=1).collect()}
    assert got == {None: (2, 0, [0, 1]), 1: (4, 1, [0, 1]), 2: (4, 2, [1]), 3: (1, 0, [])}
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df, min_equal=1).collect()} == {None: "ac\nx", 1: "a\nb\n", 2: "ab\n", 3: ""}


# n-gram Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c d e")]
    shared = " ".join(rng.choice(words) for _ in range(30))
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(6, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = [rng.choice(words) if rng.random() < 0.03 else w for w in base]
            rows.append((len(rows), (shared + " " if rng.random() < 0.4 else "") + " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_with_null_and_repeated_ids(spark):
    from collections import Counter

    text = " ".join(f"v{i}" for i in range(60))
    steps = [" ".join(f"{w}x" if k and i < 4 or k > 1 and i > 55 else w for i, w in enumerate(text.split())) for k in range(3)]  # each links with the next
    rows = [(7, steps[0]), (None, steps[1]), (5, steps[2])]  # joined through a null id
    rows += [(None, f"{text.upper().replace('V', 'u')} {t}") for t in ("q", "r", "q")] + [(9, "same words here")] * 3 + [(None, "same words here")] * 2
    rows += [(3, "lone"), (None, "other"), (None, None), (4, ""), (4, "")]
    found = brute_components([(i, t) for i, (_, t) in enumerate(rows)])
    least, groups = {}, {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(found[i][1], []).append(i)
        least[found[i][1]] = min((x for x in (least.get(found[i][1]), d) if x is not None), default=None)
    assert sorted(len(g) for g in groups.values())[-3:] == [3, 3, 5]
    docs = frame(spark, [(d, t, "en", "s") for d, t in rows])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs).collect())
    assert got == Counter((d, found[i][0], least[found[i][1]]) for i, (d, _) in enumerate(rows))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in kept.collect())
    assert kept.total() == len(groups)
    for g in groups.values():
        assert sum(kept[rows[i]] > 0 for i in {rows[j]: j for j in g}.values()) == 1
        assert any(kept[rows[i]] for i in g if rows[i][0] == least[found[g[0]][1]])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in common.components(df, common.Scratch(spark, "test")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


# packing


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack_documents(docs, queries.tokenizer_path()).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, part in got.groupby("doc_id"):
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        part = part.sort_values("piece")
        assert part["length"].sum() == len(ids)
        for r in part.itertuples():
            assert r.start == 2048 * r.piece and r.length == min(2048, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == (seq["length"].cumsum() - seq["length"]).tolist() and seq["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.01 * -(-got["length"].sum() // 2048) + 1


def fewest_by_force(sizes, capacity):
    """Bins that sizes need, by (bins, filling of the last) over all subsets."""
    best = [(0, 0)] + [(99, 0)] * ((1 << len(sizes)) - 1)
    for m in range(1, len(best)):
        for i, s in enumerate(sizes):
            if m >> i & 1:
                bins, used = best[m ^ 1 << i]
                new = (bins, used + s) if bins and used + s <= capacity else (bins + 1, s)
                best[m] = min(best[m], new)
    return best[-1][0]


def test_bin_completion_reaches_the_optimum():
    sizes = [6, 6, 5, 5, 4, 4] * 3  # capacity 15: 6 + 5 + 4 fills each bin, best fit takes more
    assert len(packing.pack(sizes, 15)) == 6 < len(packing.best_fit(sizes, 15))
    rng, better = random.Random(1), 0
    for _ in range(300):
        capacity = rng.choice([10, 15, 20, 50, 100])
        s = [rng.randrange(1, capacity // rng.choice([1, 2, 3]) + 1) for _ in range(rng.randrange(1, 12))]
        bins = packing.pack(s, capacity)
        assert sorted(x for b in bins for x in b) == sorted(s) and all(sum(b) <= capacity for b in bins)
        assert len(bins) == fewest_by_force(s, capacity) >= packing.fewest_bins(np.bincount(s, minlength=capacity + 1), capacity)
        better += len(bins) < len(packing.best_fit(s, capacity))
    assert better
    assert packing.pack([], 10) == [] and packing.pack([3, 3], 10, effort=0) == [[3, 3]]


def test_fillings_are_the_undominated_ones():
    """By force: a filling is dominated if one that is left over could stand for a part of it."""
    from itertools import combinations

    rng = random.Random(3)
    for t in range(150):
        free = 10 if not t else rng.randrange(1, 25)
        items = [5, 4, 4, 3, 3, 2, 2] if not t else [rng.randrange(1, 14) for _ in range(rng.randrange(8))]
        left = [items.count(s) for s in range(30)]
        want = set()
        for n in range(len(items) + 1):
            for take in combinations(range(len(items)), n):
                f, rest = [items[i] for i in take], [x for i, x in enumerate(items) if i not in take]
                room = free - sum(f)
                parts = [p for k in range(n + 1) for p in combinations(f, k)]
                worse = any(sum(p) < x <= sum(p) + room or (len(p) > 1 and x == sum(p)) for p in parts for x in rest)
                if room >= 0 and not worse:
                    want.add(tuple(sorted(f, reverse=True)))
        got = list(packing.fillings(left, free))
        assert len(got) == len(set(got)) and set(got) == want
        assert [free - sum(f) for f in got] == sorted(free - sum(f) for f in got)
    assert want is not None and set(packing.fillings([0, 0, 2, 2, 2, 1], 10)) == {(5, 3, 2), (4, 4, 2), (4, 3, 3), (5, 4)}


def test_word_ids_match_whole_texts():
    from tokenizers import Tokenizer

    tok, words = Tokenizer.from_file(queries.tokenizer_path()), packing.WordIds(queries.tokenizer_path())
    rng, odd = random.Random(6), "aZ'.,!(<|>09 \n\t\x1c\x85\xa0éÉßıİſǅΣςе́̂漢😀“–\x01`[ ŉǰ"
    given = ["It's  A TEST x y", "é ́a ΑΣ Σ.", "a\x1cb", "<|endoftext|>x y", "\ufeff zero\u200bwidth", "😀 12 %$", "İstanbul", "a.'s b's. x.y, É. E\u0301.a", "ÀB%%% c***d Ω. ΣΑΣ.", "x<|endoftext|>y. Z."]
    given += ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for t in given:
        assert words.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


# mixing


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5, "e": 700, None: 40}
    names = [*sorted(k for k in sizes if k), None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while True:
        w = sum(weight[k] for k in free)
        over = {k for k in free if left * weight[k] / w > 2 * sizes[k]}
        if not over:
            target |= {k: left * weight[k] / w for k in free}
            break
        target |= {k: 2.0 * sizes[k] for k in over}
        left -= sum(2 * sizes[k] for k in over)
        free -= over
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(target)


def test_mix_meets_targets_and_its_schedule(spark, docs):
    got = mixing.curriculum_mix(docs).toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by["target"] - by["taken"]).abs() < 1).all()
    assert (got["taken"] <= 2 * got["size"]).all()
    turns = [(r.source, float(r.target), x["words"], x["position"]) for r in got.itertuples() for x in r.turns]
    assert sum(x[2] for x in turns) == got["taken"].sum() and all(0 <= x[3] <= 1 for x in turns)
    names = [*sorted(k for k in by.index if k is not None)]
    assert any(by.loc[k, "taken"] > got.loc[got["source"] == k, "size"].sum() for k in names)
    for i, k in enumerate(names):
        tilt, mine = mixing.TILTS[i % 3], [x for x in turns if x[0] == k]
        longest = max(x[2] for x in mine)
        for t in np.linspace(0.1, 1, 10):
            steps = np.linspace(0, t, 2001)
            rate = mine[0][1] * (1 + tilt * (2 * steps - 1))
            demand = float(((rate[1:] + rate[:-1]) / 2 * np.diff(steps)).sum())
            assert abs(sum(x[2] for x in mine if x[3] <= t) - demand) <= longest + 1


def test_copies_of_repeated_documents_stand_apart(spark):
    rows = [(i, " ".join(["w"] * 10), "en", "a" if i < 20 else "b") for i in range(100)]
    got = [r.doc_id for r in mixing.mixed_documents(frame(spark, rows)).collect()]
    twice = [i for i in range(20) if got.count(i) == 2]
    assert len(got) == 150 and len(twice) == 20
    assert all(got.index(i, got.index(i) + 1) - got.index(i) > 20 for i in twice)


# quality, language, media, licences, HTML


def test_kth_largest(spark):
    rng = random.Random(4)
    keys = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 50
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 7, 250, 549):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, 550) == float("-inf") and quality.kth_largest(df, 0) == float("inf")


def test_quality_against_labels(spark):
    """Models and size of the sample come from half of the labels; the other half judges."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality.importance_sample(docs, labels.where(half)).join(labels.where(~half), "doc_id").toPandas()
    assert got.loc[got["quality"] == 1, "sampled"].mean() > 0.97 and got.loc[got["quality"] == 0, "sampled"].mean() < 0.25


def test_inclusion_follows_importance(spark):
    """Gumbel top-k takes a document of log weight w with probability 1 - exp(-exp(w - cut))."""
    kinds = {"good": "the plain words of good text", "mixed": "the plain words of zxq zxw zxe", "bad": "zxq zxw zxe zxr zxt zxy"}
    rows = [(i, kinds[k]) for i, k in enumerate(k for k in kinds for _ in range(600))]
    labels = spark.createDataFrame([(i, int(i < 30)) for i in (*range(30), *range(1750, 1780))], "doc_id long, quality int")
    got = quality.importance_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, k=700, excerpt=2).toPandas()
    assert got["sampled"].sum() == 700
    cut = got.loc[got["sampled"], "gumbel_key"].min()
    got["expected"] = 1 - np.exp(-np.exp(got["mean_ratio"] * 2 - cut))
    rates = got.groupby(got["doc_id"] // 600).agg(rate=("sampled", "mean"), expected=("expected", "mean"))
    assert (rates["rate"] - rates["expected"]).abs().max() < 0.06 and rates["rate"].iloc[0] > rates["rate"].iloc[1] > rates["rate"].iloc[2]


def test_language_held_out(spark, sf):
    got = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12, 40])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    apart = [(a != b).mean() for i, a in enumerate(code) for b in code[:i]]
    assert min(apart, default=1) >= 1 / 3


def test_grams_of_long_texts_count_once(monkeypatch):
    raw = language_id._bytes_of("Some words of a text, again and again, ends here")
    whole = language_id._distribution(raw)
    for block in (3, 4, 7, 16):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert np.allclose(language_id._distribution(raw), whole)


@pytest.mark.parametrize("raw", [b"", b"x", b"a" * 64, b"ab" * 5000])
def test_media_round_trip(raw):
    payload = media.padded(raw)
    track = media.read_container(media.write_container(payload))
    assert len(payload) % 64 == 0 and len(payload) > 0
    assert media.samples(media.write_container(payload), track) == payload
    assert track["codec"] == "raw " and track["duration"] == len(payload)
    assert len(media.key_ranges(track)) == -(-len(payload) // 4096)


def test_broken_media():
    good = media.write_container(media.padded(b"x" * 1000))
    assert media.read_container(None) is None and media.read_container(b"junk") is None
    for cut in range(0, len(good), 37):
        media.read_container(good[:cut])
    rng = random.Random(11)
    for _ in range(500):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 12)):
            bad[rng.randrange(len(bad) - 1000)] = rng.choice([0, 1, 255, rng.randrange(256)])
        media.read_tracks(bytes(bad))


def test_hostile_media():
    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    assert media.read_tracks(deep) == []
    good = media.write_container(media.padded(b"x" * 1000))
    most = (2**32 - 1).to_bytes(4, "big")
    for name, skip in ((b"stsz", 12), (b"stsc", 12), (b"stsc", 16), (b"stss", 8), (b"co64", 8)):
        at = good.index(name) + skip
        media.read_tracks(good[:at] + most + good[at + 4 :])


def word(*values):
    return b"".join(v.to_bytes(4, "big") for v in values)


def track_box(number, handler, codec, scale, duration, *tables):
    head = media._full(b"tkhd", word(0, 0, number, 0, duration), b"\0" * 60)
    table = media._box(b"stbl", media._full(b"stsd", word(1), media._box(codec, b"\0" * 8)), *tables)
    body = media._box(b"mdia", media._full(b"mdhd", word(0, 0, scale, duration, 0)), media._full(b"hdlr", b"\0" * 4, handler, b"\0" * 13), media._box(b"minf", table))
    return media._box(b"trak", head, body)


def two_tracks():
    """Sound in two chunks of 2 and 1 samples with sizes by stz2, then video in two chunks of which samples 1 and 3 are keys."""
    sound = track_box(1, b"soun", b"mp4a", 1000, 3000, media._full(b"stsc", word(2, 1, 2, 1, 2, 1, 1)), media._full(b"stz2", word(4, 3), b"\x12\x30"), media._full(b"stco", word(2, 5000, 6000)))
    video = track_box(2, b"vide", b"avc1", 600, 1200, media._full(b"stss", word(2, 1, 3)), media._full(b"stsc", word(1, 1, 2, 1)), media._full(b"stsz", word(0, 4, 10, 20, 30, 40)), media._full(b"stco", word(2, 5100, 6100)))
    return media._box(b"ftyp", b"isom") + media._box(b"moov", sound, video)


def fragmented():
    track = track_box(7, b"vide", b"hvc1", 100, 0)
    trex = media._box(b"mvex", media._full(b"trex", word(7, 1, 5, 11, 0x10000)))
    head = media._box(b"ftyp", b"isom") + media._box(b"moov", track, trex)
    first = media._box(b"moof", media._full(b"mfhd", word(1)), media._box(b"traf", media._full(b"tfhd", word(7), flags=0x20000), media._full(b"trun", word(3, 200, 0), flags=0x5)))
    second = media._box(b"moof", media._box(b"traf", media._full(b"tfhd", word(7, 9), flags=0x20008), media._full(b"trun", word(2, 300), word(21, 0x10000, 22, 0), flags=0x601), media._full(b"trun", word(1, 23, 0), flags=0x600)))
    return head + first + second, len(head), len(head) + len(first)


def test_tracks_and_fragments(spark):
    sound, video = media.read_tracks(two_tracks())
    assert (sound["track_id"], sound["handler"], sound["codec"], sound["sizes"].tolist(), sound["offsets"].tolist(), sound["sync"].tolist()) == (1, "soun", "mp4a", [1, 2, 3], [5000, 5001, 6000], [0, 1, 2])
    assert media.key_ranges(video) == [{"offset": 5100, "length": 10}, {"offset": 6100, "length": 30}]
    data, one, two = fragmented()
    (t,) = media.read_tracks(data)
    assert t["sizes"].tolist() == [11, 11, 11, 21, 22, 23] and t["duration"] == 3 * 5 + 3 * 9
    assert t["offsets"].tolist() == [one + 200, one + 211, one + 222, two + 300, two + 321, two + 343] and t["sync"].tolist() == [0, 4, 5]
    rows = [(2**53 + 1, two_tracks(), "x"), (None, None, "y"), (2**53 + 3, b"", None), (4, data, "z")]
    files = spark.createDataFrame(rows, "doc_id long, media binary, codec string")
    got = {r.doc_id: r for r in media.media_columns(files).collect()}
    assert got.keys() == {r[0] for r in rows}
    r = got[2**53 + 1]
    assert (r.codec, r.duration_s, [x.handler for x in r.tracks], [x.length for x in r.keyframes]) == ("avc1", 2.0, ["soun", "vide"], [10, 30])
    assert got[None].codec is None and got[None].tracks == [] and got[4].duration_s == 0.42
    assert media.media_columns(files.limit(0)).count() == 0


def test_ids_keep_all_digits_beside_nulls(spark):
    rows = [(2**53 + 1, "one two three"), (None, "no id at all"), (2**53 + 3, None), (-(2**62) - 1, "four five. " * 3)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    for name, run in OPERATORS.items():
        got = run(spark, docs)
        if "doc_id" in got.columns and name not in ("mixed", "quality_filter"):
            ids = {r.doc_id for r in got.select("doc_id").collect()}
            assert ids <= {r[0] for r in rows} and {2**53 + 1, None, -(2**62) - 1} <= ids, name


def test_licenses(spark):
    mit = "Copyright (c) 2020 Someone\n" + license_scan.LICENSES["MIT"].upper().replace(",", " ;").replace(" ", "\n")
    rows = [(1, mit), (2, "text\nreleased under the  mit licence!\nmore"), (3, "Released under the MIT License."), (4, mit + " more"), (5, None)]
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", []), 2: (None, ["MIT"]), 3: ("MIT", ["MIT"]), 4: (None, []), 5: (None, [])}


def test_whole_licenses_in_their_usual_forms(spark):
    own = "Copyright (c) 2021 Some One\n\n"
    bsd = license_scan._stored("BSD").replace("Copyright (c) The Regents of the University of California.\nAll rights reserved.\n", "").replace("the University nor", "the copyright holder nor")
    bsd = bsd.replace("BY THE REGENTS", "BY THE COPYRIGHT HOLDERS").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
    rows = [("MIT", "MIT License\n\n" + own + license_scan.LICENSES["MIT"]), ("ISC", "ISC License\n\n" + own + license_scan.LICENSES["ISC"]), ("Zlib", "zlib License\n\n" + own + license_scan.LICENSES["Zlib"])]
    rows += [("BSD-3-Clause", "BSD 3-Clause License\n\n" + own + bsd), ("BSD-3-Clause", own + bsd)]
    for name, (k, _) in license_scan.FILES.items():
        text = license_scan._stored(name)
        rows += [(k, text), (k, text.lstrip("\n ").split("\n", 2)[2])] if name.startswith(("GPL", "MPL")) else [(k, text)]
        rows += [(k, text.split(license_scan.END)[0])] if license_scan.END in text else []
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.n_words) for r in license_scan.license_scan(docs).collect()}
    assert got == {i: (k, len(license_scan.canonical(t).split())) for i, (k, t) in enumerate(rows)}


def test_notices_of_any_length_and_wording(spark):
    notices = {"Free for all uses.": "X-free", "This grant " + "goes on and " * 60 + "ends.": "X-long"}
    text = "a\n" + "\n".join(notices) + "\nb\nReleased   " + " " * 300 + "under the MIT License."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    known = license_scan.known_licenses(spark, notices={**license_scan.NOTICES, **notices})
    for k in (known, known.drop("chars")):
        assert license_scan.license_scan(docs, k).first().notice_ids == ["MIT", "X-free", "X-long"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b<br>c", "a\n\nb\nc"),
        ("<ul><li>a<li>b<ol><li>x</ol></ul>", "- a\n- b\n  1. x"),
        ("<table><tr><td>a<td>b<tr><td>ccc<td>d</table>", "a    b\nccc  d"),
        ("<div hidden>x</div><span style='display:none'>y</span><script>var t='</p>'</script>z", "z"),
        ("<pre>\n a\n  b</pre>", "a\n  b"),
        ("x &amp; y &lt;z&gt;", "x & y <z>"),
        ("<head><title>t</title><body>b", "b"),
        ("", ""), (None, ""), ("<", "<"), ("</p></div>a", "a"),
    ],
)
def test_html(html, text):
    assert html_text.render(html).strip() == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
        ("<table><tr>x<td>a</td><div>y</div></tr><tbody><p>z</p></tbody></table>", "x\ny\n\nz\n\na"),
        ("<table><tr><div><td>a</td></div></tr></table>", "a"),
        ("<table><colgroup>x<col><tr><td>a</table>", "x\n\na"),
        ("<table><tr><td>a</td><table><tr><td>b</table>", "a\n\nb"),
        ("<table><tr><td><table><tr><td>a</table><td>b</table>", "a  b"),
        ("a <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>no</annotation></semantics></math> b", "a x=1 2 b"),
        ("a <svg><title>no</title><defs/><rect/><text>one</text><g><text>two<tspan> three</tspan></text></g>no</svg> b", "a one two three b"),
    ],
)
def test_stray_html(html, text):
    assert html_text.render(html).strip() == text


def test_no_word_of_random_tables_is_lost():
    rng, tags = random.Random(8), ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "form", "div", "a", "p", "b", "caption", "colgroup", "ul", "li", "math", "center")
    for _ in range(1500):
        parts, n = ["<table>"], 0
        for _ in range(rng.randrange(2, 30)):
            t = rng.choice(tags)
            parts.append(rng.choice((f"<{t}>", f"<{t}>", f"</{t}>", f" w{n} ")))
            n += parts[-1] == f" w{n} "
        html = "".join(parts)
        assert {w for w in html_text.render(html).split() if w[0] == "w"} == {f"w{i}" for i in range(n)}, html


def test_deep_html():
    assert html_text.render("<div>" * 30_000 + "x").strip() == "x"


# the pipeline


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as P

    steps, at = [docs], docs
    scratch = common.Scratch(spark, "test")
    for _, stage in P.STAGES:
        at = scratch.keep(stage(spark, at, sf))
        steps.append(at)
    raw, good, clean, unique, mixed, packed = steps
    assert all(s.columns == raw.columns for s in steps[:-1])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(packed) == ids(mixed) <= ids(unique) <= ids(clean) <= ids(good) <= ids(raw)
    kept = brute_components([(r.doc_id, r.text) for r in clean.collect()])
    assert ids(unique) == {i for i, (_, c) in kept.items() if c == i}
    assert packed.agg(F.sum("length")).first()[0] >= mixed.count()


def stages_over(spark, tmp_path, rows, labels):
    """The tables of each stage over rows of documents, each kept before the next."""
    import corpus_pipeline as P

    at = frame(spark, rows)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scratch, steps = common.Scratch(spark, "test"), [at]
    for _, stage in P.STAGES:
        at = scratch.keep(stage(spark, at, str(tmp_path)))
        steps.append(at)
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    return steps


NO_LABELS = "doc_id long, quality int, toxic int"


def test_pipeline_without_documents(spark, tmp_path):
    steps = stages_over(spark, tmp_path, [], spark.createDataFrame([], NO_LABELS))
    assert [s.count() for s in steps] == [0] * 6


def test_pipeline_with_nulls_repeats_and_no_labels(spark, tmp_path):
    """Without labels no document is refused; lines and copies go by the stated rules, also of null and repeated ids."""
    words = [" ".join(f"{a}{i}" for i in range(20)) for a in ("sun", "sea", "oak")]
    rows = EDGE + [(None, words[0], "en", "s1"), (None, words[1], None, None), (8, words[2], "en", "s1"), (8, words[2], "en", "s1"), (9, words[2] + " more", "en", None)]
    raw, good, clean, unique, mixed, packed = stages_over(spark, tmp_path, rows, spark.createDataFrame([], NO_LABELS))
    assert good.count() == raw.count()
    texts = [(r.doc_id, r.text) for r in clean.collect()]
    places = {(i, pos, line) for i, t in texts if t for pos, line in enumerate(t.split("\n")) if line}
    assert len(places) == len({line for _, _, line in places})  # rows that share an id are one document
    assert set(words) <= {t for _, t in texts}
    assert sum(bool(t) and t.startswith("word word") for _, t in texts) == 1
    left = {(r.doc_id, r.text) for r in unique.collect()}
    assert {t for _, t in left if t} >= {words[0], words[1]}
    assert sum(bool(t) and t.startswith("oak0") for _, t in left) == 1
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= left
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.collect()} and all(r.offset + r.length <= 2048 for r in pieces)


def test_pipeline_with_labels_of_one_kind(spark, tmp_path):
    """Labels of one kind part nothing, so that no document is refused."""
    rows = [(i, f"a text of its own, number {i}, with words{i} that stand{i} nowhere{i} else{i}", "en", "s0") for i in range(30)]
    good = stages_over(spark, tmp_path, rows, spark.createDataFrame([(i, 1, 0) for i in range(10)], NO_LABELS))[1]
    assert good.count() == 30
