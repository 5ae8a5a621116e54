"""Nearest vectors, node names, word runs, stems, paths, percentiles, keyed state and pages against brute force and published examples."""

import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.stems import porter
from corpusloom.operators import aggregates as A
from corpusloom.operators import chunking as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import graph as G
from corpusloom.operators import search as V
from corpusloom.plans import more
from corpusloom.streaming import streams as T

#: Examples of the paper, by its steps.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
running run runs run generalizations gener oscillators oscil""".split()


def test_published_stems():
    assert [(w, porter(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert [porter(w) for w in ("", "by", "été", "a1ing")] == ["", "by", "été", "a1ing"]


def test_english_search_over_all_chunks(spark, sf):
    wanted = {porter("things"), porter("inning")}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id * 1_000_000 + i for r in rows for i, line in enumerate(r.text.split("\n")) if wanted <= {porter(w.lower()) for w in re.findall(r"[^\W_]+", line) if w.lower() not in V.STOPWORDS}}
    assert {r.chunk_id for r in more.v06_english_search(spark, sf).collect()} == want
    chunks = spark.createDataFrame([(1, 1, "Running late"), (2, 2, "a run"), (3, 3, "the ruin"), (4, 4, "runs and ponies")], "chunk_id int, id int, text string")
    assert {r.chunk_id for r in V.search_web(chunks, "run", english=True).collect()} == {1, 2, 4}
    assert {r.chunk_id for r in V.search_web(chunks, "runs -pony", english=True).collect()} == {1, 2}


def brute_nearest(vectors, queries, k, least=-math.inf):
    out = []
    for q, v, t in queries:
        s = []
        for i, e, u in vectors:
            if i is None or e is None or v is None or len(e) != len(v) or (t is not None and t != u):
                continue
            n = np.linalg.norm(e) * np.linalg.norm(v)
            s.append((-round(float(np.dot(e, v) / n), 6) if n else 0.0, i))
        out += [(q, i, -x) for x, i in sorted(s)[:k] if -x >= least]
    return sorted(out)


@pytest.mark.parametrize("rounds", [1, 3])
def test_nearest_vectors_in_blocks_and_rounds(spark, monkeypatch, rounds):
    rng = random.Random(rounds)
    vector = lambda d=4: [float(rng.randrange(-2, 3)) for _ in range(d)]
    vectors = [(i, vector(), rng.choice("ab")) for i in range(300)] + [(None, vector(), "a"), (900, None, "a"), (901, [1.0], "b"), (902, [0.0] * 4, "b")]
    queries = [(i, vector(), rng.choice("ab")) for i in range(60)] + [(70, [2.0], "b"), (71, None, "a"), (72, [0.0] * 4, "a")]
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "ROUND_BYTES", 64 << 20 if rounds == 1 else 8 * 4 * 63 // 3 + 1)
    e = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>, type_id string").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, query array<float>, type_id string")
    got = V.knn_exact(e, q, 5).collect()
    assert sorted((r.query_id, r.chunk_id, r.score) for r in got) == brute_nearest(vectors, [(i, v, None) for i, v, _ in queries], 5)
    assert {r.rank for r in got} == {1, 2, 3, 4, 5}
    typed = V.knn_exact(e, q, 3, same="type_id", least=0.5).collect()
    assert sorted((r.query_id, r.chunk_id, r.score) for r in typed) == brute_nearest(vectors, queries, 3, 0.5)
    assert V.knn_exact(e, q.limit(0), 3).count() == 0 and V.knn_exact(e.limit(0), q, 3).count() == 0


def test_nodes_by_vector_and_their_aliases(spark):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    nodes = [(i, i % 3, f"n{i}", [f"a{i}"] if i % 2 else None, vector()) for i in range(80)]
    names = [("n4", 1, vector()), ("a5", 2, vector()), ("a7", 0, vector()), ("q", 0, None)] + [(f"x{i}", i % 3, vector()) for i in range(40)]
    n = spark.createDataFrame(nodes, "node_id long, type_id int, canonical_name string, aliases array<string>, embedding array<double>")
    asked = spark.createDataFrame(names, "name string, type_id int, embedding array<double>")
    want = {}
    for name, t, v in names:
        exact = [(i, how) for how, key in (("name", lambda x: [x[2]]), ("alias", lambda x: x[3] or [])) for x in nodes for i in [x[0]] if x[1] == t and name in key(x)]
        near = brute_nearest([(i, e, u) for i, u, _, _, e in nodes], [(0, v, t)], 1, 0.6)
        want[name, t] = (exact[0][0], exact[0][1], None) if exact else (near[0][1], "vector", near[0][2]) if near else (None, "new", None)
    got = G.resolve_by_vector(asked, n, 0.6)
    found = {(r.name, r.type_id): (r.node_id, r.how, r.score) for r in got.collect()}
    assert found == want and len({h for _, h, _ in want.values()}) == 4
    pool = n.withColumnRenamed("node_id", "chunk_id")
    centroids = V.ivf_fit(pool, 4)
    listed = G.resolve_by_vector(asked, n, 0.6, V.ivf_index(pool, centroids), centroids, 4)
    assert {(r.name, r.type_id): (r.node_id, r.how, r.score) for r in listed.collect()} == want
    after = {r.node_id: r.aliases for r in G.add_aliases(n, got).collect()}
    for i, _, _, aliases, _ in nodes:
        new = sorted(name for (name, _), (node, how, _) in want.items() if how == "vector" and node == i)
        assert (after[i] or []) == (aliases or []) + new
    twice = G.add_aliases(G.add_aliases(n, got), got)
    assert {r.node_id: r.aliases for r in twice.collect()} == after


def test_evidence_is_appended(spark):
    kind = "source_node string, verb string, target_node string, evidence long, confidence double"
    old = spark.createDataFrame([("a", "v", "b", 3, 0.5), ("c", "v", "d", 1, 0.9)], kind)
    new = spark.createDataFrame([("a", "v", "b", 0.7), ("a", "v", "b", None), ("e", "v", "f", 0.1)], "source_node string, verb string, target_node string, confidence double")
    got = {r.source_node: (r.evidence, r.confidence, r.action) for r in G.append_evidence(new, old).collect()}
    assert got == {"a": (5, 0.7, "update"), "c": (1, 0.9, "keep"), "e": (1, 0.1, "create")}


def test_longest_run_against_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(14))] for _ in range(2))
        runs = {tuple(a[i:j]) for i, j in itertools.combinations(range(len(a) + 1), 2)}
        assert E.longest_run(a, b) == max((j - i for i, j in itertools.combinations(range(len(b) + 1), 2) if tuple(b[i:j]) in runs), default=0)
    assert E.longest_run(["the"] * 2000, ["the"] * 3000) == 2000


def test_paths_against_brute_force(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(26)] + [(0, 100 + i) for i in range(30)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def walk(path, goal, depth):
        if path[-1] == goal:
            yield path
        elif len(path) <= depth:
            for x in near.get(path[-1], ()):
                if x not in path:
                    yield from walk([*path, x], goal, depth)

    df = spark.createDataFrame(edges, "a long, b long")
    for start, goal, depth, n in ((0, 5, 4, 1000), (0, 5, 4, 3), (1, 7, 3, 1000), (2, 2, 3, 5), (0, 999, 3, 5)):
        want = [] if start == goal else sorted(walk([start], goal, depth), key=lambda p: (len(p), p))[:n]
        assert [r.path for r in G.find_paths(df, start, goal, depth, n).collect()] == want


@pytest.mark.parametrize(("at_once", "bins"), [(50_000, 4096), (3, 4), (1, 2)])
def test_percentiles_by_rounds(spark, monkeypatch, at_once, bins):
    monkeypatch.setattr(A, "AT_ONCE", at_once)
    monkeypatch.setattr(A, "BINS", bins)
    rng = random.Random(at_once)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, rng.gauss(0, 100), 7.0, None])) for _ in range(150)] + [("c", None), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = {r.g: r for r in A.indexed_percentile(df, ["g"], "v", shares).collect()}
    smooth = {r.g: r for r in A.interpolated_percentile(df, ["g"], "v", shares).collect()}
    for g in ("a", "b", None, "d"):
        v = sorted(x for h, x in rows if h == g and x is not None)
        for name, q in shares.items():
            assert got[g][name] == v[min(len(v) - 1, int(q * len(v)))]
            assert smooth[g][name] == pytest.approx(float(np.quantile(v, q)))
    assert "c" not in got


def test_state_rewrites_touched_buckets_only(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k long, seq long, state string")
    merge = T.merge_latest(str(tmp_path), ["k"], "seq", 8)
    merge(make([(i, 1, "a") for i in range(200)]), 0)
    merge(make([(7, 2, "b")]), 1)
    files = lambda n: sorted(x for x in os.listdir(tmp_path / "data" / str(n)) if x.startswith("bucket"))
    assert len(files(0)) == 8 and len(files(1)) == 1
    held = lambda n: {r.k: (r.seq, r.state) for r in T.read_latest(spark, str(tmp_path), n).collect()}
    want = {i: (1, "a") for i in range(200)} | {7: (2, "b")}
    assert held(1) == want
    merge(make([(7, 2, "b")]), 1)  # run again
    assert held(1) == want and held(0)[7] == (1, "a")
    merge(make([]), 2)
    merge(make([(7, 1, "late"), (500, 9, "new")]), 3)
    assert held(3) == want | {500: (9, "new")}
    empty = T.merge_latest(str(tmp_path / "none"), ["k"], "seq")
    empty(make([]), 0)
    assert T.read_latest(spark, str(tmp_path / "none"), 0) is None


def test_pages_of_sections(spark):
    rng = random.Random(2)
    for text in ("x\n# A\n<!-- page:2 -->y", "<!-- page:1 -->", "".join(rng.choice(["word ", "\n# H\n", "\n\n", f"<!-- page:{i} -->"]) for i in range(80))):
        chunks = C.chunk_sections(spark.createDataFrame([(1, text)], "id int, text string"), 6).orderBy("chunk_index").collect()
        at = 0
        page = lambda pos: next((int(m[1]) for m in reversed(list(re.finditer(C.PAGE_MARK, text))) if m.start() <= pos), None)
        for c in chunks:
            at = text.index(c.text, at)
            assert (c.page_start, c.page_end) == (page(at), page(at + len(c.text) - 1))
            at += len(c.text)


def test_interpolated_spread_of_no_rows(spark):
    df = spark.createDataFrame([], "stage string, v double")
    assert A.stage_stats(df, ["stage"], "v").count() == 0 and A.indexed_percentile(df, ["stage"], "v", {"m": 0.5}).count() == 0
    assert A.transport_usage(df.select(F.col("stage").alias("transport"))).count() == 0


def test_stems_of_a_text_go_to_the_workers_together(spark):
    from corpusloom.functions.stems import english_stems, porter

    rows = [(1, ["running", None, "runs"]), (2, None), (3, []), (4, ["ponies", "running"])]
    x = spark.createDataFrame(rows, "id long, words array<string>").coalesce(1)
    assert {r.id: r.s for r in x.select("id", english_stems(F.col("words")).alias("s")).collect()} == {i: w and [v and porter(v) for v in w] if w is not None else None for i, w in rows}
    chunks = spark.createDataFrame([(1, 1, "The running of the ponies"), (2, 1, None)], "chunk_id long, id long, text string")
    posts = V.postings(chunks, english=True)
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("ArrowEvalPython")
    assert sorted((r.chunk_id, r.pos, r.term, r.weight) for r in posts.collect()) == [(1, 1, "run", 1.0), (1, 4, "poni", 1.0)]
