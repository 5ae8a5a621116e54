"""Full-text search against a brute-force version, the stored index, stored summaries and import runs."""

import datetime as dt
import itertools
import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import aggregates as A
from corpusloom.operators import search as V
from corpusloom.plans import more
from corpusloom.sources import importer as I


def brute(words, weights, query, near=8.0):
    """Score of one text: for each alternative the covers found by looking at every stretch."""
    total, matched = 0.0, False
    for need, bar in V.web_query(query):
        places = [[p for p in range(len(words)) if all(p + o < len(words) and words[p + o] == w for o, w in phrase)] for phrase in [*need, *bar]]
        if not all(places[: len(need)]) or any(places[len(need) :]):
            continue
        matched = True
        # a stretch is a cover if it has all items and loses one at either end
        spans = {(min(c), max(c)) for c in itertools.product(*places[: len(need)])} if need else set()
        for a, b in spans:
            if not any((x, y) != (a, b) and a <= x and y <= b for x, y in spans):
                last = [max(p for p in ps if p <= b) for ps in places[: len(need)]]
                total += sum(weights[p] for p in last) / len(last) * min(1.0, near / (b - a + 1))
    return round(total, 6) if matched else None


QUERIES = ("x", "x y", "x -z", "x or z q", '"x y"', '"y z" x', "x-y or q", '-"x y" -q', "x the -y", "the of", "", 'z "x the y"', "x y z q", "İa or x", "σας or q")


def test_web_search_against_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["x", "y", "z", "q", "the", "X,", "w"]) for _ in range(r.randint(0, 25))) for _ in range(60)]
    texts += ["ΣΑΣ x", "İA y", "x́ y", None]
    titles = [r.choice([None, "", "x", "y z", "q x"]) for _ in texts]
    chunks = spark.createDataFrame([(i, i, t, h) for i, (t, h) in enumerate(zip(texts, titles, strict=True))], "chunk_id long, id long, text string, title string")
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    for fields in ({"text": 1.0}, {"title": 1.0, "text": 0.4}):
        for query in QUERIES:
            got = {x.chunk_id: x.score for x in V.search_web(chunks, query, fields).collect()}
            want = {}
            for i, (t, h) in enumerate(zip(texts, titles, strict=True)):
                head = split(h) if "title" in fields else []
                s = brute(head + split(t), [1.0] * len(head) + [fields["text"]] * len(split(t)), query)
                if s is not None:
                    want[i] = s
            assert got.keys() == want.keys(), query
            assert all(abs(got[i] - want[i]) < 2e-6 for i in want), query


def test_stems(spark):
    words = {"queries": "query", "cats": "cat", "glasses": "glasse", "bus": "bus", "glass": "glass", "aes": "aes", "shoes": "shoes", "cookeies": "cookeies", "x": "x"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", V.plural_stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words
    chunks = spark.createDataFrame([(1, 1, "Two cats"), (2, 2, "one cat"), (3, 3, "dogs")], "chunk_id long, id long, text string")
    assert {r.id for r in V.search_web(chunks, "cats", stem=V.plural_stem).collect()} == {1, 2}


def test_batches_scan_and_index_agree(spark, tmp_path):
    r = random.Random(6)
    texts = [" ".join(r.choice("xyzqabc") * r.randint(1, 2) for _ in range(r.randint(0, 40))) for _ in range(50)]
    chunks = spark.createDataFrame([(100 + i, i, t) for i, t in enumerate(texts)], "chunk_id long, id long, text string")
    asked = {1: ["x", "YY"], 2: ["z"], 3: ["x", "y", "zz", "x"], 4: ["none", "x"], 5: [], 6: ["q"], 7: None, 8: ["a", "x"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    posts = V.postings(chunks)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "id", "score").collect()))
    got = rows(V.search_chunks_batch(chunks, queries))
    assert got and got == rows(V.search_fulltext_batch(posts, queries))
    V.write_postings(posts, str(tmp_path / "posts"))
    stored = V.read_postings(spark, str(tmp_path / "posts"), ["X", "yy"])
    assert sorted((1, *x) for x in V.search_fulltext(stored, ["X", "yy"]).collect()) == [x for x in got if x[0] == 1]


def test_summaries_are_replaced(spark, tmp_path):
    docs = lambda n: spark.createDataFrame([(i, "s", "text", '{"k%d": 1}' % i) for i in range(n)], "id long, source_id string, doc_type string, meta string")
    chunks = spark.createDataFrame([(0,), (0,), (1,), (9,)], "id long")
    for n in (1, 2):
        A.refresh_summaries(docs(n), chunks, str(tmp_path))
        got = {t: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{t}").collect()) for t in ("document_counts", "chunk_counts", "metadata_keys")}
        assert got == {"document_counts": [("s", "text", n)], "chunk_counts": [("s", "text", n + 1)], "metadata_keys": [(f"k{i}",) for i in range(n)]}


def test_import_run_of_a_folder(spark, tmp_path):
    for name, text in (("a.txt", "alpha"), ("b.txt", " \n"), ("c.txt", "gamma"), ("d.md", "other")):
        (tmp_path / name).write_text(text)
    raw = spark.createDataFrame([("c", dt.datetime(2999, 1, 1))], "entry string, revised timestamp")
    found, summary = I.run_import(I.FolderImporter("folder", str(tmp_path)), spark, raw)
    assert [tuple(r) for r in found.collect()] == [("folder", "a", None, "alpha")]
    assert tuple(summary.first()) == ("folder", 3, 1, 1, 1, ["b"])


def test_import_of_pages_with_one_address(spark):
    rows = [(1, "u", "<title>a</title>x"), (2, "u", "<title>b</title>y"), (3, "v", "<title>c</title>z"), (4, "w", "none"), (5, "w", "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("listed", F.to_timestamp(F.lit("2024-01-02")))
    raw = spark.createDataFrame([("v",)], "entry string").withColumn("revised", F.to_timestamp(F.lit("2024-01-03")))
    found, summary = I.run_import(I.PageImporter("web", pages), spark, raw)
    s = summary.first()
    assert (s.found, s.processed, s.skipped, s.failed) == (5, 2, 1, 2)
    assert sorted(r.title for r in found.collect()) == ["a", "b"]


def test_import_query_counts_pages_not_addresses(spark, tmp_path):
    rows = [(3, "u", "<title>a</title>"), (4, "u", "<title>b</title>"), (5, "u", "<p>none"), (7, None, "<title>c</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    s = more.u06_import_run(spark, str(tmp_path)).first()
    assert (s.found, s.processed, s.skipped, s.failed) == (4, 2, 1, 1)


def _vectors(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, i % 3 if i % 7 else None, [rng.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(4)] if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, type_id int, embedding array<float>"), rows


def _near(rows, q, k, kind=None, least=-2.0, allowed=None):
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    ok = [r for r in rows if r[2] is not None and (kind is None or r[1] == kind) and (allowed is None or r[0] in allowed)]
    found = [(round(sum(a * b for a, b in zip(unit(r[2]), unit(q), strict=True)), 6) + 0.0, r[0]) for r in ok]
    return [i for s, i in sorted((f for f in found if f[0] >= least), key=lambda f: (-f[0], f[1]))[:k]]


def test_nearest_by_matrix_against_each_pair(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "ROW_BLOCK", 16)
    e, rows = _vectors(spark, 400)
    asked = e.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "type_id", F.col("embedding").alias("query"))
    for same in (None, "type_id"):
        got = {}
        for r in V.knn_exact(e.repartition(3), asked, 4, same=same, least=0.3).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        wanted = {i: _near(rows, v, 4, t, 0.3) if same else _near(rows, v, 4, None, 0.3) for i, t, v in rows[::10] if v is not None and (not same or t is not None)}
        assert got == {i: w for i, w in wanted.items() if w}


def test_lists_are_found_and_read_by_matrix(spark, monkeypatch):
    monkeypatch.setattr(V, "ROW_BLOCK", 16)
    e, rows = _vectors(spark, 300)
    c = spark.createDataFrame([(5, [1.0, 0.0, 0.0, 0.1]), (2, [0.0, 1.0, 0.2, 0.0]), (9, [-1.0, 0.3, 0.5, 0.9])], "list_id int, centroid array<double>")
    index = V.ivf_index(e, c)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    lists = {r.chunk_id: r.list_id for r in index.collect()}
    centres = [(r.list_id, 0, list(r.centroid)) for r in c.collect()]
    assert lists == {i: _near(centres, v, 1)[0] if v is not None else 2 for i, _, v in rows}
    asked = e.where("chunk_id % 10 = 3").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {}
    for r in V.knn_ivf(index, c, asked, 5, 1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i, _, v in rows[3::10]:
        if v is not None:
            mine = _near(centres, v, 1)[0]
            assert got[i] == _near(rows, v, 5, allowed={x for x in lists if lists[x] == mine})


def test_similar_nodes_without_a_join_of_vectors(spark):
    e, rows = _vectors(spark, 200)
    nodes = e.withColumnRenamed("chunk_id", "node_id")
    out = V.similar_nodes(nodes, nodes.where("node_id % 9 = 0").select(F.col("node_id").alias("query_id"), "type_id", F.col("embedding").alias("query")), 3, 0.2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    wanted = {i: _near([r for r in rows if r[0] != i], v, 3, t, 0.2) for i, t, v in rows[::9] if v is not None and t is not None}
    assert got == {i: w for i, w in wanted.items() if w}


def test_batch_search_with_a_set_of_keys_and_without(spark, monkeypatch):
    rng = random.Random(5)
    chunks = spark.createDataFrame([(i, i // 2, " ".join(rng.choice("red Red blue green sky sea of the long longer".split()) for _ in range(rng.randrange(1, 30)))) for i in range(80)], "chunk_id long, id long, text string")
    queries = spark.createDataFrame([(1, ["red", "blue"]), (2, ["longer"]), (3, ["sea", "SKY", "red"]), (4, ["of", "red"]), (5, []), (6, ["absent", "sea"])], "query_id long, terms array<string>")
    found = V.search_chunks_batch(chunks, queries)
    assert "filter(words" in found._jdf.queryExecution().analyzed().toString()
    few = sorted(map(tuple, found.collect()))
    assert few == sorted(map(tuple, V.search_fulltext_batch(V.postings(chunks), queries).select(found.columns).collect())) and {r[0] for r in few} == {1, 2, 3}
    monkeypatch.setattr(V, "MOST_KEYS", 1)
    assert sorted(map(tuple, V.search_chunks_batch(chunks, queries).collect())) == few
