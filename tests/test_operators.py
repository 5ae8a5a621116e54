"""Cases with known answers for operators that the registered queries don't pin down."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalars as P
from corpusloom.operators import aggregates as A
from corpusloom.operators import chunking as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import filters as L
from corpusloom.operators import graph as G
from corpusloom.operators import privacy as R
from corpusloom.operators import search as V
from corpusloom.sources import tables as S
from corpusloom.streaming import streams as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("bad", [{"fuzzy": {"a": 1}}, {"term": {"a": 1, "b": 2}}, {"terms": {"a": []}}, {"range": {"n_chars": {}}}, {"range": {"n_chars": {"above": 1}}}])
def test_bad_filters(spark, bad):
    with pytest.raises(L.FilterError):
        L.predicate(bad)


def test_must_not_drops_rows_without_the_field(spark):
    df = spark.createDataFrame([(1, '{"k": "a"}'), (2, '{"k": "b"}'), (3, "{}")], ["id", "meta"])
    assert [r.id for r in df.where(L.predicate({"bool": {"must_not": {"term": {"k": "a"}}}})).collect()] == [2]
    assert df.where(L.predicate({"bool": {}})).count() == 3


def test_metadata_compares_as_text(spark):
    df = spark.createDataFrame([(1, '{"k": 9}')], ["id", "meta"])
    assert df.where(L.predicate({"range": {"k": {"gte": "10"}}})).count() == 1


def test_hit_rate_and_recall(spark):
    ranks = [(1, True, 1), (1, True, 2), (1, True, 5), (1, False, None), (1, False, None)]
    df = spark.createDataFrame(ranks, "run_id int, is_hit boolean, hit_rank int")
    assert E.hit_rate(df).first()["hit_rate"] == pytest.approx(0.6)
    assert {r.k: round(r.recall, 3) for r in E.recall_at_k(df, [1, 3, 5]).collect()} == {1: 0.2, 3: 0.4, 5: 0.6}


def test_indexed_percentile(spark):
    df = spark.createDataFrame([("a", v) for v in (10, 20, 30, 40)], ["tool", "ms"])
    r = A.indexed_percentile(df, ["tool"], "ms", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.p50, r.p95) == (30, 40)


def test_chunks_are_slices_of_their_text(spark):
    docs = spark.createDataFrame([(1, "  a bb  ccc\nd e f g h i j "), (2, ""), (3, "one")], ["id", "text"])
    text = {r.id: r.text for r in docs.collect()}
    got = C.chunk_tokens(docs, 4, 1).collect()
    assert got and all(text[r.id][r.char_start : r.char_end] == r.text for r in got)
    assert max(r.char_end for r in got if r.id == 1) == len(text[1].rstrip())


@pytest.mark.parametrize("cap", [5, 12, 40])
def test_split_to_budget_joins_to_the_text(cap):
    text = "one two. three four.\nfive six\n\nseven eight nine ten eleven"
    parts = C.split_to_budget(text, cap)
    assert "".join(parts) == text
    assert all(0 < len(p) <= cap for p in parts)


def test_heading_paths(spark):
    rows = [(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, None, "x"), (1, 3, 1, "C"), (1, 4, None, "y")]
    got = C.headings_to_paths(spark.createDataFrame(rows, "id int, pos int, level int, text string")).orderBy("pos").collect()
    assert [r.section_path for r in got] == ["A", "A > B", "A > B", "C", "C"]


def test_merged_spans_take_the_label_that_begins_first(spark):
    rows = [(1, 0, 10, "b", 2), (1, 5, 20, "a", 1), (1, 20, 22, "c", 0)]
    got = R.merge_spans(spark.createDataFrame(rows, "id int, begin int, end int, label string, priority int")).orderBy("begin").collect()
    assert [(r.begin, r.end, r.label) for r in got] == [(0, 20, "b"), (20, 22, "c")]


def test_redact_twice_changes_nothing(spark):
    patterns = [("MAIL", r"[a-z]+@[a-z.]+", False), ("PIN", r"(?i)pin:? \d{4}", False)]
    c = R.redact(F.col("t"), patterns=patterns)
    assert one(spark, R.redact(c, patterns=patterns), t="me@x.org, PIN 1234") == one(spark, c, t="me@x.org, PIN 1234") == "[redacted: MAIL], [redacted: PIN]"


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, chunk_id int, rank int")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(V.rrf_fuse(a, b)) == key(V.rrf_fuse(b, a))


def test_markers_and_evidence(spark):
    assert one(spark, P.fill_markers(F.col("t"), "<!-- x -->", F.array(F.lit("1"), F.lit("2"))), t="a<!-- x -->b<!-- x -->c<!-- x -->") == "a1b2c<!-- x -->"
    assert one(spark, P.evidence_found(F.col("q"), F.col("t")), q="Alpha  beta ... delta", t="x alpha beta gamma delta")
    assert not one(spark, P.evidence_found(F.col("q"), F.col("t")), q="alpha ... omega", t="x alpha beta")


def test_slides(spark):
    assert one(spark, P.slides_to_markdown(F.col("t")), t="Title\n• one\nmore\n• two") == "# Title\n- one more\n- two"


def test_source_times(spark):
    at = lambda s, zone="UTC": one(spark, P.F.date_format(S.parse_source_time(F.col("t"), zone), "yyyy-MM-dd HH:mm"), t=s)
    assert at("2020-07") == "2020-07-01 00:00"
    assert at("2020-07-01 12:00:00", "America/Chicago") == "2020-07-01 17:00"
    assert at("2020-01-01 12:00:00", "America/Chicago") == "2020-01-01 18:00"
    assert at("junk") is None


def test_paths_are_simple_and_shortest_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], ["a", "b"])
    assert [r.path for r in G.find_paths(edges, "a", "d", 3).collect()] == [["a", "c", "d"], ["a", "b", "c", "d"]]


def test_directory_source(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "f.txt").write_text("hi")
    r = S.directory_source(spark, str(tmp_path), "*.txt").first()
    assert (r.doc_id, r.folder, r.file_size) == ("x--y--f", "x/y", 2)


def test_ivf_with_all_lists_is_exact(spark, sf):
    e = S.read_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    q = e.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    cents = e.where("chunk_id % 50 = 7").select(F.col("chunk_id").alias("list_id"), F.col("embedding").alias("centroid"))
    n = cents.count()
    key = lambda df: sorted((r.query_id, r.chunk_id, r.rank) for r in df.collect())
    assert key(V.knn_ivf(V.ivf_index(e, cents), cents, q, 5, n)) == key(V.knn_exact(e, q, 5))


def test_knn_answers_more_queries_than_a_block(spark):
    import numpy as np

    rng, n = np.random.default_rng(3), 2 * V.QUERY_BLOCK + 300
    e, q = rng.normal(size=(7, 4)), rng.normal(size=(n, 4))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, query array<double>")
    score = np.round((q @ e.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(e, axis=1), 6)
    want = {(i, int(c), r) for i in range(n) for r, c in enumerate(np.lexsort((np.arange(7), -score[i]))[:2], 1)}
    assert {(r.query_id, r.chunk_id, r.rank) for r in V.knn_exact(vectors, queries, 2).collect()} == want


def test_more_like_this_sees_all_chunks(spark):
    n = V.QUERY_BLOCK + 50  # the last chunk alone points where chunk n does
    rows = [(i, [1.0, 0.0]) for i in range(n - 1)] + [(n - 1, [0.0, 1.0]), (n, [0.0, 2.0])]
    got = V.more_like_this(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), range(n), 5).collect()
    assert [tuple(r) for r in got] == [(n, 1.0)]


def test_fulltext_batch_is_each_search_alone(spark):
    texts = ["x y x z y", "y y x q q q q q q q q q z", "z x", "X Z z y x", "q"]
    posts = V.postings(spark.createDataFrame([(10 + i, i, t) for i, t in enumerate(texts)], "chunk_id long, id long, text string"))
    asked = {1: ["x", "Y"], 2: ["z"], 3: ["x", "y", "z", "x"], 4: ["none", "x"], 5: [], 6: ["q"]}
    got = V.search_fulltext_batch(posts, spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")).collect()
    want = {(k, *r) for k, t in asked.items() if t for r in V.search_fulltext(posts, t).collect()}
    assert want and {(r.query_id, r.chunk_id, r.id, r.score) for r in got} == want


def test_hybrid_search_answers_each_query(spark, sf):
    from corpusloom.plans import queries as Q

    got = {r.query_id for r in Q.v09_hybrid_search(spark, sf).select("query_id").distinct().collect()}
    assert got == {r.vec_id for r in S.read_table(spark, sf, "embeddings").where("vec_id % 100 = 0").select("vec_id").collect()}


def test_streams_agree_with_batches(spark, sf, tmp_path):
    stream = T.read_stream(spark, sf, "events")
    T.run_available(T.daily_usage(stream), "daily", str(tmp_path / "a"), "complete")
    batch = S.read_table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").count()
    assert sorted((r.day.date(), r.event_type, r.calls) for r in spark.table("daily").collect()) == sorted(map(tuple, batch.collect()))


def test_late_lower_sequence_never_wins(spark, tmp_path):
    merge = T.merge_latest(str(tmp_path), ["raw_id"], "seq")
    make = lambda rows: spark.createDataFrame(rows, "raw_id int, seq int, state string")
    merge(make([(1, 5, "hidden"), (2, 1, "held")]), 0)
    merge(make([(1, 3, "visible"), (2, 2, "visible")]), 1)
    got = {r.raw_id: (r.seq, r.state) for r in T.read_latest(spark, str(tmp_path), 1).collect()}
    assert got == {1: (5, "hidden"), 2: (2, "visible")}


def test_usage_window(spark):
    rows = [("t", "s1", "ok", 200.0, dt.datetime(2024, 1, 2)), ("t", None, "error", 100.0, dt.datetime(2024, 1, 3)), ("t", "s1", "ok", 300.0, dt.datetime(2023, 1, 1))]
    df = spark.createDataFrame(rows, "tool string, session_id string, status string, duration_ms double, created_time timestamp_ntz")
    r = A.tool_usage(df, F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert (r.calls, r.sessions, r.errors, r.median_ms) == (2, 1, 1, 200.0)
