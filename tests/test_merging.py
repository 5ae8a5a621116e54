"""Batches merged by identity and hash against a replay row by row; pages against an independent reader; ids and windows by value."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as C
from corpusloom.operators import dedup as D
from corpusloom.operators import lineage
from corpusloom.plans import more
from corpusloom.sources import tables as S
from corpusloom.sources.html_pages import read_page

ROW = "id long, source_id string, doc_id string, parser_id string, content_hash string"


def replay(existing, new, level):
    """The rule itself: each row looks at all stored rows in order."""
    store = [dict(zip(("id", "s", "d", "p", "h"), r, strict=True)) for r in sorted(existing)]
    out = {}
    for i, s, d, p, h in sorted(new):
        same = next((r for r in store if s and d and (r["s"], r["d"], r["p"]) == (s, d, p)), None)
        twin = next((r for r in store if h and r["h"] == h), None)
        hit = {0: None, 1: same, 2: twin, 3: same or twin}[level]
        if hit is None:
            hit = {"id": i, "s": s, "d": d, "p": p, "h": h or None}
            store.append(hit)
            out[i] = [i, "insert"]
        else:
            out[i] = [hit["id"], "update"]
            hit["s"], hit["d"] = s, d
            if level != 2 and hit is same:
                hit["h"] = h or None
        out[i] += [hit["h"], hit["p"], True]
        for j in out:
            if j < i and out[j][0] == hit["id"]:
                out[j][4] = False
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_merge_batch_against_a_replay(spark, level, seed):
    rng = random.Random(seed)
    few = lambda *x: rng.choice(x)
    wide = 4 if seed % 2 else 40
    row = lambda i: (i, few("a", "b", None, ""), few(None, "", *map(str, range(wide))), few("x", "y", None), few(None, "", *(f"h{j}" for j in range(wide))))
    existing, new = [row(i) for i in range(1000, 1000 + few(0, 5, 20))], [row(i) for i in range(2000, 2120)]
    got = D.merge_batch(spark.createDataFrame(new, ROW), spark.createDataFrame(existing, ROW), level).collect()
    assert {r.id: (r.target_id, r.action, r.stored_hash, r.stored_parser, r.latest) for r in got} == replay(existing, new, level)
    assert len(got) == len(new)


def test_merge_batch_of_hot_keys(spark):
    """A hash that most rows share, beside documents that change theirs: only the changes are replayed."""
    rng = random.Random(9)
    new = [(i, "s", str(i if rng.random() < 0.9 else rng.randrange(30)), "p", "hot" if rng.random() < 0.8 else f"h{rng.randrange(9)}") for i in range(100, 700)]
    got = D.merge_batch(spark.createDataFrame(new, ROW), spark.createDataFrame([(5, "s", "3", "p", "hot")], ROW), 3).collect()
    assert {r.id: (r.target_id, r.action, r.stored_hash, r.stored_parser, r.latest) for r in got} == replay([(5, "s", "3", "p", "hot")], new, 3)


def test_merge_batch_of_nothing(spark):
    none = spark.createDataFrame([], ROW)
    for level in range(4):
        assert D.merge_batch(none, none, level).count() == 0
        assert D.merge_batch(spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, None)], ROW), none, level).where("action = 'insert' and latest").count() == 2


def test_ingest_by_both_over_all_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "source", "cast(n_chars % 50 as string) d", "lang", "sha2(text, 256) h").collect()
    want = replay([tuple(r) for r in rows if r.doc_id % 2 == 0], [tuple(r) for r in rows if r.doc_id % 2 == 1], 3)
    got = more.s02_ingest_by_both(spark, sf).collect()
    assert {r.id: (r.target_id, r.action, r.stored_hash, r.stored_parser, r.latest) for r in got} == want and len(got) == len(want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"a{rng.randrange(60)}", f"b{rng.randrange(80)}") for _ in range(70)] + [("hub", f"c{i}") for i in range(50)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.label for r in lineage.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in list(root)}


def test_read_page():
    page = """<html><head><title>A &amp; B</title><style>p{}</style><script>var x = "<p>";</script></head><body><header>Top</header><nav><a href="/x#y">X</a> <a href="/x">Y</a></nav>
    <h2>Head<span class="mw-editsection">[<a href="/edit">edit</a>]</span></h2><p>caf&eacute; &#233; &lt;b&gt;  two<br>three<ul><li>one<li>two</ul><template>no</template><div hidden>kept</div></p></body>
    <footer>End</footer>"""
    title, text, links = read_page(page)
    assert title == "A & B" and links == ["/x", "/edit"]
    assert text == "Top\n\nX Y\n\n## Head\n\ncafé é <b> two\nthree\n\n- one\n- two\n\nkept\n\nEnd"
    assert read_page(page, False)[1].split("\n") == ["A & BTopX Y", "Headcafé é <b>", "twothreeonetwokept", "End"]
    began = time.time()
    assert read_page("<div>" * 100_000 + "x" + "</p></div>" * 100_000)[1] == "x"
    assert time.time() - began < 5 and read_page("") == ("", "", [])


def test_pages_keep_nulls_and_repeats(spark):
    rows = [("u", "<p>a</p>", 1), (None, "<p>a</p>", 2), ("u", None, 3), ("u", "", 4)]
    got = S.page_source(spark.createDataFrame(rows, "url string, html string, text int")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [("u", "", "a", []), (None, "", "a", []), ("u", None, None, None), ("u", "", "", [])]))


def test_embeddings_keep_ids(spark):
    rows = [(2**53 + 1, "a b"), (None, "c"), (2**53 + 3, None)]
    got = C.embed_chunks(spark.createDataFrame(rows, "chunk_id long, text string"), C.hashing_embedder(8)).collect()
    assert {r.chunk_id for r in got} == {2**53 + 1, 2**53 + 3, None} and all(len(r.embedding) == 8 for r in got)


def test_token_windows_take_time_in_proportion(spark):
    def took(n):
        df = spark.createDataFrame([(1, "word " * n)], "id long, text string")
        began = time.time()
        C.chunk_tokens(df, 50).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(1000)
    assert min(took(80_000) for _ in range(2)) < 4 * min(took(20_000) for _ in range(2)) + 1.5
