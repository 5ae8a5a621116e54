"""Rendering of pages by value: ids, nulls, depth, styles against a walk of their own, row spans."""

import random
import time

import pytest

from corpusloom.llm import html_text as H


def test_rows_stay_as_they_are(spark):
    rows = [(2**53 + 1, "<p>a</p>", "t", 1), (None, "<p>b</p>", "t", None), (2**53 + 3, None, "t", 2), (2**53 + 3, None, "t", 2), (4, "", None, 3), (5, "<p hidden>x", "t", 4), (6, "<p>" + "long " * 200_000, "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_x int")
    got = H.html_text(df)
    assert got.columns == ["page_id", "n_x", "text"]
    want = [(i, x, {"<p>a</p>": "a", "<p>b</p>": "b"}.get(h, ("long " * 200_000).strip() if h and len(h) > 100 else "")) for i, h, _, x in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert H.html_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "</div>" * 50_000, "<b>" * 100_000 + "x", "<ul><li>" * 30_000 + "x", "<table><tr><td>" * 20_000 + "x", "<p><table><td>" + "<div>" * 50_000 + "x", "<blockquote>" * 50_000 + "x", "x" + "</i>" * 100_000, "<svg>" * 30_000 + "<text>x"])
def test_deep_pages_take_time_in_proportion(page):
    began = time.time()
    assert H.render(page).replace("-", "").strip() == "x"
    assert time.time() - began < 20


def test_layout_survives_depth():
    table = "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>"
    assert H.render("<div>" * 20_000 + table) == "a    bb\nccc  d"


def shown(node, rules, visible=True):
    """Texts that a page shows, from a tree of (tag, class, id, style, kids), by all rules in turn."""
    tag, cls, ident, style, kids = node
    said = {}
    weigh = lambda i, s: (("#" in s) * 4 + ("." in s) * 2 + s[0].isalpha(), i)
    for _, selector, prop, value in sorted((weigh(i, s), s, p, v) for i, (s, p, v) in enumerate(rules)):
        if selector in (tag, f".{cls}", f"#{ident}", f"{tag}.{cls}", f"{tag}#{ident}"):
            said[prop] = value
    if style:
        said[style[0]] = style[1]
    if said.get("display") == "none":
        return []
    if "visibility" in said:
        visible = said["visibility"] == "visible"
    return [x for k in kids for x in ([k] * visible if isinstance(k, str) else shown(k, rules, visible))]


def page_of(node):
    tag, cls, ident, style, kids = node
    extra = f' style="{style[0]}: {style[1]}"' if style else ""
    return f'<{tag} class="{cls}" id={ident}{extra}>' + "".join(k if isinstance(k, str) else page_of(k) for k in kids) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(40))
def test_visibility_against_a_walk(seed):
    rng = random.Random(seed)
    said = lambda: rng.choice([("display", "none"), ("display", "block"), ("visibility", "hidden"), ("visibility", "visible"), ("visibility", "collapse")])

    def tree(depth):
        kids = [tree(depth - 1) if depth and rng.random() < 0.6 else f" w{rng.randrange(10**6)} " for _ in range(rng.randrange(1, 4))]
        return rng.choice(["div", "span", "section"]), f"c{rng.randrange(4)}", f"i{rng.randrange(6)}", said() if rng.random() < 0.2 else None, kids

    root = tree(5)
    rules = [(rng.choice(["span", ".c1", ".c2", "#i3", "div.c1", "section#i2", "#i0"]), *said()) for _ in range(rng.randrange(5))]
    css = "".join(f"{s} {{ color: red; {p}: {v} !important }}" for s, p, v in rules) + "@media print { div { display: none } } div > span { display: none }"
    assert H.render(f"<style>/* div{{display:none}} */{css}</style>{page_of(root)}").split() == [w for x in shown(root, rules) for w in x.split()]


def test_spans_and_numbers():
    assert H.render("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert H.render("<table><tr><td>x<td rowspan=3 colspan=2>y<td>z<tr><td>1<td>2<tr><td>3<td>4<tr><td>5<td>6</table>") == "x  y    z\n1       2\n3       4\n5  6"
    assert H.render("<ol reversed><li>a<li>b</ol>") == "2. a\n1. b" and H.render("<ol reversed start=9><li>a<li>b</ol>") == "9. a\n8. b"
