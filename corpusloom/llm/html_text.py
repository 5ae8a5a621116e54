"""Layout-aware HTML rendering.

A tree builder reads the tags, closes what HTML lets a page leave open, and knows which elements are never seen. Styles
are looked at as far as they hide: a rule for a tag, a class, an id or a tag with either, in a style element, and the
style of the element itself; what isn't displayed goes with all within, what isn't visible leaves what is made visible
in it. The rendering walks the tree, with a stack of its own, so depth is no limit: blocks stand on lines of their own, headings and paragraphs with a blank line around them, list
items have bullets or numbers and are indented by depth, table cells are aligned in columns, and preformatted text keeps
its spaces. All visible text is given: nothing is judged to be boilerplate.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import beside_ids

#: Fixed values of the HTML standard: elements by how they are shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"head", "script", "style", "template", "noscript", "title", "meta", "link", "base", "datalist", "object", "iframe", "audio", "video", "canvas", "noframes", "area", "param", "rp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "ul",
}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "hr"}
LISTS = {"ul", "ol", "menu", "dir"}
#: An open element that a start tag closes, and the elements that stop the search for it.
CLOSES = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Parents of cells, whose other contents stand before the table; the tags they hold; and what an inner tag goes back to.
PARTS = {"table", "thead", "tbody", "tfoot", "tr"}
ROWS = {"thead", "tbody", "tfoot", "table"}
BACK_TO = {"td": PARTS, "th": PARTS, "tr": ROWS, **dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup", "col"), {"table"})}
#: Foreign content: a slash ends its elements. Those of svg that aren't drawn where they stand.
FOREIGN = {"svg", "math"}
UNDRAWN = {"defs", "symbol", "clippath", "mask", "pattern", "marker", "metadata", "desc"}
SCOPE = {"table", "td", "th", "caption", "html", "template", "button", "object"}

#: Lists and tables that are laid out within each other; deeper ones have their items and cells one after the other.
DEEPEST = 100

_SPACE = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}@]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "gone", "kids", "mute", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.gone = self.mute = False

    def seen(self) -> bool:
        """Whether the element is displayed, once styled() has looked at it."""
        return not self.gone


def _declared(text: str) -> dict[str, str]:
    """What declarations say about display and visibility."""
    out = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility", "content-visibility"):
            out[name] = value.replace("!important", "").strip().lower()
    return out


def _rules(css: str) -> Iterator[tuple[str, str, str, dict[str, str]]]:
    """(tag, kind, name, declarations) of the rules for single elements that say something about display or visibility; those under conditions are passed over."""
    css, depth, plain_css = re.sub(r"/\*.*?(\*/|$)", " ", css, flags=re.DOTALL), 0, []
    for part in re.split(r"(@[^{};]*\{|@[^{};]*;|\{|\})", css):  # blocks of @ rules are left out
        if part.startswith("@"):
            depth += part.endswith("{")
        elif depth:
            depth += (part == "{") - (part == "}")
        else:
            plain_css.append(part)
    for selectors, body in _RULE.findall("".join(plain_css)):
        if said := _declared(body):
            for one in selectors.split(","):
                if (got := _SELECTOR.fullmatch(one.strip())) and one.strip():
                    yield (got[1] or "").lower(), got[2] or "", got[3] or "", said


def styled(root: Node) -> None:
    """Mark what isn't displayed as gone, and what isn't visible as mute, without the texts right in it."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            found += _rules("".join(k for k in node.kids if isinstance(k, str)))
        else:
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    rules: dict[tuple[str, str], list[tuple[int, int, str, dict[str, str]]]] = defaultdict(list)
    for i, (tag, kind, name, said) in enumerate(found):  # by what is rarest in a selector; an id outranks a class, and that a tag
        key = (kind, name) if kind else ("", tag)
        rules[key].append(({"#": 4, ".": 2, "": 0}[kind] + bool(tag), i, tag, said))
    walk = [(root, True)]
    while walk:
        node, visible = walk.pop()
        a, said = node.attrs, {}
        if rules:
            own = [("", node.tag), *((".", c) for c in (a.get("class") or "").split()), ("#", a.get("id") or "")]
            for _, _, tag, more in sorted((r for key in own for r in rules.get(key, ()) if r[2] in ("", node.tag)), key=lambda r: r[:2]):
                said |= more
        said |= _declared(a.get("style") or "")
        node.gone = (
            node.tag in UNSEEN or "hidden" in a or node.tag == "input" and (a.get("type") or "").lower() == "hidden"
            or node.tag == "dialog" and "open" not in a or said.get("display") == "none" or said.get("content-visibility") == "hidden"
        )
        if node.gone:
            continue
        if (v := said.get("visibility")) in ("visible", "hidden", "collapse"):
            visible = v == "visible"
        node.mute = not visible
        if node.mute:
            node.kids = [k for k in node.kids if isinstance(k, Node)]
        walk.extend((k, visible) for k in node.kids if isinstance(k, Node))


class TreeBuilder(HTMLParser):
    """Builds the tree of a page; end tags that match nothing are ignored, and open elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list, {"html": [0]})  # places of open elements by tag

    def _cut(self, at: int) -> None:
        """End the open elements from a place on."""
        for node in self.open[at:]:
            self.at[node.tag].pop()
        del self.open[at:]

    def _last(self, kinds: set[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of kinds; 0 for none."""
        return max((self.at[k][-1] for k in kinds if self.at.get(k)), default=0)

    def _close(self, kinds: set[str], stop: set[str]) -> None:
        """End the outermost open element of kinds that is inside the innermost of stop."""
        low, found = self._last(stop), []
        for k in kinds:
            if places := self.at.get(k):
                i = bisect.bisect_right(places, low)
                found += places[i : i + 1]
        if found:
            self._cut(min(found))

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag == "body":
                self._close({"head"}, set())
            if self.at.get(tag):
                node = self.open[self.at[tag][0]]
                node.attrs = dict(attrs) | node.attrs
                return
        elif self.open[-1].tag == "head" and tag not in UNSEEN:
            self._close({"head"}, set())
        if tag in BLOCK:
            self._close({"p"}, SCOPE)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._cut(len(self.open) - 1)
        at = self._table() if tag in BACK_TO or tag == "table" or self.open[-1].tag == "colgroup" else 0
        if at and tag in BACK_TO:
            if tag != "col" or self.open[-1].tag != "colgroup":
                self._back(BACK_TO[tag])
        elif at and self.open[-1].tag == "colgroup" and tag != "template":
            self._cut(len(self.open) - 1)
        if tag == "table" and at and self.open[-1].tag in PARTS:  # a table can't stand in a row: the open one ends
            self._cut(at)
        elif tag in CLOSES and not (at and tag in BACK_TO):
            self._close(*CLOSES[tag])
        if tag == "a":
            self._close({"a"}, SCOPE | BLOCK)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", [])
        stray = self.open[-1].tag in PARTS and tag not in BACK_TO and tag not in ("script", "style", "template")
        if stray and tag == "form" and self._table():  # is no parent of rows and cells
            return
        self._push(tag, attrs, stray)
        if tag in VOID:
            self._cut(len(self.open) - 1)

    def _table(self) -> int:
        """Where the innermost open table is; 0 if none is."""
        return self._last(("table",))

    def _back(self, kinds: set[str]) -> None:
        """End what is open inside the innermost element of kinds."""
        self._cut(self._last(kinds) + 1)

    def _add(self, node, stray: bool) -> None:
        """Put node at the end of the open element; before the table, if it is stray in one."""
        if stray and (at := self._table()):
            kids = self.open[at - 1].kids
            kids.insert(len(kids) - 1, node)  # an open table is the last of its parent
        else:
            self.open[-1].kids.append(node)

    def _push(self, tag, attrs, stray=False):
        node = Node(tag, dict(attrs))
        self._add(node, stray)
        self.at[tag].append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing but on void elements and in foreign content
        if tag not in VOID and self.open[-1].tag == tag and any(self.at.get(k) for k in FOREIGN):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag in ("html", "body"):
            return None
        at = self._last((tag,))
        if at and at >= self._last(("table",) if tag in ("table", "tr", "thead", "tbody", "tfoot", "td", "th") else ("table", "td", "th")):
            self._cut(at)
        return None

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._close({"head"}, set())
        if self.open[-1].tag == "colgroup" and data.strip():
            self._cut(len(self.open) - 1)
        stray = self.open[-1].tag in PARTS and bool(data.strip())
        self._add(f" {data} " if stray else data, stray)


class Renderer:
    """Lines of text with pending space and pending blank lines."""

    def __init__(self, nested: bool = False, depth: int = 0):
        self.lines: list[str] = []
        self.line, self.space, self.gap, self.indent, self.mark = "", False, 0, "", ""
        self.nested, self.depth = nested, depth

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " " or not s:
            self.space |= bool(s)
            return
        if (self.space or s[0] == " ") and self.line:
            self.line += " "
        self.space = s[-1] == " "
        if not self.line:
            self._begin()
        self.line += s.strip(" ")

    def _begin(self) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.line = self.indent + self.mark
        self.mark = ""

    def end(self, blank: bool = False) -> None:
        """End the line; with a blank line before what follows, if blank."""
        if self.line:
            self.lines.append(self.line.rstrip(" "))
            self.line = ""
        self.space = False
        self.gap = max(self.gap, 2 if blank else 1)

    def line_break(self) -> None:
        if not self.line:
            self._begin()
        self.lines.append(self.line.rstrip(" "))
        self.line, self.space = "", False

    def verbatim(self, text: str) -> None:
        for x in text.expandtabs(8).split("\n"):
            self._begin()
            self.lines.append((self.line + x).rstrip(" "))
            self.line = ""


#: A step of the walk over a page: it gives the steps that it waits for, one after the other.
Step = Generator["Step", None, None]


def _walk(first: Step) -> None:
    """Take a step with all that it waits for, on a stack of their own."""
    todo = [first]
    while todo:
        inner = next(todo[-1], None)
        if inner is None:
            todo.pop()
        else:
            todo.append(inner)


def _plain(node: Node) -> str:
    out, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append("\n")
        elif k.seen():
            todo.extend(reversed(k.kids))
    return "".join(out)


def _rows(table: Node) -> Iterator[Node]:
    todo = list(reversed(table.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, Node) and k.seen():
            if k.tag == "tr":
                yield k
            elif k.tag in ("thead", "tbody", "tfoot"):
                todo.extend(reversed(k.kids))


def _span(cell: Node, name: str, most: int) -> int:
    got = re.match(r"\s*(\d{1,9})", cell.attrs.get(name) or "")
    return min(int(got[1]), most) if got else 1


def _table(node: Node, r: Renderer) -> Step:
    """Cells in columns two spaces apart, as wide as the widest line of a cell that spans one column; a cell that spans rows keeps its columns in them."""
    for k in node.kids:
        if isinstance(k, Node) and k.tag == "caption" and k.seen():
            r.end()
            yield _render(k, r)
            r.end()
    grid: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}  # rows that a column is still taken for
    for row in _rows(node):
        cells, at = [], 0
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        for k in row.kids:
            if isinstance(k, Node) and k.tag in ("td", "th") and k.seen():
                if r.depth >= DEEPEST:
                    r.end()
                    yield _render(k, r)
                    continue
                inner = Renderer(depth=r.depth + 1)
                yield _render(k, inner)
                inner.end()
                while taken.get(at):
                    at += 1
                span, rows = max(1, _span(k, "colspan", 999)), _span(k, "rowspan", 65534) or 65534
                cells.append((at, list(inner.lines) or [""], span))
                if rows > 1:
                    below.update(dict.fromkeys(range(at, at + span), rows - 1))
                at += span
        if cells:
            grid.append(cells)
        taken = below
    stray = [k for k in node.kids if isinstance(k, str) and k.strip() or isinstance(k, Node) and k.tag not in ("tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col") and k.seen()]
    for k in stray:
        if isinstance(k, str):
            r.text(k)
        else:
            yield _element(k, r)
    r.end()
    widths: dict[int, int] = {}
    for cells in grid:
        for at, lines, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), *map(len, lines))
    ends = [0]
    for c in range(max((at + span for cells in grid for at, _, span in cells), default=0)):
        ends.append(ends[-1] + widths.get(c, 0) + 2)
    for cells in grid:
        for i in range(max(len(lines) for _, lines, _ in cells)):
            out = ""
            for at, lines, span in cells:
                wide = ends[at + span] - ends[at] - 2
                out = out.ljust(ends[at]) + (lines[i] if i < len(lines) else "").ljust(wide) + "  "
            if out.strip():
                r.verbatim(out.rstrip(" "))
    r.end()


def _element(k: Node, r: Renderer) -> Step:
    tag = k.tag
    if not k.seen():
        return
    if tag == "br":
        r.line_break()
        return
    if tag == "hr":
        r.end(True)
        return
    if tag == "img":
        r.text("" if k.mute else k.attrs.get("alt") or "")
        return
    if tag == "input":
        kind = (k.attrs.get("type") or "text").lower()
        if kind not in ("checkbox", "radio", "file", "password", "image", "color", "range") and not k.mute:
            r.text(f" {k.attrs.get('value') or k.attrs.get('placeholder') or ''} ")
        return
    if tag == "details" and "open" not in k.attrs:
        r.end()
        for s in k.kids:
            if isinstance(s, Node) and s.tag == "summary":
                yield _element(s, r)
                break
        r.end()
        return
    if tag == "svg":
        yield _drawing(k, r)
        return
    if tag == "semantics":  # only its first element is shown
        first = next((x for x in k.kids if isinstance(x, Node)), None)
        if first:
            yield _element(first, r)
        return
    if tag in ("mfrac", "msup", "msub", "msubsup", "mroot", "mover", "munder", "munderover", "mtr", "mtd"):
        for x in k.kids:
            if isinstance(x, str):
                r.text(x)
            else:
                yield _element(x, r)
            r.space = True
        return
    if tag == "q":
        r.text("" if k.mute else "“")
        yield _render(k, r)
        r.line += "”" if r.line and not k.mute else ""
        return
    if tag in BLOCK or tag in ("tr", "td", "th"):
        blank = tag in SPACED and not (tag in LISTS and (r.indent or r.nested))
        r.end(blank)
        before = r.indent
        if tag == "table":
            yield _table(k, r)
        elif tag in ("pre", "textarea", "listing"):
            text = _plain(k).replace("\r\n", "\n").replace("\r", "\n")
            r.verbatim(text.removeprefix("\n").rstrip("\n"))
        elif tag in LISTS:
            yield _list(k, r)
        else:
            r.indent += "  " if tag in ("blockquote", "dd") and len(r.indent) < 2 * DEEPEST else ""
            yield _render(k, r)
        r.end(blank)
        r.indent = before
        return
    yield _render(k, r)


def _drawing(node: Node, r: Renderer) -> Step:
    """The texts of an svg element, a space between them; what else it holds isn't text that is drawn."""
    for k in node.kids:
        if isinstance(k, Node) and k.seen() and k.tag not in UNDRAWN and (k.attrs.get("display") or "").strip().lower() != "none":
            if k.tag in ("text", "foreignobject"):
                r.space = True
                yield _render(k, r)
                r.space = True
            else:
                yield _drawing(k, r)


def _list(node: Node, r: Renderer) -> Step:
    got = re.match(r"\s*(-?\d{1,9})", node.attrs.get("start") or "")
    down = node.tag == "ol" and "reversed" in node.attrs
    items = sum(isinstance(k, Node) and k.tag == "li" and k.seen() for k in node.kids)
    n = int(got[1]) if got else items if down else 1
    before = r.indent
    for k in node.kids:
        if isinstance(k, str):
            r.text(k)
        elif k.tag == "li" and k.seen():
            r.end()
            v = re.match(r"\s*(-?\d{1,9})", k.attrs.get("value") or "")
            n = int(v[1]) if v and node.tag == "ol" else n
            r.mark = f"{n}. " if node.tag == "ol" else "- "
            n += -1 if down else 1
            if r.depth >= DEEPEST:
                yield _render(k, r)
                r.end()
                continue
            width = len(r.mark)
            r.indent = before
            start = len(r.lines)
            inner = Renderer(nested=True, depth=r.depth + 1)
            yield _render(k, inner)
            inner.end()
            body = inner.lines or [""]
            for i, x in enumerate(body):
                r._begin() if i == 0 else None
                r.lines.append(((r.line if i == 0 else before + " " * width) + x).rstrip(" "))
                r.line = ""
            if not any(body):
                del r.lines[start:]
            r.mark = ""
            r.gap = 1
        elif isinstance(k, Node):
            yield _element(k, r)
    r.indent = before


def _render(node: Node, r: Renderer) -> Step:
    for k in node.kids:
        if isinstance(k, str):
            r.text(k)
        else:
            yield _element(k, r)


def render(html: str | None) -> str:
    """The visible text of a page; null, empty and invisible pages give an empty text. Broken HTML is read as far as it can be."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html.replace("\x00", "�"))
    builder.close()
    styled(builder.root)
    out = Renderer()
    _walk(_element(builder.root, out))
    out.end()
    return "\n".join(out.lines).strip("\n")


def html_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """A row for each row of pages, with the column of HTML replaced by text; a column text that is there goes, all others stay as they are.

    A null, empty or invisible page gives an empty text, an empty table no rows; repeated rows and null ids are rows like
    others. Pages of any length and depth are read whole, in time in proportion to their tags.
    """
    rest = [c for c in pages.columns if c not in (column, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield beside_ids(b, {"text": pa.array([render(h) for h in b.column(column).to_pylist()], pa.string())}, carried=tuple(rest))

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in rest)
    return pages.select(*[f"`{c}`" for c in (*rest, column)]).mapInArrow(run, schema + "text string")
