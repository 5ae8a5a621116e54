"""Text of an HTML page by its tags (S3)."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is none of the page's.
UNREAD = frozenset(("script", "style", "template", "rt", "rp"))
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl dt dd table tr section article aside header footer nav main pre blockquote form fieldset figure figcaption address hr body head title".split())
#: The class of a wiki's edit marks.
EDIT_MARK = "mw-editsection"


class _Reader(HTMLParser):
    """Strings of a page in order, with what Markdown puts before them; what stands within an unread element is left out."""

    def __init__(self, markdown: bool):
        super().__init__(convert_charrefs=True)
        self.markdown = markdown
        self.parts: list[str] = []
        self.title: list[str] = []
        self.titles = 0
        self.links: dict[str, None] = {}
        self.open: list[tuple[str, bool]] = []  # name and whether it hides what is within
        self.count: Counter[str] = Counter()
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            for name, value in attrs:
                if name == "href" and value and (address := value.split("#")[0]):
                    self.links[address] = None
        if self.markdown and not self.hidden:
            if tag == "br":
                self.parts.append("\n")
            elif tag == "li":
                self.parts.append("\n- ")
            elif tag in BLOCKS:
                self.parts.append("\n\n" + ("#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else ""))
        if tag in VOID:
            return
        hides = tag in UNREAD or any(n == "class" and EDIT_MARK in (v or "").split() for n, v in attrs) or (self.markdown and tag == "title")
        self.open.append((tag, hides))
        self.count[tag] += 1
        self.hidden += hides
        self.titles += tag == "title"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        while True:
            name, hides = self.open.pop()
            self.count[name] -= 1
            self.hidden -= hides
            if name == tag:
                break
        if self.markdown and tag in BLOCKS and not self.hidden:
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.titles == 1 and self.count["title"]:
            self.title.append(data)
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data) if self.markdown else data)


def read_page(html: str, markdown: bool = True) -> tuple[str, str, list[str]]:
    """(title, text, links) of a page."""
    reader = _Reader(markdown)
    reader.feed(html)
    reader.close()
    text = "".join(reader.parts)
    if markdown:
        text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", text))
        text = re.sub(r"\n{3,}", "\n\n", text).strip()
    else:
        text = "\n".join(p for line in text.splitlines() for part in line.strip().split("  ") if (p := part.strip()))
    return " ".join("".join(reader.title).split()), text, list(reader.links)
