"""Text and metadata expressions that stay in the JVM (P)."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode ranges that mathematics is written in: mathematical letters, Greek, operators, arrows, combining
#: marks, raised and lowered digits, letterlike symbols, and signs of Latin-1.
MATH_RANGES = r"\x{1D400}-\x{1D7FF}\x{370}-\x{3FF}\x{2200}-\x{22FF}\x{2190}-\x{21FF}\x{300}-\x{36F}\x{2070}-\x{209F}\x{2100}-\x{214F}\x{B0}-\x{BF}"
MATH_SHARE = 0.0005
#: Strategies whose chunks carry their own context, and what older prefixed chunks begin with.
SPECIAL_STRATEGIES, PREFIXES = ("summary", "image", "table"), ("Section:", "Context:")


def sanitize(c: Column) -> Column:
    """Without NUL characters."""
    return F.replace(c, F.lit("\x00"), F.lit(""))


def content_hash(text: Column, binary: Column | None = None) -> Column:
    """SHA-256 of the UTF-8 text, else of the bytes."""
    raw = text.cast("binary")
    return F.sha2(raw if binary is None else F.coalesce(raw, binary), 256)


def clean_equations(c: Column) -> Column:
    """Embedded formulas, in latexit tags on one line, become [equation]."""
    return F.regexp_replace(c, r"<latexit[^>]*>.*?</latexit>", "[equation]")


def slides_to_markdown(c: Column) -> Column:
    """P5: the first line of a slide is its title; bullets become list items, of a second level after a ring.

    A line that doesn't begin with a capital goes on with the item before it; a bare bullet goes; an empty line ends a list.
    """
    rest = lambda x: F.trim(F.substring(x, 2, 1 << 30))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("listed"))

    def add(acc: Column, x: Column) -> Column:
        def put(line: Column, listed: bool) -> Column:
            return F.struct(F.concat(acc["out"], F.array(line)).alias("out"), F.lit(listed).alias("listed"))

        first = F.substring(x, 1, 1)
        capital = (F.upper(first) == first) & (F.lower(first) != first)
        last = F.concat(F.element_at(acc["out"], -1), F.lit(" "), x)
        joined = F.struct(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(last)).alias("out"), F.lit(True).alias("listed"))
        return (
            F.when((x == "") & acc["listed"], put(F.lit(""), False))
            .when(x == "", acc)
            .when(F.size(acc["out"]) == 0, put(F.concat(F.lit("# "), x), False))
            .when(first.isin("•", "-", "●"), F.when(rest(x) == "", acc).otherwise(put(F.concat(F.lit("- "), rest(x)), True)))
            .when(acc["listed"] & ~capital, joined)
            .when(first == "○", F.when(rest(x) == "", acc).otherwise(put(F.concat(F.lit("    - "), rest(x)), True)))
            .otherwise(put(x, False))
        )

    lines = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.aggregate(lines, start, add, lambda acc: F.array_join(acc["out"], "\n"))


def math_density(c: Column) -> Column:
    """Share of mathematical characters; 0 for no text."""
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, f"[^{MATH_RANGES}]", "")) / n).otherwise(F.lit(0.0))


def prose_words_per_kchar(c: Column) -> Column:
    """Words of four letters and more in 1,000 characters."""
    n = F.length(c)
    return F.when(n > 0, 1000.0 * F.regexp_count(c, F.lit(r"\p{L}{4,}")) / n).otherwise(F.lit(0.0))


def entry_key(source: Column, doc_id: Column) -> Column:
    """Source and leading number of a doc_id, or the whole id if there is none; the pattern is a fixed value."""
    lead = F.regexp_extract(doc_id, r"^(\d+)(?:[-/_]|$)", 1)
    return F.concat_ws(":", source, F.when(lead != "", lead).otherwise(doc_id))


def base_strategy(c: Column) -> Column:
    """The name of a strategy without the window of a summary."""
    return F.regexp_replace(c, r"^(summary)_\d+$", "$1")


def embed_text(text: Column, section: Column, context: Column, strategy: Column | None = None) -> Column:
    """P10: text with its section and context before it, as far as they are known.

    Chunks of the special strategies, and those that begin with such a prefix already, stay as they are; null is empty.
    """
    part = lambda label, c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(f"{label}: "), c))
    clean = F.coalesce(text, F.lit(""))
    as_is = F.startswith(clean, F.lit(PREFIXES[0])) | F.startswith(clean, F.lit(PREFIXES[1]))
    if strategy is not None:
        as_is = as_is | F.coalesce(base_strategy(strategy).isin(*SPECIAL_STRATEGIES), F.lit(False))
    return F.when(as_is, clean).otherwise(F.concat_ws("\n\n", part("Section", section), part("Context", context), clean))


def provenance(doc_type: Column, meta: Column) -> Column:
    """Where a document comes from, out of its metadata; an empty caption is none."""
    get = lambda k: F.get_json_object(meta, f"$.{k}")
    number = lambda k: get(k).try_cast("int").alias(k)
    caption = F.when(get("caption") != "", get("caption")).alias("caption")
    return F.struct(doc_type.alias("doc_type"), *map(number, ("page", "page_start", "page_end")), get("section_title").alias("section_title"), *map(number, ("level", "num_rows", "num_cols")), caption)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """The characters from start up to end, counted from 0."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose into one character and marks, and those characters."""
    pairs = []
    for c in map(chr, range(0xC0, 0x10000)):
        bare = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(bare) == 1 and bare[0] != c:
            pairs.append((c, bare[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def canonical_name(c: Column) -> Column:
    """Lower case, accents and combining marks dropped, white space squeezed; null becomes empty."""
    bare = F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), *_accents()), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def expand_abbreviation(df: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """Names that mapping (short, long) knows, with or without 'the', become the long form."""
    key = F.regexp_replace(canonical_name(F.col(name)), "^the ", "")
    return df.withColumn("short", key).join(mapping, "short", "left").withColumn(name, F.coalesce("long", name)).drop("short", "long")


def fill_markers(text: Column, marker: str, values: Column) -> Column:
    """The n-th marker becomes the n-th value; markers beyond the last value stay."""
    parts = F.split(text, rf"\Q{marker}\E", -1)
    n = F.size(parts)
    filled = F.transform(parts, lambda p, i: F.when(i < n - 1, F.concat(p, F.coalesce(F.get(values, i), F.lit(marker)))).otherwise(p))
    return F.array_join(filled, "")


def count_tokens(c: Column) -> Column:
    """Runs of non-space."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def is_redundant(a: Column, b: Column) -> Column:
    """Whether b contains a, with white space squeezed."""
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.contains(norm(b), norm(a))


def page_text(text: Column, offset: int, n: int = 100_000, most: int = 400_000) -> Column:
    """A page of a text and where the next one begins, null at the end."""
    n = min(n, most)
    return F.struct(F.substring(text, offset + 1, n).alias("page"), F.when(F.length(text) > offset + n, F.lit(offset + n)).alias("next_offset"))


def evidence_found(quote: Column, text: Column, long: int = 60, stride: int = 20) -> Column:
    """P20: whether every piece of a quote (split at '...') is in text, a long one by any stretch of it."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    hay = norm(text)
    pieces = F.filter(F.transform(F.split(quote, r"\.{3,}|…"), norm), lambda p: F.length(p) > 0)

    def found(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(p) - long, F.lit(0)), F.lit(stride))
        return F.contains(hay, p) | ((F.length(p) > long) & F.exists(starts, lambda i: F.contains(hay, F.substring(p, i + 1, F.lit(long)))))

    return (F.size(pieces) > 0) & F.forall(pieces, found)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """V1: cosine similarity; 0 where a norm is 0. Norms, sqrt(dot(x, x)), can be given if they are known."""
    norm = (F.sqrt(dot(a, a)) if norm_a is None else norm_a) * (F.sqrt(dot(b, b)) if norm_b is None else norm_b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def replace_inline(text: Column, image_ref: Column, alt: Column) -> Column:
    """Text with the description of an inline image replaced: ![...](link) [image_id:image_ref ...].

    The description goes back to the nearest '![', so one with brackets is replaced whole. White space in alt is squeezed.
    """
    quoted = F.regexp_replace(image_ref, r"([^\p{L}\p{N}_])", r"\\$1")
    pattern = F.concat(F.lit(r"(?s)!\[(?:(?!!\[).)*?\]\(([^()\s]*)\) \[image_id:"), quoted, F.lit(r"(?=[\] ])"))
    clean = F.replace(F.trim(F.regexp_replace(alt, r"\s+", " ")), F.lit("]("), F.lit("] ("))
    literal = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, pattern, F.concat(F.lit("!["), literal(clean), F.lit("]($1) [image_id:"), literal(image_ref)))


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0), F.lower)
