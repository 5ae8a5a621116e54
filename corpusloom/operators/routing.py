"""Search query classification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the kinds of queries, on lower-case text, in the order in which kinds are tried.
TABLE = (
    r"\btable\b(?!\s+of\s+contents)", r"\brow\b", r"\bcolumn\b", r"\bcell\b\s+(value|content)", r"\bvalue\s+(of|for|in)\b", r"\bvalues?\s+listed\b",
    r"\bspreadsheet\b", r"\bmilestone\s+(table|list)\b", r"\bbudget\b", r"\bschedule\b\s+(table|by\s+month)",
)
SYNTHESIS = (
    r"\ball\b.*\b(subsystem|component|detector|background|source|process)", r"\bevery\b.*\b(subsystem|component|detector)", r"\beach\b.*\b(subsystem|component)",
    r"\bcompare\b", r"\bcomparison\b", r"\bdifference\s+between\b", r"\boverview\b", r"\boverall\s+design\b", r"\bsummar(y|ize)\b", r"\blist\b.*\b(all|every|main|major)\b",
    r"\bhow\s+many\s+(subsystem|component|detector)", r"\bwhat\s+are\s+the\s+(main|major|key|different)\b", r"\bentire\s+(experiment|detector|system)\b",
    r"\bfull\s+(experiment|detector|system|design)\b", r"\brelat(e|ionship)\b.*\bbetween\b", r"\bwork\s+together\b", r"\binteract\b.*\b(with|between)\b",
)
IDENTIFIER = (r"\bstand\s+for\b", r"\bacronym\b")
FIGURE = (
    r"\bfigure\b", r"\bplot\b", r"\bdiagram\b", r"\bgraph\b(?!\s*(node|relation|extract))", r"\bchart\b", r"\bimage\b", r"\bphoto\b", r"\bpicture\b", r"\bdrawing\b",
    r"\bschematic\b", r"\blayout\b", r"\bcross[- ]section\b", r"\bshow\s+me\b", r"\bwhat\s+does\s+.*\blook\s+like\b", r"\bvisual\b",
)
PROCEDURAL = (
    r"\bhow\s+(do|can|to|should)\s+(i|you|we|one)\b", r"\bhow\s+to\b", r"\bstep[s-]by[- ]step\b", r"\bsetup\b", r"\bset\s+up\b", r"\binstall(ation)?\b", r"\bconfigur(e|ation|ing)\b",
    r"\bbuild(ing)?\s+(the|offline)\b", r"\brun(ning)?\s+(a|the|job|grid)\b", r"\bsubmit(ting)?\s+(a|the|job)\b", r"\blog\s*(in|on|onto)\b", r"\bssh\b", r"\btutorial\b",
    r"\bworkflow\b", r"\bprocedure\b", r"\binstructions?\b",
)
LOOKUP = (r"^what\s+is\s+(a|an|the)?\s*\w+[\s\w]{0,30}\??\s*$", r"^define\b", r"^what\s+does\s+\w+\s+stand\s+for\b", r"^what\s+is\s+\w+\??\s*$")
#: A hyphenated identifier, and an acronym, in upper case.
HYPHENATED, ACRONYM = r"\b[A-Z][A-Z0-9]+-[A-Z0-9-]+\b", r"\b[A-Z]{3,}[0-9]*\b"
#: Most words of a query that an acronym makes a look-up of an identifier.
SHORT = 12
#: Kind, results, rerank (null: as configured), boosted doc_type or chunk strategy and its factor.
ROUTES = (
    ("table", 5, True, "table", None, 1.7),
    ("synthesis", 10, True, None, "section", 1.3),
    ("identifier", 5, False, None, None, None),
    ("figure", 5, False, "image", None, 1.5),
    ("procedural", 5, True, None, None, None),
    ("lookup", 3, False, None, None, None),
    ("factual", 5, None, None, None, None),
)


def query_kind(query: Column, site: Sequence[str] = ()) -> Column:
    """The first kind that fits a query, else factual; null fits nothing. site names what is built and run here."""
    low = F.lower(F.trim(query))
    has = lambda patterns: reduce(or_, [low.rlike(p) for p in patterns])
    own = [rf"\b(?:build(?:ing)?|run(?:ning)?)\s+\Q{s.lower()}\E\b" for s in site]
    short = query.rlike(ACRONYM) & (F.regexp_count(query, F.lit(r"\S+")) <= SHORT)
    kinds = {
        "table": has(TABLE), "synthesis": has(SYNTHESIS), "identifier": has(IDENTIFIER) | query.rlike(HYPHENATED) | short,
        "figure": has(FIGURE), "procedural": has((*PROCEDURAL, *own)), "lookup": has(LOOKUP),
    }
    return F.coalesce(*[F.when(c, k) for k, c in kinds.items()], F.lit("factual"))


def route_queries(queries: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """Queries (query) with kind, max_results, rerank, boost_type, boost_strategy and boost."""
    out = queries.withColumn("kind", query_kind(F.col("query"), site))
    names = ("max_results", "rerank", "boost_type", "boost_strategy", "boost")
    for i, (name, kind) in enumerate(zip(names, ("int", "boolean", "string", "string", "double"), strict=True), 1):
        value = F.lit(None).cast(kind)
        for r in ROUTES:
            value = F.when(F.col("kind") == r[0], F.lit(r[i]).cast(kind)).otherwise(value)
        out = out.withColumn(name, value)
    return out
