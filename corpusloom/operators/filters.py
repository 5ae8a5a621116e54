"""The metadata filter language as Column expressions, and the listings that use it (F).

Direct columns keep their type. Any other field is a key of the JSON column meta and is compared as text. Catalyst gets
plain predicates, so comparisons with direct columns reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT = frozenset({"id", "doc_id", "source_id", "parser_id", "doc_type", "n_chars", "insert_time", "doc_time"})
CLAUSES = ("term", "terms", "range", "match", "wildcard")


class FilterError(ValueError):
    """A filter that can't be read."""


def field(name: str, direct: frozenset[str] = DIRECT) -> Column:
    return F.col(name) if name in direct else F.get_json_object("meta", f"$.{name}")


def _value(name: str, v: object, direct: frozenset[str]) -> Column:
    return F.lit(v if name in direct else v if isinstance(v, str) else str(v))


def _one(body: Mapping, clause: str) -> tuple[str, object]:
    if not isinstance(body, Mapping) or len(body) != 1:
        raise FilterError(f"{clause} takes one field")
    return next(iter(body.items()))


def predicate(query: Mapping, direct: frozenset[str] = DIRECT) -> Column:
    """Term, terms, range, match, wildcard and bool as a condition; null fields satisfy no condition."""
    clause, body = _one(query, "a filter")
    if clause == "bool":
        return _bool(body, direct)
    if clause not in CLAUSES:
        raise FilterError(f"unknown clause {clause!r}")
    name, v = _one(body, clause)
    c = field(name, direct)
    if clause == "term":
        return c == _value(name, v, direct)
    if clause == "terms":
        if not v:
            raise FilterError("terms needs a value")
        return c.isin([x if name in direct else str(x) for x in v])
    if clause == "range":
        ops = {"gte": c.__ge__, "gt": c.__gt__, "lte": c.__le__, "lt": c.__lt__}
        if not v or set(v) - set(ops):
            raise FilterError("range takes gte, gt, lte and lt")
        return reduce(and_, [ops[k](_value(name, x, direct)) for k, x in v.items()])
    if clause == "match":
        return c.cast("string").like(f"%{v}%")
    pattern = v["value"] if isinstance(v, Mapping) else v
    return c.cast("string").like(pattern.replace("*", "%").replace("?", "_"))


def _bool(body: Mapping, direct: frozenset[str]) -> Column:
    if set(body) - {"must", "should", "must_not", "minimum_should_match"}:
        raise FilterError("unknown part of bool")
    listed = lambda k: [body[k]] if isinstance(body.get(k), Mapping) else list(body.get(k) or ())
    parts = [predicate(q, direct) for q in listed("must")]
    if should := [predicate(q, direct) for q in listed("should")]:
        parts.append(reduce(and_ if body.get("minimum_should_match", 1) >= len(should) else or_, should))
    parts += [~predicate(q, direct) for q in listed("must_not")]
    return reduce(and_, parts, F.lit(True))


def build_predicate(source: str | None = None, doc_type: str | None = None, parser: str | None = None, strategy: str | None = None, query: Mapping | None = None, **meta: object) -> Column:
    """F8: the conjunction of the given constraints, a filter and key=value metadata."""
    named = (("source_id", source), ("doc_type", doc_type), ("parser_id", parser), ("chunk_strategy", strategy))
    parts = [F.col(k) == F.lit(v) for k, v in named if v is not None]
    parts += [predicate(query)] if query else []
    parts += [field(k) == _value(k, v, DIRECT) for k, v in meta.items()]
    return reduce(and_, parts, F.lit(True))


def visible(df: DataFrame, current: DataFrame, flag: str = "visible_search") -> DataFrame:
    """Rows without a decision (raw_id), or with a null one, are visible."""
    state = current.select("raw_id", F.col(flag).alias("__shown"))
    return df.join(state, "raw_id", "left").where(F.coalesce("__shown", F.lit(True))).drop("__shown")


def coarse_constraints(query: Mapping | None) -> dict[str, set] | None:
    """The sources and types that a filter allows if it constrains nothing else, else None."""
    out: dict[str, set] = {}

    def read(q: Mapping) -> bool:
        clause, body = _one(q, "a filter")
        if clause == "bool":
            musts = body.get("must") or []
            return set(body) <= {"must"} and all(read(x) for x in ([musts] if isinstance(musts, Mapping) else musts))
        if clause not in ("term", "terms"):
            return False
        name, v = _one(body, clause)
        if name not in ("source_id", "doc_type"):
            return False
        new = set(v) if clause == "terms" else {v}
        out[name] = out[name] & new if name in out else new
        return True

    return out if not query or read(query) else None


def coarse_count(counts: DataFrame, allowed: Mapping[str, set]) -> DataFrame:
    """rows that pass, from counts (source_id, doc_type, n) made beforehand."""
    keep = reduce(and_, [F.col(k).isin(list(v)) for k, v in allowed.items()], F.lit(True))
    return counts.where(keep).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def list_filtered(docs: DataFrame, where: Column, n: int, newest: str = "insert_time") -> DataFrame:
    """passing rows, newest first, id last."""
    return docs.where(where).orderBy(F.col(newest).desc(), "id").limit(n)


def get_documents(docs: DataFrame, where: Column | None = None, text_contains: str | None = None, order: str = "id", limit: int = 20, offset: int = 0) -> DataFrame:
    """a page of documents."""
    docs = docs if where is None else docs.where(where)
    docs = docs if text_contains is None else docs.where(F.col("text").contains(text_contains))
    return docs.orderBy(order, "id").offset(offset).limit(limit)


def names_field(query: object, field: str) -> bool:
    """Whether any clause of a filter is on the field."""
    if isinstance(query, Mapping):
        return any((k in CLAUSES and isinstance(v, Mapping) and field in v) or names_field(v, field) for k, v in query.items())
    return isinstance(query, list | tuple) and any(names_field(q, field) for q in query)


def exclude_images(query: Mapping | None, boosts_images: bool = False) -> Mapping | None:
    """the filter with images excluded, unless it names doc_type or images are wanted."""
    if boosts_images or names_field(query, "doc_type"):
        return query
    no = {"term": {"doc_type": "image"}}
    return {"bool": {"must": [query] if query else [], "must_not": [no]}}


def list_logs(logs: Mapping[str, DataFrame], where: Column | None = None, n: int = 100, offset: int = 0, time: str = "created_time") -> DataFrame:
    """logs of all kinds in one listing with a column kind, newest first."""
    rows = [df.withColumn("kind", F.lit(k)) for k, df in logs.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    out = out if where is None else out.where(where)
    return out.orderBy(F.col(time).desc(), "id").offset(offset).limit(n)


def children(docs: DataFrame, parent: object) -> DataFrame:
    """F15."""
    return docs.where(F.col("parent_id") == F.lit(parent))


def siblings(docs: DataFrame) -> DataFrame:
    """pairs of documents parsed from one raw document: (id, sibling_id)."""
    other = docs.select("raw_id", F.col("id").alias("sibling_id"))
    return docs.select("raw_id", "id").join(other, "raw_id").where("id <> sibling_id").select("id", "sibling_id")

