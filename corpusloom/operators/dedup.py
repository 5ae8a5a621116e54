"""Deduplication of knowledge-base rows and set operations (D)."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import components, cut


def latest_wins(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New and existing rows, of those with equal keys the new one; keys with a null never match."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("id"))
    ranked = both.where(known).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return ranked.unionByName(both.where(~known)).drop("__new")


def dedup_merge(new: DataFrame, existing: DataFrame, level: int) -> DataFrame:
    """D3: what to do with each new row: update the row of its identity, else of its content hash, else insert.

    Level 0 inserts always, 1 looks at identity (source_id, doc_id, parser_id), 2 at the hash, 3 at both in this order.
    """
    out = new.select("id", "source_id", "doc_id", "parser_id", "content_hash")
    by_id = existing.groupBy("source_id", "doc_id", "parser_id").agg(F.min("id").alias("same_id"))
    by_hash = existing.where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("same_hash"))
    out = out.join(by_id, ["source_id", "doc_id", "parser_id"], "left").join(by_hash, "content_hash", "left")
    target = {0: F.lit(None), 1: F.col("same_id"), 2: F.col("same_hash"), 3: F.coalesce("same_id", "same_hash")}[level].cast("long")
    return out.select("id", target.alias("target_id")).withColumn("action", F.when(F.col("target_id").isNull(), "insert").otherwise("update"))


def _by_key(events: DataFrame, key: Column) -> DataFrame:
    """Events that are matched by one key: all with a key go to the first row that has it, stored or new."""
    rows = events.withColumn("key", key)
    first = F.min(F.struct("kind", "id", "parser_id"))
    found = rows.where(F.col("key").isNotNull()).groupBy("key").agg(first.alias("first"))
    out = rows.where("kind = 1").join(found, "key", "left")
    own = F.col("first").isNull() | ((F.col("first.kind") == 1) & (F.col("first.id") == F.col("id")))
    parser = F.when(own, F.col("parser_id")).otherwise(F.col("first.parser_id"))
    return out.select("id", F.when(own, F.col("id")).otherwise(F.col("first.id")).alias("target_id"), F.when(own, "insert").otherwise("update").alias("action"), F.col("content_hash").alias("stored_hash"), parser.alias("stored_parser"))


def _replay(t: pa.Table) -> pa.Table:
    """Events of one component in order of arrival against the rows they meet; stored rows come first."""
    rows: dict[tuple, list] = {}  # (kind, id) -> [document, parser, hash]
    named: dict[tuple, list] = defaultdict(list)  # heaps of rows by (document, parser) and by hash, checked when read
    hashed: dict[str, list] = defaultdict(list)

    def first(heap: list, fits: Callable[[list], bool]) -> tuple | None:
        while heap and not fits(rows[heap[0]]):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def put(at: tuple) -> None:
        doc, parser, h = rows[at]
        if doc is not None:
            heapq.heappush(named[doc, parser], at)
        if h is not None:
            heapq.heappush(hashed[h], at)

    out = []
    for e in sorted(t.select(["kind", "id", "document", "parser_id", "content_hash"]).to_pylist(), key=lambda e: (e["kind"], e["id"])):
        at, doc, parser, h = (e["kind"], e["id"]), e["document"], e["parser_id"], e["content_hash"]
        hit = None
        if e["kind"] == 1:
            if doc is not None:
                hit = first(named[doc, parser], lambda r, d=doc, p=parser: r[0] == d and r[1] == p)
            if hit is not None:
                rows[hit][2] = h
            elif h is not None:
                hit = first(hashed[h], lambda r, h=h: r[2] == h)
                if hit is not None:  # the row takes the new name, and keeps its parser and hash
                    rows[hit][0] = doc
        if hit is None:
            rows[at] = [doc, parser, h]
        put(hit or at)
        if e["kind"] == 1:
            _, parser, h = rows[hit or at]
            out.append((e["id"], (hit or at)[1], "update" if hit else "insert", h, parser))
    names, kinds = ("id", "target_id", "action", "stored_hash", "stored_parser"), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def merge_batch(new: DataFrame, existing: DataFrame, level: int) -> DataFrame:
    """Where each row of a batch goes if the rows arrive by id, one after the other: (id, target_id, action, stored_hash, stored_parser, latest).

    Level 0 inserts all. Level 1 updates the row of the same identity (source_id, doc_id, parser_id), with its hash; level 2
    the row of the same content_hash, which takes the new source_id and doc_id but keeps hash and parser; level 3 looks
    for the identity, then for the hash. The row may be an existing one or one that the batch inserted before; of several
    the first by id, existing ones first. target_id of an insert is its own id; stored_hash and stored_parser are what the
    row has afterwards, and latest marks the last row of the batch that went there. A null or empty source_id or doc_id is
    no identity, a null parser_id is one like others; a null or empty hash matches nothing. Ids are unique on each side.

    Levels 1 and 2 are aggregations. In level 3 a match can depend on earlier ones of other keys, so documents and hashes
    are joined to components. A component that comes to one row in any order, by one hash or one identity, is an
    aggregation as well, however large; of the others only the rows whose outcome isn't that of the row before them are replayed,
    a component at a time.
    """
    names = ("id", "source_id", "doc_id", "parser_id", "content_hash")
    events = existing.select(*names).withColumn("kind", F.lit(0)).unionByName(new.select(*names).withColumn("kind", F.lit(1)))
    events = events.withColumn("content_hash", F.when(F.col("content_hash") != "", F.col("content_hash")))
    document = F.when((F.col("source_id") != "") & (F.col("doc_id") != ""), F.concat(F.length("source_id").cast("string"), F.lit(":"), "source_id", "doc_id"))
    events = events.select("kind", "id", document.alias("document"), "parser_id", "content_hash")
    identity = F.concat("document", F.coalesce(F.concat(F.lit("+"), "parser_id"), F.lit("-")))
    if level == 0:
        plan = _by_key(events, F.lit(None).cast("string"))
    elif level == 1:
        plan = _by_key(events, identity)
    elif level == 2:
        plan = _by_key(events, F.col("content_hash"))
    else:
        plan = _by_both(cut(events), identity)
    plan = cut(plan)
    last = plan.groupBy("target_id").agg(F.max("id").alias("last"))
    return plan.join(last, "target_id").select("id", "target_id", "action", "stored_hash", "stored_parser", (F.col("id") == F.col("last")).alias("latest"))


def _by_both(events: DataFrame, identity: Column) -> DataFrame:
    """Level 3 of merge_batch."""
    a, b = F.concat(F.lit("d"), "document").alias("a"), F.concat(F.lit("h"), "content_hash").alias("b")
    labels = components(events.where("document is not null and content_hash is not null").select(a, b))
    node = F.coalesce(F.concat(F.lit("d"), "document"), F.concat(F.lit("h"), "content_hash"))
    rows = events.withColumn("node", node).join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    alone = rows.where(F.col("component").isNull())  # neither name nor hash
    rows = cut(rows.where(F.col("component").isNotNull()).select("component", *events.columns))
    kinds = rows.groupBy("component").agg(
        (F.count_if(F.col("kind") == 0) <= 1).alias("fresh"),
        ((F.min("content_hash") == F.max("content_hash")) & (F.count("content_hash") == F.count(F.lit(1)))).alias("one_hash"),
        ((F.min(identity) == F.max(identity)) & (F.count("document") == F.count(F.lit(1)))).alias("one_name"),
    )
    kinds = kinds.select("component", (F.col("fresh") & F.coalesce("one_hash", F.lit(False)) | F.col("fresh") & F.coalesce("one_name", F.lit(False))).alias("simple"))
    rows = rows.join(kinds, "component")
    plain = _by_key(rows.where("simple").select("component", *events.columns), F.col("component"))
    # a document that is named once, or not at all, leaves its row as the one before it with that hash did, unless another kind of event came between
    hard = rows.where("not simple")
    named = hard.where("document is not null").groupBy("document").agg((F.count(F.lit(1)) == 1).alias("once"))
    hard = hard.join(named, "document", "left").withColumn("leaf", (F.col("kind") == 1) & F.col("content_hash").isNotNull() & F.coalesce("once", F.lit(True)))
    order = Window.partitionBy("component").orderBy("kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    hard = cut(hard.withColumn("interval", F.count_if(~F.col("leaf")).over(order)))
    leads = hard.where("leaf").groupBy("component", "content_hash", "interval").agg(F.min("id").alias("lead"))
    hard = hard.join(leads, ["component", "content_hash", "interval"], "left").withColumn("lead", F.when(F.col("leaf"), F.col("lead")))
    shape = "id long, target_id long, action string, stored_hash string, stored_parser string"
    replayed = cut(hard.where("lead is null or lead = id").select("component", *events.columns).groupBy("component").applyInArrow(_replay, shape))
    after = hard.where("lead <> id").select("id", "lead")
    others = after.join(replayed.select(F.col("id").alias("lead"), "target_id", "stored_hash", "stored_parser"), "lead")
    others = others.select("id", "target_id", F.lit("update").alias("action"), "stored_hash", "stored_parser")
    return plain.unionByName(_by_key(alone.select(*events.columns), F.lit(None).cast("string"))).unionByName(replayed).unionByName(others)


def register_raw(files: DataFrame, raw: DataFrame) -> DataFrame:
    """One file per content hash that raw lacks, the one with the smallest id."""
    first = files.groupBy("content_hash").agg(F.min("id").alias("id"))
    return files.join(first, ["content_hash", "id"], "left_semi").join(raw.select("content_hash"), "content_hash", "left_anti")


def duplicate_groups(docs: DataFrame, keys: Sequence[str], age: str = "id") -> DataFrame:
    """Rows of groups of two and more with their size and rank, the oldest first; groups with a null key are none."""
    w = Window.partitionBy(*keys)
    rows = docs.dropna(subset=list(keys)).withColumn("group_size", F.count(F.lit(1)).over(w))
    return rows.where("group_size > 1").withColumn("rank", F.row_number().over(w.orderBy(age, "id")))


def deduplicate(docs: DataFrame, rules: Sequence[Sequence[str]], age: str = "insert_time") -> DataFrame:
    """Docs without those that any rule finds to be a later copy.

    The oldest of a group by the column age, then by id, is never dropped by its rule. The oldest is found by an
    aggregation that combines on the map side, so a group of any size is no task of its own.
    """
    for keys in rules:
        oldest = docs.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(F.struct(age, "id")).alias("__oldest"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
        later = docs.join(oldest, list(keys)).where(F.col("id") != F.col("__oldest.id")).select("id")
        docs = docs.join(later, "id", "left_anti")
    return docs


def common_keys(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that all tables have."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.intersect(t.select(key))
    return out.distinct()


def pending(matched: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Matched rows that nobody has decided on."""
    return matched.join(decided.select(key), key, "left_anti")
