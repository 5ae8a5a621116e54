"""Knowledge-graph operators (G)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .search import knn_exact, knn_ivf


def validate_triples(triples: DataFrame, types: Sequence[str], verbs: Sequence[str], confidence: float = 0.8) -> DataFrame:
    """Triples with all parts, known types and verbs; a missing confidence gets a default."""
    whole = F.col("source_node").isNotNull() & F.col("target_node").isNotNull() & F.col("verb").isin(list(verbs)) & F.col("source_type").isin(list(types)) & F.col("target_type").isin(list(types))
    return triples.where(whole).withColumn("confidence", F.coalesce("confidence", F.lit(confidence)))


def merge_relations(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """G1: one row for each (source, verb, target) with evidence and whether it is created or updated."""
    keys = ["source_node", "verb", "target_node"]
    # both in one aggregation, so that nothing is sorted or joined; a key with a null is no known one
    new = triples.select(*keys, F.lit(1).cast("long").alias("n"), "confidence", F.lit(False).alias("known"))
    old = relations.select(*keys, F.lit(0).cast("long").alias("n"), F.lit(None).cast(triples.schema["confidence"].dataType).alias("confidence"), F.lit(True).alias("known"))
    both = new.unionByName(old).groupBy(*keys).agg(F.sum("n").alias("evidence"), F.max("confidence").alias("confidence"), F.bool_or("known").alias("known")).where("evidence > 0")
    known = F.col("known") & reduce(and_, [F.col(c).isNotNull() for c in keys])
    return both.select(*keys, "evidence", "confidence", F.when(known, "update").otherwise("create").alias("action"))


def append_evidence(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """G1: relations (source_node, verb, target_node, evidence, confidence) after new triples: all of them, with their evidence and that of the new ones.

    action is create for new relations, update for known ones with new evidence, keep for others; confidence is the largest seen.
    """
    keys = ["source_node", "verb", "target_node"]
    new = triples.select(*keys, F.lit(1).cast("long").alias("evidence"), "confidence", F.lit(1).alias("new"))
    old = relations.select(*keys, F.col("evidence").cast("long").alias("evidence"), "confidence", F.lit(0).alias("new"))
    both = old.unionByName(new).groupBy(*keys).agg(F.sum("evidence").alias("evidence"), F.max("confidence").alias("confidence"), F.min("new").alias("first"), F.max("new").alias("last"))
    action = F.when(F.col("first") == 1, "create").when(F.col("last") == 1, "update").otherwise("keep")
    return both.select(*keys, "evidence", "confidence", action.alias("action"))


def resolve_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names (name, type_id) to nodes by canonical name, then by alias, else new; the smallest node of several."""
    by_name = nodes.groupBy(F.col("canonical_name").alias("name"), "type_id").agg(F.min("node_id").alias("by_name"))
    by_alias = nodes.select("type_id", "node_id", F.explode("aliases").alias("name")).groupBy("name", "type_id").agg(F.min("node_id").alias("by_alias"))
    out = names.join(by_name, ["name", "type_id"], "left").join(by_alias, ["name", "type_id"], "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").otherwise("new")
    return out.select("name", "type_id", F.coalesce("by_name", "by_alias").alias("node_id"), how.alias("how"))


def resolve_by_vector(names: DataFrame, nodes: DataFrame, least: float = 0.85, index: DataFrame | None = None, centroids: DataFrame | None = None, probes: int = 0) -> DataFrame:
    """G2 in full: (name, type_id, node_id, how, score): by canonical name, alias, or the nearest vector of the type, else new.

    names is (name, type_id, embedding), nodes also has embedding. What neither name nor alias finds goes to the nearest
    node of its type with a similarity (of six digits) of least or more, the smallest node of equally near ones: how is vector. A null
    embedding finds nothing. Names are one row for each (name, type_id). By default all nodes are looked at; with index
    and centroids (ivf_index over nodes as chunk_id) only those in the probes lists nearest to a name.
    """
    vectors = cut(names.groupBy("name", "type_id").agg(F.first("embedding", ignorenulls=True).alias("embedding")))
    out = cut(resolve_nodes(vectors.select("name", "type_id"), nodes))
    left = cut(vectors.join(out.where("how = 'new'").select("name", "type_id"), ["name", "type_id"]).where("embedding is not null").withColumn("query_id", F.monotonically_increasing_id()))
    asked = left.select("query_id", "type_id", F.col("embedding").alias("query"))
    if index is None:
        pool = nodes.select(F.col("node_id").alias("chunk_id"), "type_id", "embedding")
        near = knn_exact(pool, asked, 1, same="type_id", least=least)
    else:
        near = knn_ivf(index, centroids, asked, 1, probes, same="type_id").where(F.col("score") >= least)
    found = left.join(near, "query_id").select("name", "type_id", F.col("chunk_id").alias("near"), "score")
    out = out.join(found, ["name", "type_id"], "left")
    how = F.when(F.col("near").isNotNull(), "vector").otherwise(F.col("how"))
    return out.select("name", "type_id", F.coalesce("node_id", "near").alias("node_id"), how.alias("how"), "score")


def add_aliases(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Nodes with the names that found them by vector among their aliases, each once, behind those they had."""
    new = resolved.where("how = 'vector'").groupBy("node_id").agg(F.array_sort(F.collect_set("name")).alias("__new"))
    rows = nodes.join(new, "node_id", "left")
    more = F.array_except(F.coalesce("__new", F.array().cast("array<string>")), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical_name")))
    return rows.withColumn("aliases", F.when(F.size(more) > 0, F.concat(F.coalesce("aliases", F.array().cast("array<string>")), more)).otherwise(F.col("aliases"))).drop("__new")


def nodes_for_document(mentions: DataFrame, document: object) -> DataFrame:
    """G3."""
    return mentions.where(F.col("document_id") == F.lit(document)).orderBy(F.desc("mentions"), "node")


def documents_for_node(mentions: DataFrame, node: object) -> DataFrame:
    """G4."""
    return mentions.where(F.col("node") == F.lit(node)).orderBy(F.desc("mentions"), "document_id")


def node_profile(relations: DataFrame) -> DataFrame:
    """Relations out of a node with the largest confidence, into it with the mean one."""
    out = relations.groupBy(F.col("source_node").alias("node"), F.lit("out").alias("direction"), "verb").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
    into = relations.groupBy(F.col("target_node").alias("node"), F.lit("in").alias("direction"), "verb").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
    return out.unionByName(into)


def _distances(both: DataFrame, node: object, depth: int, name: str) -> DataFrame:
    """(a, name): steps from node of all nodes within depth."""
    out = both.sparkSession.range(1).select(F.lit(node).alias("a"), F.lit(0).alias(name))
    front = out
    for i in range(1, depth + 1):
        front = front.select("a").join(both, "a").select(F.col("b").alias("a")).distinct().join(out.select("a"), "a", "left_anti").withColumn(name, F.lit(i))
        front = cut(front)
        out = out.unionByName(front)
    return cut(out)


def find_paths(edges: DataFrame, start: object, goal: object, depth: int = 4, n: int = 10) -> DataFrame:
    """Simple undirected paths from start to goal of at most depth steps, shortest first, ties by the nodes in turn.

    First the distance of each node from both ends, within what depth leaves; then a path goes on only to nodes from
    which the goal is still in reach, so no row is made that can't arrive. A depth at which n paths have arrived is the last: others are longer.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    home = _distances(both, goal, depth - 1, "left")
    away = _distances(both, start, depth - 1, "gone")
    useful = away.join(home, "a").where(F.col("gone") + F.col("left") <= depth).select(F.col("a").alias("b"), "left")
    ends = edges.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(x).alias("b"), F.lit(d).alias("left")) for x, d in ((goal, 0), (start, depth))])).alias("x")).select("x.*")
    useful = useful.union(ends).groupBy("b").agg(F.min("left").alias("left"))
    steps = cut(both.join(useful, "b").join(useful.select(F.col("b").alias("a")), "a", "left_semi").select("a", "b", "left"))
    at = edges.sparkSession.range(1).select(F.array(F.lit(start)).alias("path"), F.lit(start).alias("a"))
    found = None
    for i in range(1, depth + 1):
        at = at.where(F.col("a") != F.lit(goal)).join(steps.where(F.col("left") <= depth - i), "a").where(~F.array_contains("path", F.col("b")))
        at = cut(at.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("a")))
        hit = at.where(F.col("a") == F.lit(goal)).select("path", F.lit(i).alias("steps"))
        found = hit if found is None else found.unionByName(hit)
        if i < depth and found.limit(n).count() == n:
            break
    return found.orderBy("steps", "path").limit(n)


def relation_evidence(evidence: DataFrame, relation: object) -> DataFrame:
    """G7."""
    return evidence.where(F.col("relation_id") == F.lit(relation)).orderBy(F.desc("confidence"), "evidence_id")


def seed_ontology(wanted: DataFrame, there: DataFrame, key: str = "name") -> DataFrame:
    """Rows that are still missing; a second run adds none."""
    return wanted.dropDuplicates([key]).join(there.select(key), key, "left_anti")
