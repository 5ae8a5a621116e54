"""Merkle manifest of a dataset: a digest for each row, a tree for each group of rows, one root for all.

Rows are leaves. In a group they stand in order, and while there is more than one node, each FANOUT consecutive ones
become the digest of their concatenated digests; what remains is the group's subroot. Subroots in the order of their
groups make a tree of the same kind. A leaf's proof has the other nodes of its run at each level, so that whoever has a
row, its proof and the root can tell whether the row is what it was.

Partitions are aligned blocks of FANOUT ** BLOCK_LEVELS consecutive leaves, each built by one task. Above them the
blocks exchange roots like a butterfly: in round r a block meets the blocks whose numbers differ from its own in digit r
only, FANOUT at most; each such group swaps the roots of the subtrees that its members stand for, and hashes their
ancestor for itself. After the last round each block has its whole upper proof, without a pass down from the root. Of
the last subtree of a tree, which may lack members, those that are there meet the groups of the missing ones as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fitted, numbered

FANOUT, BLOCK_LEVELS = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of roots with their proofs, of some KB each, up to which they are broadcast.
FETCH_ROWS = 5_000
PROOF = "array<struct<place:int,others:array<string>>>"


def leaf_digest(*columns: Column) -> Column:
    """sha256 of the values in turn, each as its number of UTF-8 bytes, a colon and itself; a null is a dash."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)), 256)


def fold(leaf: Column, proof: Column, fanout: int = FANOUT) -> Column:
    """The root that a leaf and its proof lead to."""
    left = lambda p: F.array_join(F.slice(p["others"], F.lit(1), p["place"]), "")
    right = lambda p: F.array_join(F.slice(p["others"], p["place"] + 1, F.lit(fanout)), "")
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(left(p), h, right(p)), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda p: p["others"])), ""), 256)


def _height(size: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return sum(((size > F.lit(p)).cast("int") for p in powers), F.lit(0))


def _levels(digests: list[str], height: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from digests up to so many levels above them."""
    out = [digests]
    for _ in range(height):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _exchange(blocks: DataFrame, fanout: int, scratch: Scratch) -> DataFrame:
    """blocks (tree, block, blocks, digest) with proof, the upper one of each block, and digest, the root of its tree."""
    rows = scratch.keep(blocks.withColumn("proof", F.array().cast(PROOF)))
    most = rows.agg(F.max("blocks")).first()[0] or 0
    width = 1  # blocks of a subtree in this round
    while width < most:
        subtree, subtrees = F.floor(F.col("block") / width), F.ceil(F.col("blocks") / width)
        going = rows.where(F.col("blocks") > width).withColumn("subtree", subtree.cast("long"))
        low, last = F.col("block") % width, F.col("subtree") == subtrees - 1
        there = F.col("blocks") - F.col("subtree") * width  # members of the last subtree
        meets = F.when(last & (F.col("subtree") % fanout > 0) & (there < width), F.sequence(low, F.lit(width - 1).cast("long"), F.greatest(there, F.lit(1)))).otherwise(F.array(low))
        sent = going.withColumn("with", F.explode(meets)).withColumn("group", F.floor(F.col("subtree") / fanout))
        own = F.when(F.col("with") == low, F.struct("block", "blocks", "subtree", "proof"))
        met = sent.groupBy("tree", "group", "with").agg(F.array_sort(F.collect_set(F.struct("subtree", "digest"))).alias("nodes"), F.collect_list(own).alias("members"))
        met = met.withColumn("digest", F.sha2(F.array_join(F.transform("nodes", lambda x: x["digest"]), ""), 256)).withColumn("m", F.explode("members"))
        others = F.transform(F.filter("nodes", lambda x: x["subtree"] != F.col("m.subtree")), lambda x: x["digest"])
        step = F.struct((F.col("m.subtree") % fanout).cast("int").alias("place"), others.alias("others"))
        done = met.select("tree", "m.block", "m.blocks", "digest", F.concat("m.proof", F.array(step)).cast(PROOF).alias("proof"))
        after = scratch.keep(done.union(rows.where(F.col("blocks") <= width).select("tree", "block", "blocks", "digest", "proof")))
        scratch.drop(rows)
        rows, width = after, width * fanout
    return rows


def _proven(leaves: DataFrame, scratch: Scratch, fanout: int, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """(leaves with block and height, crowns): leaves has tree, pos, size, digest; crowns (tree, block, digest, proof) what is above each block."""
    width = fanout**block_levels
    leaves = leaves.withColumn("block", F.floor(F.col("pos") / width)).withColumn("height", F.least(_height(F.col("size"), fanout), F.lit(block_levels)))

    def root(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t["pos"].to_numpy())
        nodes = _levels(t["digest"].take(order).to_pylist(), t["height"][0].as_py(), fanout)[-1]
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "blocks": [-(-t["size"][0].as_py() // width)], "digest": nodes})

    own = leaves.select("tree", "block", "pos", "size", "height", "digest").groupBy("tree", "block")
    return leaves, _exchange(own.applyInArrow(root, "tree string, block long, blocks long, digest string"), fanout, scratch)


def _with_proofs(leaves: DataFrame, crowns: DataFrame, fanout: int) -> DataFrame:
    """(carried, digest, subroot, root, proof) for each of leaves, by the crown (subroot, root, proof) of its block."""
    kept = leaves.select("tree", "block", "pos", "height", "digest", "carried")

    def build(leaf: pa.Table, crown: pa.Table) -> pa.Table:
        order = np.argsort(leaf["pos"].to_numpy())
        leaf = leaf.take(order).combine_chunks()
        n = len(leaf)
        height = leaf["height"][0].as_py() if n else 0
        levels = _levels(leaf["digest"].to_pylist(), height, fanout)
        upper = crown["proof"][0].as_py() if n else []
        nodes = [d for level in levels for d in level]
        above = len(nodes)  # the upper proof's nodes stand behind those of the block
        nodes += [d for p in upper for d in p["others"]]
        crowned, at = [], above
        for p in upper:
            crowned.append((p["place"], list(range(at, at + len(p["others"])))))
            at += len(p["others"])
        places, counts, others = [], [], []
        for i in range(n):
            begin, j = 0, i
            for level in levels[:height]:
                run = j // fanout * fanout
                end = min(run + fanout, len(level))
                places.append(j - run)
                counts.append(end - run - 1)
                others.extend(range(begin + run, begin + j))
                others.extend(range(begin + j + 1, begin + end))
                begin, j = begin + len(level), j // fanout
            for place, at in crowned:
                places.append(place)
                counts.append(len(at))
                others.extend(at)
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes, pa.string()).take(pa.array(others, pa.int64())))
        steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), lists], ["place", "others"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (height + len(upper))), steps)
        same = lambda c: pa.array([crown[c][0].as_py() if n else None] * n, pa.string())
        return pa.table({"carried": leaf["carried"], "digest": leaf["digest"], "subroot": same("subroot"), "root": same("root"), "proof": proof})

    kind = kept.schema["carried"].dataType.simpleString()
    by = ("tree", "block")
    return kept.groupBy(*by).cogroup(crowns.groupBy(*by)).applyInArrow(build, f"carried {kind}, digest string, subroot string, root string, proof {PROOF}")


def merkle_manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """A row for each row of docs: order, group, the columns of carry, leaf, subroot, root, proof.

    A leaf is the leaf_digest of columns. The leaves of a group follow order, nulls first; rows that share it follow
    their digests, and equal rows are equal leaves. Groups follow their UTF-8 bytes, null, which is a group, first. proof
    has (place, others) for each level: the digests of the run's other nodes, place of them on the left. carry adds
    columns that are computed from docs in the same pass. Nulls, empty and long texts are values like others; other
    columns are ignored, whatever their names; an empty table has no rows and no root.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    tree = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("-"))  # in the order of groups, null first
    carried = F.struct(F.col(order), F.col(group), *[c.alias(name) for name, c in (carry or {}).items()])
    leaves = scratch.keep(docs.select(tree.alias("tree"), F.col(order).alias("at"), leaf_digest(*map(F.col, columns)).alias("digest"), carried.alias("carried")))
    placed = scratch.keep(numbered(leaves, "tree", [F.col("at").asc_nulls_first(), F.col("digest").asc()], scratch).drop("at"))
    placed, crowns = _proven(placed, scratch, fanout, block_levels)
    # the subroots are the leaves of the tree above
    tops = scratch.keep(crowns.where("block = 0").select(F.lit("").alias("tree"), F.struct("tree").alias("carried"), "digest"))
    tops, above = _proven(scratch.keep(numbered(tops, "tree", [F.col("carried.tree").asc()], scratch)), scratch, fanout, block_levels)
    above = above.select("tree", "block", F.col("digest").alias("root"), F.col("digest").alias("subroot"), "proof")
    roots = scratch.keep(_with_proofs(tops, above, fanout).select("carried.tree", "digest", "root", F.col("proof").alias("to_root")))
    crowns = crowns.drop("digest").join(fitted(roots, FETCH_ROWS), "tree")
    crowns = scratch.keep(crowns.select("tree", "block", F.col("digest").alias("subroot"), "root", F.concat("proof", "to_root").alias("proof")))
    out = _with_proofs(placed, crowns, fanout)
    return out.select(f"carried.{order}", f"carried.{group}", *[f"carried.`{c}`" for c in carry or {}], F.col("digest").alias("leaf"), "subroot", "root", "proof")


def verify_tampered(docs: DataFrame, tampered: Column, altered: dict[str, Column], **options) -> DataFrame:
    """merkle_manifest of docs with shown, the leaf of the row as it is found, folded_root and verified.

    Where tampered holds a row is found with the values of altered in place of its own, else as it was; a row is
    verified if its leaf and the original siblings fold to the root.
    """
    columns = options.get("columns", COLUMNS)
    found = leaf_digest(*[altered.get(c, F.col(c)) for c in columns])
    rows = merkle_manifest(docs, carry={"shown": F.when(tampered, found)}, **options)
    rows = rows.withColumn("shown", F.coalesce("shown", "leaf"))
    rows = rows.withColumn("folded_root", fold(F.col("shown"), F.col("proof"), options.get("fanout", FANOUT)))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
