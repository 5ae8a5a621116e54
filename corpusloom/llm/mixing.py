"""Mixing sources to target weights along a time-varying curriculum.

A source's weight follows a straight line over training time t in [0, 1]: rate(t) = target * (1 + tilt * (2 t - 1)),
with tilt in [-1, 1]. Its integral over [0, t] is the demand for the source's words up to t, and reaches the target at
t = 1. The documents of a source are laid along that demand one after the other, and again from the first for a source
that is repeated. Each time a document takes its words from a stretch of the demand; the stretch's middle, put through
the inverse of the integral, is the document's training position for that turn. A range sort by position gives the
order of training.

Only DataFrame functions are used. The running sums within a source go over BUCKETS hash buckets first and then within
each bucket, so that a source with a third of all rows isn't summed in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fitted, word_count

#: Weights and tilts by the rank of the source, repeating; a tilt over 0 brings a source late, under 0 early.
WEIGHTS, TILTS = (5, 2, 1), (0.5, 0.0, -0.5)
#: The mix has EPOCH times all words; a source is repeated REPEATS times at most.
EPOCH, REPEATS = 1.5, 2
#: Hex digits of the hash that orders a source's documents; the first three make 4,096 buckets.
BUCKET_DIGITS = 3
#: Decisions, of three numbers each, up to which they are broadcast to the documents.
FETCH_ROWS = 2_000_000


def _cycle(rank: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, epoch: float = EPOCH, repeats: int = REPEATS) -> DataFrame:
    """Targets from (source, source_size): sources by code point, null last, share epoch times all words by weight.

    No target exceeds repeats times its source's size; the excess goes to the others by weight until none is above.
    That ends at one level, target = min(cap, level * weight), found by prefix sums over the sources in the order in
    which they reach their caps. Sources are a dimension: the two windows over all of them are narrow. A source
    without words has target 0, and so has each if there are no words at all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", _cycle(F.col("rank"), weights)).withColumn("tilt", _cycle(F.col("rank"), tilts))
    s = s.withColumn("cap", F.col("source_size") * float(repeats))
    every = Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("reach", F.col("cap") / F.col("weight"))
    s = s.withColumn("all_words", F.sum("source_size").over(every) * epoch).withColumn("all_weight", F.sum("weight").over(every))
    s = s.withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_words") / F.col("left_weight"))
    s = s.withColumn("free", F.col("reach") > F.col("level"))
    # capped sources come first, and the level is that of the first one after them
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(every)
    target = F.when(F.col("free"), F.col("weight") * level).otherwise(F.col("cap"))
    return s.withColumn("target", F.round(target, 6)).select("source", "source_size", "weight", "tilt", "target")


def curriculum_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, epoch: float = EPOCH, repeats: int = REPEATS) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, taken, turns; unsorted.

    docs needs doc_id, text and source. size is the number of words (null text: 0). Within a source documents follow
    the md5 of their doc_id, then doc_id and size. The target is laid over the source again and again, so a document
    takes all its words in each full round and, where the target ends within it, its first words only; the words
    taken add up to the target, rounded down. turns has (words, position) of each round that takes any, in order, and is
    empty for a document that takes nothing. A null doc_id hashes as an empty text; rows that are alike in doc_id and
    size are interchangeable. Texts are only counted, whatever their length.
    """
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash")
    ).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_from", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, tilts, epoch, repeats)
    plan = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "bucket_from", "source_size", "tilt", "target")
    within = Window.partitionBy("source", "bucket").orderBy("hash", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    rows = rows.select("doc_id", "d.source", "size", "source_size", "tilt", "target", (F.col("begin") + F.col("bucket_from")).alias("begin"))

    def words(turn: int) -> Column:
        up_to = F.floor("target") - F.col("source_size") * turn - F.col("begin")
        return F.greatest(F.lit(0), F.least(F.col("size"), up_to))

    def turn(i: int) -> Column:
        """The middle of what the document takes in round i, as a share of the target, and when the schedule gets there."""
        share = (F.col("begin") + F.col("source_size") * i + words(i) / 2) / F.col("target")
        late = 1 - F.col("tilt")
        # tilt * t * t + (1 - tilt) * t = share
        t = F.when(share > 0, 2 * share / (late + F.sqrt(late * late + 4 * F.col("tilt") * share))).otherwise(0.0)
        return F.struct(words(i).cast("long").alias("words"), F.round(t, 9).alias("position"))

    rows = rows.withColumn("turns", F.filter(F.array(*[turn(i) for i in range(repeats)]), lambda x: x["words"] > 0))
    taken = F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "turns")


def in_training_order(mix: DataFrame) -> DataFrame:
    """A range sort of mix by the position of the first turn; ties go by doc_id, and documents that aren't taken come last."""
    return mix.orderBy(F.get("turns", F.lit(0))["position"].asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of docs, in training order.

    A document appears once for each turn that takes half its words at least, at the position of that turn; so copies
    of a repeated document stand apart. A document without words has nothing to take and goes. doc_id should be unique:
    rows that share one, null ids too, are looked up by it, and all take the turns of the one with the first position.
    Extra columns pass through unchanged, and an empty table gives no rows.
    """
    mix = curriculum_mix(docs, **options).select("doc_id", F.filter("turns", lambda x: 2 * x["words"] >= F.col("size")).alias("turns"))
    mix = mix.where(F.size("turns") > 0).groupBy(F.col("doc_id").alias("__doc")).agg(F.min(F.transform("turns", lambda x: x["position"])).alias("__positions"))
    mix = Scratch(docs.sparkSession, "mixing").keep(mix)
    rows = docs.join(fitted(mix, FETCH_ROWS), F.col("doc_id").eqNullSafe(F.col("__doc")))
    return rows.withColumn("__position", F.explode("__positions")).orderBy("__position", "doc_id").select(*docs.columns)
