"""Mixing sources to target weights: tokens per source, repetition rates, then floor(rate) copies and one Bernoulli copy.

The Bernoulli draw is a hash of the document's id and the seed, so reruns and recomputed tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import global_index, materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240917
#: Words are maximal runs of other characters than these six.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id (null: as an empty text) and the seed, in steps of 2**-52."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size). Targets share ``share`` of all sizes by weight; one above ``most``
    times its source's size stops there, and the excess is shared again by weight until none is above.

    The sources stay a distributed table: they are ranked by ranges, and each round of sharing is one aggregate of two sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = global_index(spark, per, [F.col("source").asc_nulls_last()], "__rank")
    cycle = F.array(*map(F.lit, weights))
    table = materialize(spark, ranked.withColumn("__w", F.element_at(cycle, (F.col("__rank") % len(weights) + 1).cast("int")).cast("long")).drop("__rank"))
    cap = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, stopped = share * total, None, -1
    while True:
        over = F.lit(False) if level is None else F.col("__w") * F.lit(level) > cap
        n, held, free = table.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("__w")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (wanted - float(held or 0)) / float(free)
    level = level or 0.0
    target = F.when(F.col("__w") * F.lit(level) > cap, cap.cast("double")).otherwise(F.col("__w") * F.lit(level))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(spark: SparkSession, sizes: DataFrame, seed: int = SEED, **sharing) -> DataFrame:
    """``sizes`` (doc_id, source, size) with source_size, target and copies: how often the mix takes the document.

    A source's rate is target / source_size, at most 2, so no document is taken more than twice. A source without words
    has rate 0. Null sources are one source, ranked last; null ids draw like one id; repeated rows are each taken as their
    id says; an empty table gives an empty table. The source table joins back by an adaptive join: one source with a third
    of all rows is split.
    """
    targets = source_targets(spark, sizes, **sharing)
    right = targets.select(F.col("source").alias("__s"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("int")
    joined = sizes.join(right, F.col("source").eqNullSafe(F.col("__s")))
    return joined.select(*(F.col(f"`{c}`") for c in sizes.columns), "source_size", "target", copies.alias("copies"))


def mix_documents(spark: SparkSession, docs: DataFrame, seed: int = SEED, **sharing) -> DataFrame:
    """The mixed documents themselves, all columns kept: each appears as often as the mix takes it. Sizes are counted once."""
    sizes = docs.select("source", n_words(F.col("text")).alias("size"))
    targets = source_targets(spark, sizes, **sharing).select(F.col("source").alias("__s"), F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("int")
    # a row's columns travel as one, so that their names can't clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "source", "doc_id").join(targets, F.col("source").eqNullSafe(F.col("__s")))
    return rows.select("__row", copies.alias("__copies")).where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")


def mixing_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op10's rows: doc_id, size, source_size, target, taken (words taken, repeats counted)."""
    sizes = materialize(spark, docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix_sources(spark, sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
