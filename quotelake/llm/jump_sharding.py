"""Jump consistent hashing (Lamping and Veach): stable keys to shards without a ring table, in native column expressions.

The generator is the paper's: ``key = key * 2862933555777941757 + 1`` modulo 2**64, and the next candidate is
``floor((b + 1) * 2**31 / ((key >> 33) + 1))``. ANSI arithmetic raises on overflow, so the state is kept as two
32-bit halves and multiplied in limbs. Adding a shard moves only the rows that the new shard takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import materialize

#: Fixed value: the multiplier of the published algorithm.
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1
_HIGH_M, _LOW_M1, _LOW_M0 = MULTIPLIER >> 32, (MULTIPLIER & _LOW) >> 16, MULTIPLIER & 0xFFFF


def _times_low32(x: Column, m1: int, m0: int) -> Column:
    """x * (m1 * 2**16 + m0) modulo 2**32, for x below 2**32."""
    return (x * F.lit(m0) + F.shiftleft((x * F.lit(m1)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state, as halves."""
    p1 = low * F.lit(_LOW_M1)
    total = low * F.lit(_LOW_M0) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(p1, 16)
    upper = carry + _times_low32(high, _LOW_M1, _LOW_M0) + _times_low32(low, _HIGH_M >> 16, _HIGH_M & 0xFFFF)
    return upper.bitwiseAND(F.lit(_LOW)), total.bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards - 1) of a long key. A null key counts as 0."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(k, 32).alias("h"),
        k.bitwiseAND(F.lit(_LOW)).alias("l"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["h"], s["l"])
        j = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double"))).cast("long")
        return F.when(s["j"] < F.lit(shards), F.struct(high.alias("h"), low.alias("l"), s["j"].alias("b"), j.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int, bucket_rows: int = 20_000, most_ranges: int = 20_000) -> DataFrame:
    """Every document with its shard, its slot there and its shard when one more is appended.

    Columns: doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32 (of the UTF-8 bytes, null: of none),
    law ``key``, shard, slot (gapless from 0 in each shard), grown_shard.

    Slots follow (doc_id, text_crc32, size) at every size: rows are sorted by ranges of (shard, doc_id, text_crc32, size) of about
    ``bucket_rows`` rows (more where that would be over ``most_ranges``), numbered within a range and offset by the shard's counts in the ranges before it, so no task holds a whole shard. Only
    doc_id, two numbers and the shard are shuffled, never texts. Repeated rows share a shard and get slots of their own; null keys count as key 0;
    an empty table gives no rows; other columns are ignored. The result does not depend on partitioning.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.length(body).cast("long") + F.lit(8)).alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    ranges = max(1, min(most_ranges, -(-docs.count() // bucket_rows)))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumns({"shard": jump_hash(key, shards), "grown_shard": jump_hash(key, shards + 1)})
    order = [F.col("shard"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    # rows equal in all columns may fall into two ranges: the last column keeps them apart
    spread = F.rand(0).alias("__spread")
    placed = rows.select("*", spread).repartitionByRange(ranges, *order, F.col("__spread")).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = materialize(spark, placed.withColumns({"__part": F.spark_partition_id(), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    base = counts.select("shard", "__part", F.expr("sum(__n) over (partition by shard order by __part) - __n - __first").alias("__base"))
    return placed.join(F.broadcast(base), ["shard", "__part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__base") + F.col("__at")).cast("long").alias("slot"), "grown_shard"
    )
