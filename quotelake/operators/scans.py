"""Running values over ordered rows of a key, in segments, so that no task holds a long key whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A segment has so many places; a key's segments are scanned apart.
SEGMENT = 4096


def dealt(df: DataFrame, keys: Sequence[str], at: str, segment: int = SEGMENT) -> DataFrame:
    """``df`` dealt to segments once, with ``__segment`` (a struct of the keys and the segment's number, so that null keys are equal).

    A segment's rows travel as one array, which every later pass needs whole: so all passes read the same shuffle, and what made the rows isn't worked out again.
    """
    number = F.struct(F.struct(*keys).alias("key"), F.floor(F.col(at) / segment).alias("block"))
    rows = df.select(number.alias("__segment"), F.struct(*df.columns).alias("__row"))
    return rows.groupBy("__segment").agg(F.collect_list("__row").alias("__rows")).select("__segment", F.inline("__rows"))


def running_in(segments: DataFrame, at: str, values: Mapping[str, Column]) -> DataFrame:
    """``running_max`` over rows that are ``dealt`` already and stay so: scans can follow each other without another shuffle of the rows."""
    read = segments.withColumns({f"__v_{n}": v for n, v in values.items()})
    folded = read.groupBy("__segment").agg(*(F.max(f"__v_{n}").alias(f"__c_{n}") for n in values))
    earlier = Window.partitionBy("__segment.key").orderBy("__segment.block").rowsBetween(Window.unboundedPreceding, -1)
    carried = folded.select(F.col("__segment").alias("__s"), *(F.max(f"__c_{n}").over(earlier).alias(f"__c_{n}") for n in values))
    within = Window.partitionBy("__segment").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    scanned = read.select(*segments.columns, *(F.max(f"__v_{n}").over(within).alias(f"__w_{n}") for n in values))
    joined = scanned.join(carried.hint("shuffle_hash"), F.col("__segment") == F.col("__s"))
    return joined.select(*segments.columns, *(F.greatest(f"__c_{n}", f"__w_{n}").alias(n) for n in values))


def running_max(df: DataFrame, keys: Sequence[str], at: str, values: Mapping[str, Column], segment: int = SEGMENT) -> DataFrame:
    """``df`` with, under each name, the largest value among the key's rows before this one in order of ``at`` (a number from 0 on); nulls count for nothing.

    A struct that begins with ``at`` so becomes the latest one. Each segment of a key folds to one row, what came before a segment is the running maximum of
    those rows, and the rows of a segment are scanned with that as their start. Rows at one place don't see each other. Null keys are one key.
    """
    return running_in(dealt(df, keys, at, segment), at, values).select(*df.columns, *values)
