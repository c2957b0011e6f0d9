"""Records anywhere inside JSON of unknown depth: a walk level by level over VARIANT values, each level one distributed explode."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake import storage

#: JSON is never deeper; the parser itself refuses more.
MOST_LEVELS = 1000


def walk(df: DataFrame, keys: Sequence[str], document: Column, keep: Column) -> DataFrame:
    """(keys, level, key, node) of every object and array of each row's JSON text for which ``keep``, a test on the VARIANT column ``node``, holds.

    The document itself is level 0. A level is written before the next is taken from it, so none is worked out twice, and the walk ends at the first level without
    objects and arrays: the depth needn't be known. Texts that aren't JSON, and nulls, have no node. A hot document's nodes spread with their level's rows.
    """
    level = df.select(*keys, F.lit(0).alias("level"), F.lit(None).cast("string").alias("key"), F.try_parse_json(document).alias("node")).where("node is not null")
    found = []
    for n in range(1, MOST_LEVELS):
        found.append(level.where(keep))
        inner = level.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("node").outer()).alias("e"))
        inner = inner.select(*keys, F.lit(n).alias("level"), F.col("e.key").alias("key"), F.col("e.value").alias("node"))
        level = storage.cut(inner.where(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)")))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def field(name: str, kind: str = "string") -> Column:
    """A member of ``node``, null if it isn't there or of another kind."""
    return F.try_variant_get("node", f"$['{name}']", kind)


def reviews(df: DataFrame, keys: Sequence[str], document: Column, kind: str = "Review") -> DataFrame:
    """(keys, id, review) of the objects whose ``$kind`` is ``kind`` and that have an id, wherever they stand; of repeated ids of one row one, the deepest, stays."""
    rows = walk(df, keys, document, (field("$kind") == kind) & field("id").isNotNull())
    return rows.withColumn("id", field("id")).groupBy(*keys, "id").agg(F.max_by("node", F.struct("level", F.to_json("node"))).alias("review"))


def star_counts(df: DataFrame, keys: Sequence[str], document: Column, name: str = "ratingCounts", stars: int = 5) -> DataFrame:
    """(keys, counts) of the deepest member of that name that is an array of so many numbers."""
    counts = field(name, "array<long>")
    rows = walk(df, keys, document, (F.size(F.coalesce(counts, F.array().cast("array<long>"))) == stars) & ~F.exists(counts, lambda n: n.isNull()))
    return rows.groupBy(*keys).agg(F.max_by(counts, F.struct("level", F.to_json("node"))).alias("counts"))


def star_distribution(counts: Column) -> Column:
    """Of counts from the most stars to one: ratings, their average (two digits), how many have the two best and the worst, and whether any star has none."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    total = F.aggregate(F.transform(counts, lambda x, i: x * (F.size(counts) - i)), F.lit(0).cast("long"), lambda a, b: a + b)
    two = F.aggregate(F.slice(counts, 1, 2), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.struct(n.alias("ratings"), F.round(F.try_divide(total, n), 2).alias("average"), two.alias("best"), F.element_at(counts, -1).alias("worst"), F.array_contains(counts, 0).alias("gaps"))
