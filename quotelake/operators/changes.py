"""What changed: between consecutive values of a series, and between two versions of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.functions import numbers


def price_changes(df: DataFrame, series: Sequence[str], day: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Rows of a series (nulls in its key are equal) whose value and day both differ from the row before, with old_value, old_day, delta and
    percent (null from 0). Rows are ordered by day, then value, then ``ties``; unknown days and values come last."""
    w = Window.partitionBy(*series).orderBy(F.asc_nulls_last(day), F.asc_nulls_last(value), *ties)
    seen = df.withColumns({"old_value": F.lag(value).over(w), "old_day": F.lag(day).over(w)})
    changed = seen.where((F.col("old_value") != F.col(value)) & (F.col("old_day") != F.col(day)))
    return changed.withColumns({"delta": F.col(value) - F.col("old_value"), "percent": numbers.percent_change(F.col(value), F.col("old_value"))})


def paired(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The n-th row of a key on the left with the n-th on the right (null keys are equal); columns of the right are prefixed ``r_``."""
    rank = lambda d: d.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    b = rank(right)
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))
    on = F.col("__rn") == F.col("r___rn")
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return rank(left).join(b, on).drop("__rn", "r___rn")


def version_diff(old: DataFrame, new: DataFrame, key: Sequence[str], band: str, value: str, loose: Sequence[str], unique: str) -> DataFrame:
    """Kinds of change between two versions of a price list: (kind, old_value, new_value, and the loose key).

    First rows with equal key and band are compared (``price`` if the value differs); then the rest pair up by key (``band``, or ``price_and_band``);
    then by the ``loose`` key and equal value (``reformatted``: only the label changed); what is left has ``disappeared`` or ``appeared``.
    """

    def split(a: DataFrame, b: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        both = paired(a, b, on, [value, unique])
        left = a.join(both.select(F.col(unique).alias("__u")), F.col(unique) == F.col("__u"), "left_anti")
        right = b.join(both.select(F.col(f"r_{unique}").alias("__u")), F.col(unique) == F.col("__u"), "left_anti")
        return both, left, right

    columns = [F.col(c) for c in loose]
    row = lambda d, kind, before, after: d.select(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), before.alias("old_value"), after.alias("new_value"), *columns)
    none = F.lit(None).cast(old.schema[value].dataType)
    same, o1, n1 = split(old, new, [*key, band])
    moved, o2, n2 = split(o1, n1, key)
    relabelled, o3, n3 = split(o2, n2, [*loose, value])
    v, r = F.col(value), F.col(f"r_{value}")
    return (
        row(same.where(~v.eqNullSafe(r)), "price", v, r)
        .unionByName(row(moved, F.when(v.eqNullSafe(r), "band").otherwise("price_and_band"), v, r))
        .unionByName(row(relabelled, "reformatted", v, r))
        .unionByName(row(o3, "disappeared", v, none))
        .unionByName(row(n3, "appeared", none, v))
    )


def key_union(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Full outer union of two keyed tables: key, old, new, state NOU, LIPSA, SCHIMBAT or NESCHIMBAT."""
    a, b = old.select(*key, F.col(value).alias("old")).withColumn("__o", F.lit(True)), new.select(*key, F.col(value).alias("new")).withColumn("__n", F.lit(True))
    state = F.when(F.col("__o").isNull(), "NOU").when(F.col("__n").isNull(), "LIPSA").when(F.col("old").eqNullSafe(F.col("new")), "NESCHIMBAT").otherwise("SCHIMBAT")
    return a.join(b, list(key), "full_outer").select(*key, "old", "new", state.alias("state"))
