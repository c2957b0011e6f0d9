"""Writes as pure functions: target and new rows in, the new target out. Whoever calls them overwrites the table (or a partition of it)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_of_each(new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Of rows with one key the last in ``order``, then in order of all their columns: the same whatever order they arrive in. Combines before the shuffle."""
    rest = [c for c in new.columns if c not in key]
    if not rest:
        return new.distinct()
    best = F.max_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order))).alias("__best")
    return new.groupBy(*key).agg(best).select(*key, "__best.*").select(new.columns)


def _matched(target: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    n = one_of_each(new, key, order).select(*(F.col(c).alias(c if c in key else f"n_{c}") for c in new.columns), F.lit(True).alias("__new"))
    return target.withColumn("__old", F.lit(True)).join(n, list(key), "full_outer")


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str], rules: dict[str, str] | None = None, keep_old: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Insert or update by key. Each column follows its rule: ``fill`` (the new value, the old one where it is null; default), ``new``, ``old`` (first value
    stays), ``greatest`` or ``least``. ``keep_old`` (over old columns and ``n_`` columns) names rows that stay as they were.
    Of several new rows with one key the last in ``order`` counts (then in order of their columns)."""
    rules = rules or {}
    both = _matched(target, new, key, order)
    inserted, matched = F.col("__old").isNull(), F.col("__old").isNotNull() & F.col("__new").isNotNull()
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.col(c))
            continue
        o, n = F.col(c), F.col(f"n_{c}") if c in new.columns else F.lit(None)
        value = {"fill": F.coalesce(n, o), "new": n, "old": F.coalesce(o, n), "greatest": F.greatest(o, n), "least": F.least(o, n)}[rules.get(c, "fill")]
        stays = matched & F.coalesce(keep_old, F.lit(False)) if keep_old is not None else F.lit(False)
        out.append(F.when(inserted, n).when(matched & ~stays, value).otherwise(o).alias(c))
    return both.select(*out)


def insert_new(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't there yet are added; of a new key repeated in one batch one row is (see ``one_of_each``)."""
    fresh = one_of_each(new, key).join(target.select(*key), list(key), "left_anti")
    return target.unionByName(fresh.select(target.columns))


def replace_by(target: DataFrame, new: DataFrame, replaced: Column) -> DataFrame:
    """The rows that ``replaced`` marks go (unknown ones stay), the new ones come: run twice it gives the same."""
    return target.where(~F.coalesce(replaced, F.lit(False))).unionByName(new.select(target.columns))


def replace_all(new: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """A full snapshot in place of a table: (the new table, the child rows whose parent it still holds). Children of parents that are gone go with them, those without a parent stay."""
    kept = children.join(new.select(F.col(parent_key).alias("__parent")).distinct(), F.col(child_key) == F.col("__parent"), "left").where(F.col(child_key).isNull() | F.col("__parent").isNotNull())
    return new, kept.drop("__parent")


def annotate(target: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Columns of ``updates`` overwrite the target's where they aren't null."""
    u = one_of_each(updates, key).select(*(F.col(c).alias(c if c in key else f"n_{c}") for c in updates.columns))
    joined = target.join(u, list(key), "left")
    return joined.select(*(F.coalesce(f"n_{c}", c).alias(c) if c in updates.columns and c not in key else F.col(c) for c in target.columns))


def reconcile(expected: int, df: DataFrame) -> DataFrame:
    """The table, or an error if it doesn't have so many rows."""
    found = df.count()
    if found != expected:
        raise ValueError(f"{found} rows where {expected} were expected")
    return df


def guard_shrink(old: DataFrame, new: DataFrame, signal: str, most_lost: float = 0.5) -> DataFrame:
    """The new registry, or an error if it has fewer rows or has lost more than a share of its signals: good knowledge is never overwritten by none."""
    a, b = (d.agg(F.count("*"), F.count(signal)).first() for d in (old, new))
    if b[0] < a[0] or b[1] < a[1] * (1 - most_lost):
        raise ValueError(f"refused: {a[0]} rows with {a[1]} signals would become {b[0]} with {b[1]}")
    return new


def kept_until(df: DataFrame, taken: str, delete_on: str, as_of: Column, days: int = 30) -> DataFrame:
    """Rows that may still be kept: younger than ``days`` and before their own date of deletion."""
    return df.where((F.datediff(as_of, F.col(taken)) < days) & (F.col(delete_on).isNull() | (as_of < F.col(delete_on))))
