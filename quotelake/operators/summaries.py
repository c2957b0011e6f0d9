"""Counts, facets, coverage, pivots, samples and open-ended sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facets(df: DataFrame, options: DataFrame, name: str) -> DataFrame:
    """(option, n) for all options, those without rows too, and ``unknown`` for rows without one."""
    counted = df.groupBy(F.coalesce(F.col(name), F.lit("unknown")).alias("option")).agg(F.count("*").alias("n"))
    every = options.select(F.col(name).alias("option")).unionByName(df.sparkSession.createDataFrame([("unknown",)], "option string")).distinct()
    return every.join(counted, "option", "left").select("option", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def item_facets(df: DataFrame, items: Column) -> DataFrame:
    """(item, n) of an array's items."""
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def scorecard(df: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Percentages (one decimal) of flags by group and for all rows together (group TOTAL)."""
    one = [F.round(F.lit(100.0) * F.count_if(c) / F.count("*"), 1).alias(name) for name, c in flags.items()]
    return df.rollup(by).agg(F.grouping(by).alias("__g"), F.count("*").alias("n"), *one).withColumn(by, F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col(by).cast("string"))).drop("__g")


def coverage(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """The k most common groups with their share of all rows, running: rank, n, running, share."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__t"))
    top = counted.orderBy(F.desc("n"), *by).limit(k)
    w = Window.orderBy(F.desc("n"), *by)
    ranked = top.withColumns({"rank": F.row_number().over(w), "running": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.lit(100.0) * F.col("running") / F.col("__t"), 2)).drop("__t")


def repeated_across(df: DataFrame, by: Sequence[str], item: str, least: int) -> DataFrame:
    """Groups found with at least ``least`` different items: a site's furniture."""
    return df.groupBy(*by).agg(F.countDistinct(item).alias("items")).where(F.col("items") >= least)


def page_furniture(lines: DataFrame, document: str, page: str, text: str, share: float = 0.4) -> DataFrame:
    """Lines of a document that stand on at least max(2, share of its pages) pages."""
    pages = lines.groupBy(document).agg(F.countDistinct(page).alias("__pages"))
    found = lines.groupBy(document, text).agg(F.countDistinct(page).alias("on_pages")).join(pages, document)
    return found.where(F.col("on_pages") >= F.greatest(F.lit(2), F.floor(F.col("__pages") * share))).drop("__pages")


def open_sum(df: DataFrame, by: Sequence[str], low: str, high: str, open_end: int = 2**63 - 1) -> DataFrame:
    """Sums of interval ends: low, high without open ends, and whether any is open."""
    is_open = F.col(high) == open_end
    return df.groupBy(*by).agg(
        F.sum(F.coalesce(low, F.lit(0))).alias("low"), F.sum(F.when(~is_open, F.col(high)).otherwise(0)).alias("high"), F.bool_or(F.coalesce(is_open, F.lit(False))).alias("open")
    )


def sample_by_quota(df: DataFrame, stratum: str, quota: int, unique: str, within: str | None = None, most: int = 3, seed: str = "1", top_up: bool = False) -> DataFrame:
    """Up to ``quota`` rows of each stratum in a seeded order (md5 of the seed and the id), at most ``most`` from each ``within``. ``top_up``: a stratum that
    so falls short is filled with its other rows, in the same order."""
    order = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(unique).cast("string")).cast("binary"))
    out = df.withColumn("__o", order).withColumn("__late", F.lit(0))
    if within:
        rank = F.row_number().over(Window.partitionBy(stratum, within).orderBy("__o", unique))
        out = out.withColumn("__w", rank).withColumn("__late", (F.col("__w") > most).cast("int")).drop("__w")
        # no more than the quota of a stratum's group can be taken
        out = out if top_up else out.where("__late = 0")
    return out.withColumn("__rn", F.row_number().over(Window.partitionBy(stratum).orderBy("__late", "__o", unique))).where(F.col("__rn") <= quota).drop("__rn", "__o", "__late")


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page in a total order, each row with ``total``: how many rows the whole has. The total is an aggregate of its own, so only the page is sorted to the end."""
    total = df.agg(F.count("*").alias("total"))
    return page_of(df, order, limit, offset, most).crossJoin(F.broadcast(total))


def natural_order(column: Column, locale: str = "ro", descending: bool = False) -> list[Column]:
    """A sort key as people expect: numbers by value before texts, texts by the locale's alphabet, blanks last either way."""
    words = column.cast("string")
    number = words.try_cast("double")
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    return [F.coalesce(F.trim(words) == "", F.lit(True)).asc(), turn(number.isNull().cast("int")), turn(number), turn(F.collate(words, locale))]


def first_of_each(df: DataFrame, key: Sequence[str], place: Column) -> DataFrame:
    """Each key's first row by ``place`` (a total order): deduplication that keeps the order of first sight. An aggregate that combines before the shuffle."""
    row = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.min_by(row, place).alias("__r")).select("__r.*")


def any_in_group(df: DataFrame, by: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    """``df`` with, under each name, whether the test holds for any row of its group: one aggregate for each group, joined back. Null keys are one group."""
    found = df.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(*(F.bool_or(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()))
    return df.join(found, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))).drop(*(f"__{c}" for c in by))


def page_of(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page in a total order, no more than ``most`` rows."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(limit, most))


def blanks_last(column: Column, descending: bool = False) -> list[Column]:
    """A sort key that puts nulls and empty texts last either way."""
    blank = column.isNull() | (F.trim(column.cast("string")) == "")
    return [blank.asc(), column.desc() if descending else column.asc()]


def active_on(first: Column, last: Column, day: Column, days: int) -> Column:
    """Was it seen within so many days before the day?"""
    return (last >= F.date_sub(day, days)) & (first <= day)


def order_by(key: str, allowed: dict[str, Column], descending: bool = False, *ties: Column) -> list[Column]:
    """A total order by one of the keys that may be asked for (nulls last either way); an unknown key is an error."""
    if key not in allowed:
        raise ValueError(f"order by one of {', '.join(sorted(allowed))}")
    return [allowed[key].desc_nulls_last() if descending else allowed[key].asc_nulls_last(), *ties]


def distribution(df: DataFrame, by: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """(by, n, a column for each kind): rows of each group and the share of each kind in per cent, one decimal."""
    shares = [F.round(F.lit(100.0) * F.count_if(F.col(kind) == k) / F.count("*"), 1).alias(k) for k in kinds]
    return df.groupBy(by).agg(F.count("*").alias("n"), *shares)


def same_day(df: DataFrame, by: str, day: str, least: int) -> DataFrame:
    """(by, day, n) of days on which at least so many rows of a group fall: a bulk change, not so many single ones."""
    return df.where(F.col(day).isNotNull()).groupBy(by, day).agg(F.count("*").alias("n")).where(F.col("n") >= least)
