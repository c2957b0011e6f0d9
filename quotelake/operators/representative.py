"""The representative row of a cell, the matrix made of them, and medians with dispersion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The middle of a cell lies between two approximate quantiles this far from it; the sketch is exact to one in ACCURACY.
BRACKET, ACCURACY = 0.004, 1000
#: Rows that tie for the middle are cut by so many approximate quantiles of their first tie column.
TIE_PARTS = 100


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _measure(df: DataFrame, column: str) -> Column:
    """A number that never falls where the column rises: the value itself, a time in seconds, a text's first six bytes."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.when(c.isNotNull(), F.lit(0.0))


def finite(df: DataFrame, value: str) -> Column:
    """Does a value count? Nulls, NaN and infinities don't."""
    c = F.col(value)
    return c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c) if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)) else c.isNotNull()


def middle_values(df: DataFrame, cell: Sequence[str], value: str, tie: str, plausible: Column | None = None) -> DataFrame:
    """(cell as __k0.., __v, __at, __low, __high, n, low, high, mean, implausible): each cell's lower middle value, the middle row's place among the rows that hold it, and
    bounds of the ``tie`` column's measure between which that row lies (null: none).

    Two passes, both aggregates that combine before the shuffle: sketches of quantiles bracket the middle whatever the values' distribution, then the values within the bracket are
    counted, and all those below it together. No task sees a cell's rows.
    """
    counts = finite(df, value) if plausible is None else finite(df, value) & plausible
    keys = [f"__k{i}" for i in range(len(cell))]
    named = df.withColumns({**{k: F.col(c) for k, c in zip(keys, cell, strict=True)}, "__good": F.coalesce(counts, F.lit(False)), "__x": F.col(value)})
    v = F.when(F.col("__good"), F.col("__x"))
    whole = named.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.count_if(finite(df, value) & ~F.col("__good")).alias("implausible"),
        F.percentile_approx(v, [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias("__q"),
    )
    bounds = whole.where("n > 0").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("__q")[0].alias("__from"), F.col("__q")[1].alias("__to"))
    inside = named.where("__good").join(bounds, _same(keys, [f"_{k}" for k in keys])).where("__x <= __to")
    held = F.when(F.col("__x") >= F.col("__from"), F.col("__x"))
    shares = [i / TIE_PARTS for i in range(1, TIE_PARTS)]
    tied = F.percentile_approx(F.when(held.isNotNull(), _measure(df, tie)), shares, 10 * TIE_PARTS)
    counted = inside.groupBy(*keys, held.alias("__v")).agg(F.count("*").alias("__c"), tied.alias("__t"), F.count_if(_measure(df, tie).isNull()).alias("__none"))
    upto = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("__upto", F.sum("__c").over(upto)).select(*(F.col(k).alias(f"_{k}") for k in keys), "__v", "__c", "__t", "__none", "__upto")
    found = whole.join(placed, _same(keys, [f"_{k}" for k in keys]))
    middle = F.floor((F.col("n") + 1) / 2)
    at = middle - (F.col("__upto") - F.col("__c"))
    # rows without a tie come first; the row is in this part of the others or next to it
    place, others = at - F.col("__none"), F.col("__c") - F.col("__none")
    part = F.floor(F.try_divide(place * TIE_PARTS, others)).cast("int")
    low = F.when(place > 0, F.get("__t", part - 3))
    high = F.when(place > 0, F.get("__t", part + 1)).otherwise(F.lit(float("-inf")))
    return found.where((F.col("__upto") >= middle) & (at > 0)).select(
        *keys, "__v", at.alias("__at"), low.alias("__low"), high.alias("__high"), "n", "low", "high", "mean", "implausible"
    )


def representative_rows(df: DataFrame, cell: Sequence[str], value: str, ties: Sequence[str], plausible: Column | None = None) -> DataFrame:
    """For each cell the row at the lower middle of its rows in order of value, then ``ties``; with n, low, high and mean of the cell, and how many values aren't plausible.

    Rows without a value, with NaN or an infinite one, and those not ``plausible`` don't count. Three passes over ``df``: two find the middle value (``middle_values``), the third
    ranks the rows that hold it, of which those surely below the middle by their first tie column are only counted: a price that a third of a cell shares is
    cut like a cell. Rows equal in all columns are one with a count.
    """
    found = middle_values(df, cell, value, ties[0], plausible)
    keys = [f"__k{i}" for i in range(len(cell))]
    tie = _measure(df, ties[0])
    rows = df.join(found, (F.col(value) == F.col("__v")) & _same(cell, keys)).where(F.col("__high").isNull() | tie.isNull() | (tie <= F.col("__high")))
    whole = F.struct(*(F.col(t).alias(f"t{i}") for i, t in enumerate(ties)), F.struct(*(F.col(c) for c in df.columns)).alias("row"))
    # a null tie comes first, so it is below any bound
    below = F.col("__low").isNotNull() & (tie.isNull() | (tie < F.col("__low")))
    counted = rows.groupBy(*keys, "__at", "n", "low", "high", "mean", "implausible", F.when(~below, whole).alias("__row")).agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*keys).orderBy(F.col("__row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__upto", F.sum("__c").over(upto)).where("__upto >= __at and __upto - __c < __at")
    return ranked.select("__row.row.*", "n", "low", "high", "mean", "implausible")


def matrix(df: DataFrame, row: str, column: str, value: str, ties: Sequence[str], cap: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Long form of the matrix row x column: the representative value of each cell among plausible rows, and the counts left out."""
    best = representative_rows(df, [row, column], value, ties, None if cap is None else F.col(value) <= cap)
    return best.select(row, column, F.col(value).alias("value"), *keep, "n", "low", "high", "mean", "implausible")


def wide(cells: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """The matrix with a column for each of ``columns``."""
    return cells.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def medians(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The median (mean of the two middles) and count of each group."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.median(value).alias("median"), F.count("*").alias("n"))


def spread(low: Column, high: Column) -> Column:
    """high / low; 1 where nothing can be told."""
    return F.coalesce(F.try_divide(high, F.when(low != 0, low)), F.lit(1.0))


def comparable_lines(df: DataFrame, line: Sequence[str], seller: str, value: str, least: int = 3, most: float = 5.0) -> DataFrame:
    """Lines that at least ``least`` sellers have: the median of the sellers' medians, the dispersion between sellers (of their medians) and
    within one (the largest ratio of a seller's own values), non-zero values only, and trusted if neither exceeds ``most``."""
    value_ = F.when(F.col(value) != 0, F.col(value))
    own = df.where(F.col(value).isNotNull()).groupBy(*line, seller).agg(F.median(value).alias("__m"), spread(F.min(value_), F.max(value_)).alias("__own"))
    median_ = F.when(F.col("__m") != 0, F.col("__m"))
    lines = own.groupBy(*line).agg(
        F.count(seller).alias("sellers"), F.median("__m").alias("median"), spread(F.min(median_), F.max(median_)).alias("between"), F.max("__own").alias("within")
    )
    return lines.where(F.col("sellers") >= least).withColumn("trusted", (F.col("between") <= most) & (F.col("within") <= most))


def consensus(df: DataFrame, by: Sequence[str], seller: str, value: str, least: int = 3) -> DataFrame:
    """For each group the value that most sellers state, if at least ``least`` do; of equals the smallest value."""
    votes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.countDistinct(seller).alias("sellers"))
    first = Window.partitionBy(*by).orderBy(F.desc("sellers"), F.asc(value))
    return votes.withColumn("__rn", F.row_number().over(first)).where((F.col("__rn") == 1) & (F.col("sellers") >= least)).drop("__rn")


def versus(df: DataFrame, line: Sequence[str], seller: str, value: str, reference: str, smaller_wins: bool = True) -> DataFrame:
    """The reference seller against the others on each line: verdict wins, loses, middle (neither best nor worst), alone, or none."""
    mine = F.max(F.when(F.col(seller) == reference, F.col(value)))
    other = F.when(F.col(seller) != reference, F.col(value))
    agg = df.groupBy(*line).agg(mine.alias("mine"), F.min(other).alias("low"), F.max(other).alias("high"), F.count(other).alias("others"))
    best, worst = ("low", "high") if smaller_wins else ("high", "low")
    better = F.col("mine") <= F.col(best) if smaller_wins else F.col("mine") >= F.col(best)
    worse = F.col("mine") >= F.col(worst) if smaller_wins else F.col("mine") <= F.col(worst)
    verdict = F.when(F.col("mine").isNull(), "none").when(F.col("others") == 0, "alone").when(better, "wins").when(worse, "loses").otherwise("middle")
    return agg.withColumn("verdict", verdict)


def comparable_rates(rates: DataFrame, most: float = 8.0, least: int = 3, spread_over: int = 3) -> DataFrame:
    """Comparable lines of rates (bank, product, segment, category, kind, way, value, text): promotions, benefits, fees and index values aren't compared, and texts that a bank shows with
    ``spread_over`` products or more belong to its site, not to a product. A page that names no segment is for natural persons unless it is a business page."""
    known = rates.where("product is not null and value is not null")
    furniture = known.groupBy(F.col("bank").alias("__b"), F.left("text", F.lit(70)).alias("__t")).agg(F.countDistinct("product").alias("__n")).where(F.col("__n") >= spread_over).select("__b", "__t")
    rows = known.where(~F.col("kind").isin("rate_fara_dobanda", "cashback", "comision_procent", "ircc_valoare", "robor_valoare", "euribor_valoare"))
    rows = rows.join(furniture, (F.col("bank") == F.col("__b")) & (F.left("text", F.lit(70)) == F.col("__t")), "left_anti")
    segment = F.coalesce("segment", F.when(F.col("category") == "business", "-").otherwise("pf"))
    return comparable_lines(rows.withColumn("segment", segment), ["product", "segment", "kind", "way"], "bank", "value", least, most)
