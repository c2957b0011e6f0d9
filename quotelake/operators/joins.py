"""Joins that aren't plain equality: by interval, as of a day, within a band, by pattern and by likeness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake import storage


def _months(start: Column, end: Column) -> Column:
    """The first days of the months from ``start`` to ``end``; none if the end comes first."""
    return F.when(start <= end, F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))


def _placed(series: DataFrame, facts: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """The series' rows dealt to each month (``__month``) that their interval shares with the facts' days; an open end is the facts' last day."""
    reach = facts.agg(F.min(F.col(day).cast("date")).alias("__first"), F.max(F.col(day).cast("date")).alias("__last"))
    from_ = F.greatest(F.col(start).cast("date"), F.col("__first"))
    to = F.least(F.coalesce(F.col(end).cast("date"), F.col("__last")), F.col("__last"))
    return series.crossJoin(F.broadcast(reach)).withColumn("__month", F.explode(_months(from_, to))).drop("__first", "__last")


def in_interval(facts: DataFrame, day: str, series: DataFrame, start: str, end: str) -> DataFrame:
    """Facts with the rows of a dimension whose interval holds their day (an open end is null); facts without one drop out.

    Intervals are dealt to the months they touch and meet the facts' month by equality, so it stays a hash join. Null days meet nothing.
    """
    dealt = _placed(series, facts, day, start, end)
    inside = (F.col(day) >= F.col(start)) & (F.col(end).isNull() | (F.col(day) <= F.col(end)))
    return facts.withColumn("__month", F.trunc(F.col(day).cast("date"), "month")).join(dealt, "__month").where(inside).drop("__month")


def as_of(facts: DataFrame, day: str, series: DataFrame, start: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Facts with ``value`` of the latest row of the series that starts on or before their day (null if none does; of rows that start together the greatest).

    Each row of the series holds from its start to the day before the next one's; these intervals meet the facts by ``by`` and month, so the facts are
    neither sorted nor windowed, and a month with most of them is split like any skewed join. Only the series, one row a day at most for each ``by``, is put in order.
    """
    s = series.where(F.col(start).isNotNull()).groupBy(*(F.col(c).alias(f"__b_{c}") for c in by), F.col(start).cast("date").alias("__from")).agg(F.max(value).alias("__v"))
    after = F.lead("__from").over(Window.partitionBy(*(f"__b_{c}" for c in by)).orderBy("__from"))
    dealt = _placed(s.withColumn("__to", F.date_sub(after, 1)), facts, day, "__from", "__to").withColumnRenamed("__month", "__m")
    on = F.trunc(F.col(day).cast("date"), "month") == F.col("__m")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    on = on & (F.col(day).cast("date") >= F.col("__from")) & (F.col("__to").isNull() | (F.col(day).cast("date") <= F.col("__to")))
    return facts.join(dealt, on, "left").select(*(F.col(c) for c in facts.columns), F.col("__v").alias(value))


def within_band(facts: DataFrame, x: str, series: DataFrame, y: str, tolerance: float, order: str) -> DataFrame:
    """Facts with the first row (in ``order``) of the series whose ``y`` is within ``tolerance`` of ``x``; facts without one drop out, repeated ones all stay.

    Values are dealt to cells of the tolerance's width and meet the series' three nearest cells by equality, so it stays a hash join. The answer hangs on
    ``x`` alone: each different value is looked up once.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("long")
    s = series.select(*(F.col(c).alias(f"s_{c}") for c in series.columns), F.explode(F.sequence(cell(y) - 1, cell(y) + 1)).alias("__cell"))
    best = F.min_by(F.struct(*(f"s_{c}" for c in series.columns)), F.struct(f"s_{order}", *(f"s_{c}" for c in series.columns))).alias("__s")
    values = facts.select(F.col(x).alias("__x")).distinct().withColumn("__cell", cell("__x"))
    found = values.join(s, "__cell").where(F.abs(F.col("__x") - F.col(f"s_{y}")) <= tolerance).groupBy("__x").agg(best)
    return facts.join(found, F.col(x) == F.col("__x")).select(*(F.col(c) for c in facts.columns), "__s.*")


def first_rule(facts: DataFrame, text: str, rules: DataFrame, pattern: str, label: str, order: str) -> DataFrame:
    """Facts with the label of the first rule whose pattern matches, null where none does. The rules, a short and fixed table, are one array in order
    that each row goes through: facts aren't shuffled, and nulls in their columns don't matter."""
    rule = F.struct(F.col(order).alias("o"), F.col(pattern).alias("p"), F.col(label).alias("l"))
    table = rules.where(F.col(pattern).isNotNull()).agg(F.sort_array(F.collect_list(rule)).alias("__rules"))
    hit = F.get(F.filter("__rules", lambda r: F.coalesce(F.rlike(F.col(text), r["p"]), F.lit(False))), F.lit(0))
    return facts.crossJoin(F.broadcast(table)).withColumn(label, hit["l"]).drop("__rules")


def most_alike(left: DataFrame, right: DataFrame, block: str, a: str, b: str, least: float = 0.95, ids: tuple[str, str] | None = None) -> DataFrame:
    """For each left row the right row of its block whose text is most alike (matching share of both texts), if at least ``least``.

    Pairs exist only within a block and only if the texts can be so much alike: texts that share at least that part of their characters share one of the few that come first
    in a common order of all characters (with how often each came before in its text), and rows meet by these, so a block that a third of all rows are in is spread over its characters,
    and neither all its pairs nor all pairs of one length are formed. The share itself is worked out in Arrow batches. Repeated left rows each stay. ``ids`` (a left and a right column):
    rows of equal ids aren't compared, and the right id is given too; of equally alike texts the greatest wins, of equal texts the smallest id. Null texts meet nothing.
    """

    @F.pandas_udf("double")
    def share(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    # two texts so much alike share at least n * least / (2 - least) characters of either
    def firsts(c: str) -> Column:
        signs = F.split(F.col(c), "")
        signs = F.when(F.length(c) > 0, F.filter(signs, lambda x: x != "")).otherwise(F.array().cast("array<string>"))
        marked = F.transform(signs, lambda x, i: F.struct((-F.size(F.filter(F.slice(signs, 1, i), lambda y: y == x))).alias("before"), x.alias("sign")))
        n = F.length(c) - F.ceil(F.length(c) * (least / (2 - least)) - 1e-6).cast("int") + 1
        # a character's later occurrences are rarer, so they come first
        return F.when(F.length(c) > 0, F.slice(F.array_sort(marked), 1, F.greatest(n, F.lit(1)))).otherwise(F.array(F.struct(F.lit(0).alias("before"), F.lit("").alias("sign"))))

    # different texts of a block are compared once, however many rows have them; a text stands for its rows by their two smallest ids, since a row leaves out no more than its own
    key = [F.col(c) for c in (block, a, b)]
    texts = left.where(F.col(a).isNotNull()).select(block, a).distinct().withColumn("__first", F.explode(firsts(a)))
    named = right.where(F.col(b).isNotNull())
    if ids:
        named = named.select(block, b, F.col(ids[1]).alias("__id")).where("__id is not null")
        classes = named.groupBy(block, b).agg(F.min("__id").alias("__one"))
        later = named.join(classes, [block, b]).where(F.col("__id") > F.col("__one")).groupBy(block, b).agg(F.min("__id").alias("__two"))
        classes = classes.join(later, [block, b], "left")
    else:
        classes = named.select(block, b).distinct()
    pairs = texts.join(classes.select(block, b).withColumn("__first", F.explode(firsts(b))), [block, "__first"]).select(*key).distinct()
    bound = F.coalesce(F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)), F.lit(1.0)) + 1e-9
    scored = storage.cut(pairs.where(bound >= least).withColumn("share", share(F.col(a), F.col(b))).where(F.col("share") >= least)).join(classes, [block, b])
    best = F.max_by(F.struct(*(F.col(c) for c in scored.columns if c not in (block, a))), F.struct(F.col("share"), F.col(b)))
    first = scored.groupBy(block, a).agg(best.alias("__best"))
    if not ids:
        return left.join(first, [block, a]).select(*(F.col(c) for c in left.columns), *(F.col(f"__best.{c}") for c in (b, "share")))
    # the row that is all there is of its best text has the best of the others
    sole = first.where("__best.__two is null").select(block, a, F.col("__best.__one").alias("__sole"))
    others = scored.join(sole, [block, a]).where("__one <> __sole or __two is not null").groupBy(block, a).agg(best.alias("__next"))
    own, pick = F.col(ids[0]), F.col("__pick")
    found = left.where(own.isNotNull()).join(first.join(others, [block, a], "left"), [block, a])
    found = found.withColumn("__pick", F.when((own != F.col("__best.__one")) | F.col("__best.__two").isNotNull(), F.col("__best")).otherwise(F.col("__next"))).where(pick.isNotNull())
    other = F.when(own != pick["__one"], pick["__one"]).otherwise(pick["__two"])
    return found.select(*(F.col(c) for c in left.columns), pick[b].alias(b), pick["share"].alias("share"), other.alias(ids[1]))


def reachable(links: DataFrame, start: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(node, depth): breadth first from ``start`` (node) over ``links`` (src, dst), each node at its first depth. Each level is written, so the next doesn't work it out again."""
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for k in range(1, depth + 1):
        nxt = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = storage.cut(nxt.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen if most is None else seen.orderBy("depth", "node").limit(most)
