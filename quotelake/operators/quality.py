"""Deduplication, ambiguity, document versions, plausibility and the views of what is current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: Sequence[str | Column], order: Sequence[Column], keep_rank: bool = False) -> DataFrame:
    """One row for each key (nulls are equal), the first in ``order``."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1")
    return ranked if keep_rank else ranked.drop("__rn")


def latest_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's row that is last in ``order``, by one aggregate that combines before the shuffle (``order`` must settle ties)."""
    columns = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("__best")
    return df.groupBy(*key).agg(best).select(*key, "__best.*").select(df.columns)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def deduplicate(df: DataFrame, key: Sequence[str], richness: Sequence[Column], arrival: str, count_as: str = "occurrences") -> DataFrame:
    """The richest row of each key, the earliest of equals, with the number of rows that fell together.

    An aggregate that combines before the shuffle: a key with most of all rows is folded where it is read.
    """
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*richness, (-F.col(arrival)).alias("__arrival"))
    folded = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__best"), F.count("*").alias(count_as))
    return folded.select(*key, "__best.*", count_as).select(*df.columns, count_as)


def mark_ambiguous(df: DataFrame, group: Sequence[str], value: str, signs: Sequence[str]) -> DataFrame:
    """Adds ambiguous and reason. A group (no null in ``group``) is ambiguous if it holds two or more values and fewer sign tuples than values:
    something that told them apart is lost. The reason is the first sign that only some rows have, else ``no_sign``."""
    keyed = [F.col(c).isNotNull() for c in group]
    known = F.lit(True)
    for k in keyed:
        known = known & k
    agg = df.where(known).groupBy(*group).agg(
        F.countDistinct(value).alias("__values"),
        F.countDistinct(F.struct(*signs)).alias("__signs"),
        *(F.count(s).alias(f"__has_{s}") for s in signs),
        F.count("*").alias("__n"),
    )
    chain = None
    for s in signs:
        some = (F.col(f"__has_{s}") > 0) & (F.col(f"__has_{s}") < F.col("__n"))
        chain = F.when(some, F.lit(s)) if chain is None else chain.when(some, F.lit(s))
    found = agg.where((F.col("__values") >= 2) & (F.col("__signs") < F.col("__values"))).select(*group, F.lit(True).alias("ambiguous"), chain.otherwise("no_sign").alias("reason"))
    return df.join(found, list(group), "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def mark_versions(df: DataFrame, owner: str, segment: str, family: str, day: str, stale_days: int = 365, translated: Column | None = None, state: str | None = None) -> DataFrame:
    """Adds version_state: DUBLURA for a translation whose owner also has an original, ISTORIC for a document older than its family's newest or in a
    family whose newest is over ``stale_days`` behind the newest of its owner and segment, else the state it had (a decided one is never changed) or IN_VIGOARE."""
    # what a family and a segment know is aggregated, combined before the shuffle, and joined back: no window holds a segment's rows
    original = F.max((~translated).cast("int")) if translated is not None else F.max(F.lit(0))
    families = df.groupBy(owner, segment, family).agg(F.max(day).alias("__newest"), original.alias("__original"))
    leads = families.groupBy(owner, segment).agg(F.max("__newest").alias("__lead"))
    owners = families.groupBy(owner).agg(F.max("__original").alias("__has"))
    rows = df
    for right, keys in ((families.drop("__original"), (owner, segment, family)), (leads, (owner, segment)), *(((owners, (owner,)),) if translated is not None else ())):
        named = right.select(*(F.col(c).alias(f"__{c}") for c in keys), *(c for c in right.columns if c not in keys))
        on = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        rows = rows.join(named, on, "left").drop(*(f"__{c}" for c in keys))
    had = F.lit(None).cast("string") if state is None else F.col(state)
    free = had.isNull() | had.isin("IN_VIGOARE", "DATA_NECUNOSCUTA")
    verdict = F.when(~free, had)
    if translated is not None:
        verdict = verdict.when(translated & (F.col("__has") == 1), "DUBLURA")
    verdict = verdict.when(F.col(day) < F.col("__newest"), "ISTORIC").when(F.datediff("__lead", "__newest") > stale_days, "ISTORIC")
    return rows.withColumn("version_state", verdict.otherwise(F.coalesce(had, F.lit("IN_VIGOARE")))).select(*df.columns, "version_state")


def mark_copies(df: DataFrame, content: str, name: str) -> DataFrame:
    """Adds copy_of: of rows with equal content the one with the longest name (the last of equals) stays, the others point to it."""
    best = F.max(F.struct(F.length(name).alias("n"), F.col(name).alias("name"))).alias("__best")
    held = df.where(F.col(content).isNotNull()).groupBy(F.col(content).alias("__content")).agg(best, F.count("*").alias("__n")).where("__n > 1")
    joined = df.join(held, F.col(content) == F.col("__content"), "left")
    return joined.withColumn("copy_of", F.when(F.col("__best.name") != F.col(name), F.col("__best.name"))).select(*df.columns, "copy_of")


def document_states(df: DataFrame, content: str, name: str, family: str, day: str, as_of: Column) -> DataFrame:
    """Adds state, copy_of and replaced_by to documents: DUBLURA for copies (see ``mark_copies``), VIITOR for those of a day to come, DATA_NECUNOSCUTA without a day, ISTORIC for those of a family
    that has a newer one in force, else IN_VIGOARE.

    Copies and future documents outdate nothing, and one without a day neither outdates nor is outdated. Families are one aggregate, joined back; documents without a family are
    alone, and null contents no copies.
    """
    marked = mark_copies(df, content, name)
    state = F.when(F.col("copy_of").isNotNull(), "DUBLURA").when(F.col(day).isNull(), "DATA_NECUNOSCUTA").when(F.col(day) > as_of, "VIITOR").otherwise("IN_VIGOARE")
    marked = marked.withColumn("state", state)
    newest = marked.where(F.col("state") == "IN_VIGOARE").groupBy(F.col(family).alias("__family")).agg(F.max(day).alias("__newest"))
    joined = marked.join(newest, F.col(family) == F.col("__family"), "left")
    old = (F.col("state") == "IN_VIGOARE") & (F.col(day) < F.col("__newest"))
    return joined.select(*df.columns, F.when(old, "ISTORIC").otherwise(F.col("state")).alias("state"), "copy_of", F.when(old, F.col("__newest")).alias("replaced_by"))


def queue(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that fail a check, with the first that fails as ``motive``."""
    chain = None
    for name, failed in checks:
        chain = F.when(failed, F.lit(name)) if chain is None else chain.when(failed, F.lit(name))
    return df.withColumn("motive", chain).where("motive is not null")


def invalid_rows(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, the others with ``reject_reason``): what a table's checks would refuse. A rule is the test that must hold; unknown passes."""
    chain = F.lit(None).cast("string")
    for name, holds in reversed(list(rules)):
        chain = F.when(~F.coalesce(holds, F.lit(True)), F.lit(name)).otherwise(chain)
    marked = df.withColumn("reject_reason", chain)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def reject_report(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reject_reason").agg(F.count("*").alias("n"))


def replaced_by_authority(df: DataFrame, authority: DataFrame, by: Sequence[str], unit: str, percent_only: Sequence[str], segments: str, percent: str = "procent") -> DataFrame:
    """Rows of ``df`` that an authoritative row covers: the same ``by`` and unit, the same ``percent_only`` if the unit is a percentage, and segments that
    include the row's (a row without segment needs pf and pj both covered). ``segments`` is an array column on both sides."""
    covered = authority.groupBy(*by, unit, *percent_only).agg(
        F.bool_or(F.array_contains(segments, "pf")).alias("__pf"), F.bool_or(F.arrays_overlap(segments, F.array(*map(F.lit, ("pj", "pfa", "imm"))))).alias("__pj")
    )
    right = covered.select(*(F.col(c).alias(f"__a_{c}") for c in [*by, unit, *percent_only]), "__pf", "__pj")
    on = F.lit(True)
    for c in [*by, unit]:
        on = on & (F.col(c) == F.col(f"__a_{c}"))
    for c in percent_only:
        on = on & ((F.col(unit) != percent) | (F.col(c) == F.col(f"__a_{c}")))
    pf = F.array_contains(segments, "pf")
    pj = F.arrays_overlap(F.col(segments), F.array(*map(F.lit, ("pj", "pfa", "imm"))))
    need = F.when(pf & ~pj, F.col("__pf")).when(pj & ~pf, F.col("__pj")).otherwise(F.col("__pf") & F.col("__pj"))
    return df.join(right, on & need, "left_semi")


def current(df: DataFrame, id_: str, state: str, hidden: Sequence[DataFrame], past: Sequence[str] = ("ISTORIC", "DUBLURA", "VIITOR")) -> DataFrame:
    """Rows whose state isn't past (an unknown state stays) and whose id is in none of the hidden tables."""
    out = df.where(F.col(state).isNull() | ~F.col(state).isin(*past))
    for h in hidden:
        out = out.join(h.select(F.col(id_).alias("__hidden")).distinct(), F.col(id_) == F.col("__hidden"), "left_anti")
    return out
