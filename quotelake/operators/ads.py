"""Advertising and campaigns: enrichment, retention, merging of evidence and current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.functions import arrays

OPEN = 2**63 - 1


def enrich_ads(ads: DataFrame, advertisers: DataFrame, roles: tuple[str, ...] = ("banca", "filiala")) -> DataFrame:
    """Ads of known advertisers in wanted roles, with bank, main platform, open interval and days shown."""
    known = advertisers.where(F.col("rol").isin(*roles)).groupBy("advertiser_id").agg(F.min(F.struct("banca", "rol")).alias("__a")).select("advertiser_id", "__a.*")
    return ads.join(known, "advertiser_id").withColumns(
        {
            "platform": arrays.main_platform(F.col("platforme")),
            "low": F.coalesce("times_shown_lower_bound", F.lit(0)),
            "open": F.coalesce(F.col("times_shown_upper_bound") == OPEN, F.lit(False)),
            "high": F.when(F.col("times_shown_upper_bound") != OPEN, F.col("times_shown_upper_bound")),
            "days": F.datediff("last_shown", "first_shown") + 1,
        }
    )


def on_platform(ads: DataFrame, name: str) -> DataFrame:
    """Ads whose main platforms (``A+B``) hold this one."""
    return ads.where(F.array_contains(F.split("platform", "[+]"), name))


def ads_summary(ads: DataFrame, by: list[str]) -> DataFrame:
    """Sums of both ends, whether any is open, and activity relative to the last day in the data, not the clock."""
    last = ads.agg(F.max("last_shown").alias("__d"))
    rows = ads.crossJoin(F.broadcast(last))
    active = lambda n: F.count_if(F.col("last_shown") >= F.date_sub("__d", n)).alias(f"active{n}")
    new = F.count_if(F.col("first_shown") >= F.date_sub("__d", 30)).alias("new30")
    return rows.groupBy(*by).agg(F.count("*").alias("ads"), F.sum("low").alias("low"), F.sum(F.coalesce("high", F.lit(0))).alias("high"), F.bool_or("open").alias("open"), active(7), active(30), active(90), new)


def merge_campaign(evidence: DataFrame, as_of: Column) -> DataFrame:
    """One campaign from its pieces of evidence (campaign, origin rank, title, start, end, benefit, deduced, fetched): title, window and benefit of the best-ranked piece that has
    them, its state on a day, and why it should be looked at."""
    best = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("rank")))
    window = F.min_by(F.struct("start", "end", "deduced"), F.when(F.col("start").isNotNull() | F.col("end").isNotNull(), F.col("rank")))
    merged = evidence.groupBy("campaign").agg(best("title").alias("title"), best("benefit").alias("benefit"), window.alias("__w"), F.bool_and("fetched").alias("__f"), F.count("*").alias("pieces"))
    rows = merged.select("campaign", "title", "benefit", "pieces", "__f", F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), F.col("__w.deduced").alias("__d"))
    long = F.datediff("end", "start") > 3 * 366
    why = F.array_compact(
        F.array(
            F.when(F.coalesce(long, F.lit(False)), "window_too_long"), F.when(F.coalesce("__d", F.lit(False)), "year_deduced"),
            F.when(F.col("start").isNull() != F.col("end").isNull(), "one_date"), F.when(~F.coalesce("__f", F.lit(False)), "not_fetched"),
        )
    )
    state = F.when(F.size(why) > 0, "de_verificat").when(F.col("end") < as_of, "incheiata").when(F.col("start") > as_of, "viitoare").when(F.col("start").isNull(), "nedatata").otherwise("activa")
    return rows.withColumns({"reasons": why, "state": state}).drop("__f", "__d")


def current_campaigns(campaigns: DataFrame, as_of: Column) -> DataFrame:
    """Campaigns of each bank's latest snapshot day, with whether they compare and whether they ended meanwhile."""
    last = F.max(F.to_date("data_rulare")).over(Window.partitionBy("banca"))
    rows = campaigns.withColumn("__last", last).where(F.to_date("data_rulare") == F.col("__last")).drop("__last")
    return rows.withColumns({"in_comparison": F.col("state").isin("activa", "viitoare"), "ended_today": F.coalesce(F.col("end") < as_of, F.lit(False)) & (F.col("state") == "activa")})


def with_documents(campaigns: DataFrame, documents: DataFrame) -> DataFrame:
    """Campaigns with their documents as a JSON array in order of address, ``[]`` where there are none."""
    docs = documents.groupBy("campaign").agg(F.to_json(F.sort_array(F.collect_list(F.struct("url", "kind")))).alias("documents"))
    return campaigns.join(docs, "campaign", "left").withColumn("documents", F.coalesce("documents", F.lit("[]")))


def new_labels(now: DataFrame, reference: DataFrame, reference_day: Column) -> DataFrame:
    """Adds is_new: an id that the bank's reference extraction doesn't have; for a bank without one, published after the reference day."""
    seen = reference.select("banca", "id").distinct().withColumn("__seen", F.lit(True))
    banks = reference.select("banca").distinct().withColumn("__bank", F.lit(True))
    joined = now.join(seen, ["banca", "id"], "left").join(banks, "banca", "left")
    return joined.withColumn("is_new", F.when(F.col("__bank").isNotNull(), F.col("__seen").isNull()).otherwise(F.coalesce(F.col("published") > reference_day, F.lit(False)))).drop("__seen", "__bank")
