"""The query surface over the domain's tables (``quotelake.schemas``): one function for each question, parameters that are None don't filter.

Each returns one lazy DataFrame; where a question has several answers (cells and what was left out) each is a function of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import arrays, dates, rules, text
from quotelake.functions import vocabulary as V
from quotelake.operators import changes, quality, representative, summaries

SEGMENT = r"(^|[|])(pf|pj|pfa|imm)([|]|$)"


def of_segment(segment: str | None) -> Column | None:
    """The scenario holds the segment, or no segment at all."""
    code = F.coalesce("cod_scenariu", F.lit(""))
    return None if not segment else text.has_item(code, segment) | ~code.rlike(SEGMENT)


def found(words: str | None, *columns: str) -> Column | None:
    """Any of the columns holds the words, whatever their case and marks."""
    if not words:
        return None
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(text.fold(F.col(c)), text.fold(F.lit(words))), F.lit(False))
    return out


def observations(obs: DataFrame, banks: Sequence[str] | None = None, field: str | None = None, unit: str | None = None, words: str | None = None, ambiguous: bool | None = None) -> DataFrame:
    """Observations that meet all given conditions; page them with ``summaries.page_of`` and count them for the total."""
    tests = [
        None if banks is None else F.col("banca").isin(list(banks)), None if field is None else F.col("camp") == field, None if unit is None else F.col("unitate") == unit,
        found(words, "serviciu", "citat", "sectiune"), None if ambiguous is None else F.col("ambiguu") == ambiguous,
    ]
    return obs.where(rules.both(tests))


def summary(obs: DataFrame, sources: DataFrame, banks: DataFrame) -> DataFrame:
    """(metric, n) rows over all tables."""
    one = lambda df, name, what=None: df.agg((F.count("*") if what is None else what).cast("long").alias("n")).select(F.lit(name).alias("metric"), "n")
    return (
        one(banks.where("activ"), "banks").unionByName(one(sources, "sources")).unionByName(one(obs, "observations"))
        .unionByName(one(obs, "ambiguous", F.count_if("ambiguu"))).unionByName(one(obs, "banks_with_values", F.countDistinct("banca")))
    )


def bank_list(banks: DataFrame, obs: DataFrame, releases: DataFrame) -> DataFrame:
    """Banks with their observations and rating. Each side is aggregated before the join, so neither multiplies the other."""
    n = obs.groupBy("banca").agg(F.count("*").alias("observations"), F.countDistinct("camp").alias("fields"))
    rating = releases.groupBy("banca").agg(F.round(F.avg("rating"), 2).alias("rating"), F.count("*").alias("apps"))
    joined = banks.where("activ").select(F.col("slug").alias("banca"), "nume", "tier").join(n, "banca", "left").join(rating, "banca", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("observations", "fields", "apps")})


def source_list(sources: DataFrame, obs: DataFrame, state: str | None = None) -> DataFrame:
    """Sources with the number of values and whether they have data, were tried, or are untouched."""
    n = obs.groupBy("id_sursa").agg(F.count("*").alias("observations"), F.count_if("ambiguu").alias("ambiguous"))
    joined = sources.join(n, F.col("id") == F.col("id_sursa"), "left").drop("id_sursa").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("observations", "ambiguous")})
    where = F.when(F.col("observations") > 0, "has_data").when(F.col("ultima_rulare").isNotNull(), "tried").otherwise("untouched")
    named = joined.withColumns({"state": where, "note": F.trim(text.part(F.coalesce("nota_extractie", F.lit("")), ":", 1)), "file": text.file_name(F.col("sursa"))})
    return named if state is None else named.where(F.col("state") == state)


def price_matrix(obs: DataFrame, fields: Sequence[str], unit: str = "lei", segment: str | None = None, cap: float | None = None) -> DataFrame:
    """Each bank's representative row for each field among plausible, unambiguous current values, with its range and what was left out as implausible."""
    base = obs.where(rules.both([F.col("camp").isin(list(fields)), F.col("unitate") == unit, of_segment(segment), ~F.coalesce("ambiguu", F.lit(False)), F.col("valoare_num").isNotNull()]))
    base = base.withColumn("valoare", F.col("valoare_num").cast("double"))
    return representative.matrix(base, "banca", "camp", "valoare", ["serviciu", "id"], V.LIMITS["suma"] if cap is None else cap, ["id", "serviciu", "valuta", "data_vigoare"])


def ambiguous_left_out(obs: DataFrame, fields: Sequence[str], unit: str = "lei") -> DataFrame:
    return obs.where(F.col("camp").isin(list(fields)) & (F.col("unitate") == unit) & F.col("ambiguu")).groupBy("banca", "camp").agg(F.count("*").alias("n"))


def cell(obs: DataFrame, sources: DataFrame, bank: str, field: str) -> DataFrame:
    """All values behind a cell with their evidence: a link that leads to the quote, the page, or nothing."""
    rows = obs.where((F.col("banca") == bank) & (F.col("camp") == field)).join(sources.select(F.col("id").alias("id_sursa"), "url_public", "sursa"), "id_sursa", "left")
    url = F.coalesce("url_public", F.when(F.col("sursa").startswith("http"), F.col("sursa")))
    return rows.withColumns({"evidence": arrays.evidence_level(url, F.col("pagina")), "link": text.anchor(url, F.col("pagina"), F.col("citat")), "quote": F.left("citat", F.lit(240))}).orderBy("valoare_num", "id")


def rates(obs: DataFrame, category: str, term: str | None = None, product: str | None = None) -> DataFrame:
    """Each bank's representative rate of a category, with term and product told from its words."""
    words = F.concat_ws(" ", "serviciu", "detaliu", "citat")
    months = dates.term_months(F.concat_ws(" ", "cod_scenariu", "serviciu", "detaliu"))
    kind = rules.first_match(words, [("card", "(?iu)card|overdraft|linie de credit|descoperit"), ("rate_magazin", "(?iu)rate (fara|fără)"), ("nevoi_personale", "(?iu)nevoi personale|consum|refinan|[îi]mprumut|personal"), ("ipotecar", "(?iu)ipotec|imobiliar|locuin|casa|home")], F.lit("altele"))
    base = obs.where((F.col("unitate") == "procent") & text.has_item(F.col("cod_scenariu"), category) & ~F.coalesce("ambiguu", F.lit(False)))
    base = base.withColumns({"valoare": F.col("valoare_num").cast("double"), "months": months, "kind": kind})
    base = base.where(rules.both([None if term is None else dates.term_filter(F.col("months"), term), None if product is None else F.col("kind") == product]))
    return representative.matrix(base, "banca", "camp", "valoare", ["serviciu", "id"], V.LIMITS.get(category, V.LIMITS["procent"]), ["id", "serviciu", "months", "kind"])


def term_facets(obs: DataFrame, category: str) -> DataFrame:
    """(option, n) of the terms of a category's rates, empty ones too."""
    months = dates.term_months(F.concat_ws(" ", "cod_scenariu", "serviciu", "detaliu"))
    base = obs.where((F.col("unitate") == "procent") & text.has_item(F.col("cod_scenariu"), category)).select(F.when(months.isNotNull(), dates.term_bucket(months)).alias("term"))
    options = obs.sparkSession.createDataFrame([(t[0],) for t in dates.TERMS], "term string")
    return summaries.facets(base, options, "term")


def history(obs: DataFrame) -> DataFrame:
    """Price changes by effective date, of dated values whose state is known and no copy, implausible ones left out."""
    plausible = ~F.coalesce(((F.col("unitate") == "lei") & (F.col("valoare_num") > V.LIMITS["suma"])) | ((F.col("unitate") == "procent") & (F.col("valoare_num") > V.LIMITS["procent"])), F.lit(False))
    dated = obs.where(plausible & F.col("data_vigoare").isNotNull() & (F.col("stare_data") != "DUBLURA")).withColumn("valoare", F.col("valoare_num").cast("double"))
    return changes.price_changes(dated, ["banca", "camp", "serviciu", "unitate"], "data_vigoare", "valoare", ["id"])


def review_queue(obs: DataFrame) -> DataFrame:
    """Values a person should look at, with the first reason; quotes that are a bare number are left out."""
    bare = F.trim("citat").rlike(r"(?i)^[0-9][0-9.,\s]*(lei|euro|eur|usd|ron|%)?$")
    checks = [
        ("suma_mare", F.coalesce((F.col("unitate").isin("lei", "eur", "usd")) & (F.col("valoare_num") > V.LIMITS["suma"]) & (F.col("camp") != "conditie"), F.lit(False))),
        ("procent_mare", F.coalesce((F.col("unitate") == "procent") & (F.col("valoare_num") > V.LIMITS["procent"]), F.lit(False))),
        ("ambiguu", F.coalesce("ambiguu", F.lit(False))),
        ("incredere_mica", F.coalesce(F.col("confidence") < 0.7, F.lit(False))),
    ]
    return quality.queue(obs, checks).where(~F.coalesce(bare, F.lit(False)))


def queue_groups(obs: DataFrame) -> DataFrame:
    """Queued values by bank, field and service with all sibling values (the first 14, sorted) and which of them are queued."""
    queued = review_queue(obs).groupBy("banca", "camp", "serviciu").agg(F.collect_set("valoare_num").alias("__q"), F.count("*").alias("n"))
    siblings = obs.groupBy("banca", "camp", "serviciu").agg(F.sort_array(F.collect_set("valoare_num")).alias("__all"))
    both = queued.join(siblings.withColumnRenamed("serviciu", "__s").withColumnsRenamed({"banca": "__b", "camp": "__c"}), (F.col("banca") == F.col("__b")) & (F.col("camp") == F.col("__c")) & F.col("serviciu").eqNullSafe(F.col("__s")))
    return both.select("banca", "camp", "serviciu", "n", F.slice("__all", 1, 14).alias("values"), F.sort_array(F.array_intersect("__all", "__q")).alias("queued"))


def coverage(banks: DataFrame, sources: DataFrame, obs: DataFrame, locations: DataFrame) -> DataFrame:
    """What there is for each bank, zeros included."""
    part = lambda df, name, *more: df.groupBy("banca").agg(F.count("*").alias(name), *more)
    parts = [part(sources, "sources", F.count_if(F.col("ultima_rulare").isNotNull()).alias("run")), part(obs, "observations", F.countDistinct("camp").alias("fields")), part(locations, "locations")]
    out = banks.where("activ").select(F.col("slug").alias("banca"))
    for p in parts:
        out = out.join(p, "banca", "left")
    return out.select("banca", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c != "banca"))


def locations_summary(locations: DataFrame, box: tuple[float, float, float, float] = V.ROMANIA) -> DataFrame:
    """Counts by kind and network, mean rating of rated points, points within the box."""
    south, north, west, east = box
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return locations.groupBy("tip", "retea").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 2).alias("rating"), F.count_if(inside).alias("inside"))


def sentiment(reviews: DataFrame) -> DataFrame:
    """Each bank's reviews: number, mean, shares of good and bad ones, and the newest day."""
    share = lambda c: F.round(F.lit(100.0) * F.count_if(c) / F.count("*"), 1)
    return reviews.groupBy("banca").agg(F.count("*").alias("n"), F.round(F.avg("stars"), 2).alias("mean"), share(F.col("stars") >= 4).alias("good"), share(F.col("stars") <= 2).alias("bad"), F.max("posted").alias("newest"))


def index_now(index: DataFrame, as_of: Column) -> DataFrame:
    """Index values in force on a day; an open end counts."""
    return index.where((F.col("valabil_din") <= as_of) & (F.col("valabil_pana").isNull() | (F.col("valabil_pana") >= as_of)))


def index_series(index: DataFrame, tenors: Sequence[str]) -> DataFrame:
    """One row for each day and index with a column for each tenor; of several values of one day the smallest."""
    return index.groupBy("indice", "valabil_din").pivot("scadenta", list(tenors)).agg(F.min("valoare"))


def networks(presence: DataFrame, names: Sequence[str]) -> DataFrame:
    """Bank by network: the account, or NEGASIT."""
    wide = presence.groupBy("banca").pivot("retea", list(names)).agg(F.min("cont"))
    return wide.select("banca", *(F.coalesce(n, F.lit("NEGASIT")).alias(n) for n in names))


def run_estimate(runs: DataFrame, default: float) -> DataFrame:
    """Expected seconds of each (command, bank): the median of its own successes, else of the command's at any bank, else the default."""
    good = runs.where("ok")
    own = good.groupBy("command", "bank").agg(F.median("seconds").alias("__own"))
    any_ = good.groupBy("command").agg(F.median("seconds").alias("__any"))
    every = runs.select("command", "bank").distinct()
    return every.join(own, ["command", "bank"], "left").join(any_, "command", "left").select("command", "bank", F.coalesce("__own", "__any", F.lit(default)).alias("seconds"))


def versus_mobile(releases: DataFrame, screenshots: DataFrame) -> DataFrame:
    """Each bank's current app with its rating, volume and number of screenshots."""
    shots = screenshots.groupBy("banca").agg(F.count("*").alias("capturi"))
    rows = releases.select("banca", "platforma", "versiune", F.col("rating").cast("double").alias("rating"), F.col("volum").cast("long").alias("volum"))
    return rows.join(shots, "banca", "left").withColumn("capturi", F.coalesce("capturi", F.lit(0)).cast("long"))


def versus_network(locations: DataFrame) -> DataFrame:
    """Each bank's branches, own machines, and mean rating of its branches."""
    branch, own = F.col("tip") == "sucursala", (F.col("tip") == "atm") & (F.col("retea") == "proprie")
    return locations.groupBy("banca").agg(F.count_if(branch).alias("sucursale"), F.count_if(own).alias("atm"), F.round(F.avg(F.when(branch, F.col("rating"))), 2).alias("rating_sucursale"))


def versus_sentiment(reviews: DataFrame) -> DataFrame:
    """Each bank's reviews, their mean and the share of bad ones in whole per cent."""
    return reviews.groupBy("banca").agg(F.count("*").alias("review_uri"), F.round(F.avg("stars"), 2).alias("medie_text"), F.round(F.lit(100.0) * F.count_if(F.col("stars") <= 2) / F.count("*"), 0).alias("pct_negative"))


def versus_coverage(banks: DataFrame, obs: DataFrame) -> DataFrame:
    """Each bank's known fields and values, banks without any too."""
    n = obs.groupBy("banca").agg(F.countDistinct("camp").alias("servicii_cunoscute"), F.count("id").alias("valori"))
    return banks.select(F.col("slug").alias("banca")).join(n, "banca", "left").select("banca", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("servicii_cunoscute", "valori")))


def freshness(domains: Sequence[tuple[str, DataFrame, str | None, str | Column]]) -> DataFrame:
    """(domeniu, randuri, ultima, provenienta) of each (name, table, time column or None, origin): rows, newest time, and where they come from; an origin
    given as a column is the sorted list of its different values."""
    out = None
    for name, df, at, origin in domains:
        last = F.lit(None).cast("timestamp_ntz") if at is None else F.max(F.col(at).cast("timestamp_ntz"))
        source = F.lit(origin) if isinstance(origin, str) else arrays.joined_distinct(F.collect_set(origin), " + ")
        row = df.agg(F.count("*").alias("randuri"), last.alias("ultima"), source.alias("provenienta")).select(F.lit(name).alias("domeniu"), "randuri", "ultima", "provenienta")
        out = row if out is None else out.unionByName(row)
    return out


def history_view(changes_: DataFrame, bank: str | None = None, field: str | None = None, direction: str | None = None) -> DataFrame:
    """Price changes of a bank, a field and a direction (scumpire, ieftinire), the newest first and of one day the largest."""
    way = {"scumpire": F.col("delta") > 0, "ieftinire": F.col("delta") < 0, None: None}[direction]
    rows = changes_.where(rules.both([None if bank is None else F.col("banca") == bank, None if field is None else F.col("camp") == field, way]))
    return rows.orderBy(F.desc("data_vigoare"), F.abs("percent").desc_nulls_last())


def history_by_bank(changes_: DataFrame) -> DataFrame:
    return changes_.groupBy("banca").agg(F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("scumpiri"), F.count_if(F.col("delta") < 0).alias("ieftiniri"))


def dating(obs: DataFrame) -> DataFrame:
    """How many observations have which state of dating."""
    return obs.groupBy(F.coalesce("stare_data", F.lit("fara datare")).alias("stare")).agg(F.count("*").alias("n"))


def mobile_reviews(reviews: DataFrame, releases: DataFrame) -> DataFrame:
    """(bank, storefront): reviews, their mean, and the rating that the store itself shows. The store's rating is joined after the count, so it multiplies nothing."""
    stores = releases.groupBy("banca").agg(F.max("rating").alias("rating_agregat_store"))
    return reviews.groupBy("banca", "storefront").agg(F.count("*").alias("review_uri"), F.round(F.avg("stars"), 2).alias("rating_mediu_text")).join(stores, "banca", "left")


def mobile_recent(reviews: DataFrame, most: int = 40) -> DataFrame:
    """The newest reviews, texts and pseudonyms cut."""
    cut = reviews.select("banca", "storefront", "stars", F.left("text", F.lit(240)).alias("text"), F.left("autor_hash", F.lit(12)).alias("autor"), "posted", "id")
    return cut.orderBy(F.col("posted").desc_nulls_last(), "id").limit(most)


def android_apps(apps: DataFrame, versions: DataFrame, reference: str) -> DataFrame:
    """Apps with the figures of their newest version and the number of versions; the reference bank's come first, and its main app before others."""
    n = versions.groupBy("package").agg(F.count("*").alias("nr_versiuni"))
    newest = versions.select("package", F.col("version_name").alias("versiune_cea_mai_noua"), "nr_trackere", "nr_biblioteci")
    rows = apps.join(newest, ["package", "versiune_cea_mai_noua"], "left").join(n, "package", "left").withColumn("nr_versiuni", F.coalesce("nr_versiuni", F.lit(0)).cast("long"))
    return rows.orderBy(F.col("banca") != reference, "banca", F.col("rol") != "principal", "aplicatie")


def android_groups(permissions: DataFrame, apps: DataFrame, groups: Sequence[tuple[str, str]]) -> DataFrame:
    """(package, group, n) of the permissions of each app's newest version, by ordered (group, pattern); others are in no group."""
    newest = apps.select("package", F.col("versiune_cea_mai_noua").alias("version_name"))
    return permissions.join(newest, ["package", "version_name"], "left_semi").groupBy("package", rules.first_match(F.col("permisiune"), groups, F.lit("altele")).alias("grup")).agg(F.count("*").alias("n"))


#: Verdicts on a feature, the surest first.
VERDICTS = ("prezent", "probabil", "absent")


def verdict_rank(verdict: Column) -> Column:
    """Place of a verdict, unknown ones last."""
    chain = None
    for i, v in enumerate(VERDICTS):
        chain = F.when(verdict == v, i) if chain is None else chain.when(verdict == v, i)
    return chain.otherwise(len(VERDICTS))


def product_catalogue(products: DataFrame) -> DataFrame:
    """Products, the priority ones first, then by category (none last) and name."""
    return products.orderBy(F.col("produs_prioritar").desc_nulls_last(), F.coalesce("categorie_cod", F.lit("ZZ")), "denumire")


def country_share(countries: Column, country: str = "Romania") -> Column:
    """The share of a country in an array of structs (Country, ImpressionShare), as a number of per cent; null without it."""
    own = F.get(F.filter(countries, lambda x: x["Country"] == country), F.lit(0))
    return F.regexp_replace(F.translate(own["ImpressionShare"], "%", ""), ",", ".").try_cast("double")


def search_ads(banks: DataFrame) -> DataFrame:
    """A row for each ad of banks (banca, reclame array of ads as the library shows them), with the home country's share and whether it is the larger part."""
    rows = banks.select("banca", F.explode("reclame").alias("r"))
    d = F.col("r.AdDetails")
    share = country_share(d["ImpressionsByCountry"])
    return rows.select(
        "banca", F.col("r.AdvertiserName").alias("advertiser"), F.col("r.Title").alias("titlu"), d["StartDate"].alias("start"), d["EndDate"].alias("sfarsit"),
        d["TotalImpressionsRange"].alias("afisari"), share.alias("pondere_ro"), F.coalesce(share >= 50, F.lit(False)).alias("mai_ales_ro"),
    )


def search_ads_by_bank(ads_: DataFrame) -> DataFrame:
    return ads_.groupBy("banca").agg(F.count_if("mai_ales_ro").alias("ro"), F.count_if(~F.col("mai_ales_ro")).alias("altele"))


def videos(snapshot: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Videos of a dated snapshot (data_extragerii, sterge_la, nou_fata_de, banca, canal, videoclipuri array), while it may be shown: before its day of
    deletion (``days`` after the extraction where none is given). Banks without a channel don't appear, and nothing is new without a reference."""
    taken = F.try_to_date("data_extragerii")
    until = F.coalesce(F.try_to_date("sterge_la"), F.date_add(taken, days))
    kept = snapshot.where((as_of < until) & (F.datediff(as_of, taken) < days) & F.col("canal").isNotNull())
    fresh = F.coalesce(F.col("v.nou"), F.lit(False)) & F.col("nou_fata_de").isNotNull()
    return kept.select("banca", "canal", "nou_fata_de", F.explode_outer("videoclipuri").alias("v")).select("banca", "canal", F.col("v.id").alias("id"), F.col("v.publicat_la").alias("publicat_la"), fresh.alias("nou"))


def campaign_tallies(campaigns: DataFrame) -> DataFrame:
    """Each bank's campaigns by state, with how many compare."""
    return campaigns.groupBy("banca", "state").agg(F.count("*").alias("n"), F.count_if("in_comparison").alias("in_comparison"))


def commonest_motives(queue: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest motives of a review queue."""
    return queue.groupBy("motive").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "motive").limit(k)
