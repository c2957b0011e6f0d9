"""Questions of the survey pages that stand beside the main ones: campaigns by address, histories by month, names, pages with totals, samples, flags of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.functions import dates, text
from quotelake.operators import campaigns, discovery, normalise, summaries
from quotelake.plans.registry import query, table
from quotelake.sources import readers

# ---- campaigns by address

_URL = """'https://www.b' || (p_partkey % 7) || '.ro/' || CASE WHEN p_size < 8 THEN 'doc/Regulament%20campanie-' || p_name WHEN p_size < 14 THEN 'promo/' || p_name WHEN p_size < 18 THEN 'promos/' || p_name
  WHEN p_size < 22 THEN 'plata-in-rate/regulament-' || p_name WHEN p_size < 30 THEN 'carduri/Bonus-' || p_size || '/' || p_name WHEN p_size < 36 THEN 'castiga/' || p_name WHEN p_size < 40 THEN 'castigatori/' || p_name ELSE 'credite/' || p_name END"""
_KIND = "CASE WHEN p_size < 8 THEN 'regulament' WHEN p_size < 14 OR p_size BETWEEN 22 AND 35 THEN 'campanie' END"


@query(f"SELECT p_partkey, {_KIND} AS kind FROM part")
def flt08_campaign_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by LIKE ANY, NOT LIKE ANY, and words with borders where a part of a word would do harm."""
    return table(spark, sf_dir, "part").select("p_partkey", discovery.campaign_kind(F.expr(_URL)).alias("kind"))


@query(f"""WITH s AS (SELECT p_partkey, {_KIND} AS kind, p_name FROM part),
o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'nominala' WHEN 'R' THEN 'dae' ELSE 'suma' END AS field FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, field, kind, CASE WHEN kind = 'regulament' AND p_name LIKE 'red%' AND field <> 'suma' THEN 'standing rate' WHEN kind = 'campanie' AND contains(p_name, 'ring') AND field = 'dae' THEN 'example' END AS exception
FROM o JOIN s ON l_partkey = p_partkey WHERE kind IS NOT NULL""")
def d17_campaign_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that come from campaigns' addresses, and the first exception that lets one through."""
    field = F.when(F.col("l_returnflag") == "A", "nominala").when(F.col("l_returnflag") == "R", "dae").otherwise("suma")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("id_source"), field.alias("field"))
    sources = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_URL).alias("url"))
    rules = [(1, "regulament%20campanie-red", ["nominala", "dae"], "standing rate"), (2, "/(promo|carduri|castiga)/.*ring", ["dae"], "example")]
    exceptions = spark.createDataFrame(rules, "no int, pattern string, fields array<string>, reason string")
    return discovery.campaign_observations(rows, sources, exceptions).select("l_orderkey", "l_linenumber", "l_suppkey", "field", "kind", "exception")


@query("""WITH o AS (SELECT o_orderkey, (o_orderdate + INTERVAL 300 MONTH)::DATE AS day FROM orders), t AS (SELECT *, day + 20 AS last FROM o)
SELECT o_orderkey, day AS start, last AS "end", TRUE AS anchored FROM t""")
def dat08_repeated_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that is named twice is judged by the place where the anchor stands, not by its first."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 300)
    write = lambda d: F.date_format(d, "dd.MM.yyyy")
    span = F.concat(write(day), F.lit(" - "), write(F.date_add(day, 20)))
    words = F.concat(F.lit("Oferta se vede la ghișeu "), span, F.lit(". "), F.repeat(F.lit("Un text fără rost despre altceva. "), F.lit(6)), F.lit("Perioada campaniei: "), span, F.lit("."))
    found = table(spark, sf_dir, "orders").select("o_orderkey", campaigns.period(words).alias("p"))
    return found.select("o_orderkey", "p.start", "p.end", "p.anchored")


# ---- histories and searches


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_shipdate::DATE >= DATE '2000-12-01' - 183 AND (l_returnflag <> 'A') AND l_shipdate IS NOT NULL""")
def flt18_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the last six months of 30.44 days, those in percent left out."""
    unit = F.when(F.col("l_returnflag") == "A", "procent").otherwise("lei")
    rows = table(spark, sf_dir, "lineitem").where(dates.within_months(F.col("l_shipdate").cast("date"), F.lit("2000-12-01").cast("date"), 6) & (unit != "procent"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY')")
def flt16_search_without_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for "romana mă" and one for "CLĂD" over joined fields, whatever their case and marks."""
    words = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "Banca Română ").otherwise("Banca Germană "), F.when(F.col("c_mktsegment") == "BUILDING", "clădiri").when(F.col("c_mktsegment") == "MACHINERY", "mașini").otherwise("altele"))
    folded = text.fold(words)
    hit = folded.contains("romana ") & (F.contains(folded, text.fold(F.lit("CLĂD"))) | F.contains(folded, text.fold(F.lit("romana mă"))))
    return table(spark, sf_dir, "customer").where(hit).select("c_custkey")


@query("""SELECT s_suppkey, s_name AS short, CASE s_nationkey % 3 WHEN 0 THEN 'Comision · minim' WHEN 1 THEN 'dobanda anuala' ELSE 'Limită' END AS label FROM supplier""")
def str16_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks' short names, and fields' labels with their ends."""
    n = F.col("s_nationkey") % 3
    name = F.concat("s_name", F.when(n == 0, " — Groupe Société Générale").when(n == 1, " N.V. Amsterdam, Sucursala").otherwise(" S.A."))
    field = F.when(n == 0, "comision_min").when(n == 1, "dobanda_anuala").otherwise("limita")
    label = text.field_label(field, {"comision": "Comision", "limita": "Limită"}, {"min": "minim", "max": "maxim"})
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.short_name(name).alias("short"), label.alias("label"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size::VARCHAR WHEN p_size % 4 = 1 THEN p_name WHEN p_size % 4 = 2 THEN '' END AS v FROM part WHERE p_size <= 40)
SELECT p_partkey, (SELECT count(*) FROM t) AS total FROM t ORDER BY coalesce(trim(v) = '', TRUE), TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), v, p_partkey LIMIT 100 OFFSET 50""")
def ord02_ord06_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a list in natural order (numbers before texts, blanks last), with the total of the same filter."""
    v = F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 4 == 1, F.col("p_name")).when(F.col("p_size") % 4 == 2, "")
    rows = table(spark, sf_dir, "part").where("p_size <= 40").select("p_partkey", v.alias("v"))
    return summaries.page_with_total(rows, [*summaries.natural_order(F.col("v")), F.col("p_partkey")], 100, 50).select("p_partkey", "total")


# ---- samples, firsts and flags


@query("""WITH o AS (SELECT doc_id, lang, source, md5('7:' || doc_id) AS h FROM documents), w AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) > 3 AS late FROM o)
SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY late, h, doc_id) AS rn FROM w) WHERE rn <= 25""")
def ord08_sample_topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 documents of each language, three of a source first and then whatever is next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return summaries.sample_by_quota(docs, "lang", 25, "doc_id", within="source", most=3, seed="7", top_up=True).select("doc_id")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def set05_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event of each kind, by place in time."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return summaries.first_of_each(events, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, bool_or(o_orderstatus = 'F') OVER w AS has_final, bool_or(o_totalprice > 300000) OVER w AS has_large FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def win10_any_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each order's customer: any final order, any large one."""
    orders = table(spark, sf_dir, "orders")
    return summaries.any_in_group(orders, ["o_custkey"], {"has_final": F.col("o_orderstatus") == "F", "has_large": F.col("o_totalprice") > 300000}).select("o_orderkey", "has_final", "has_large")


@query("""WITH q AS (SELECT * FROM (VALUES (5.56, DATE '2026-07-01', DATE '2026-09-30'), (5.58, DATE '2025-07-01', DATE '2025-09-30'), (6.06, DATE '2026-04-01', DATE '2026-06-30')) AS t(v, a, b)),
r AS (SELECT o_orderkey, round(5.5 + (o_orderkey % 60) / 100.0, 2) AS value, CASE o_orderstatus WHEN 'F' THEN DATE '2025-09-30' WHEN 'P' THEN DATE '2024-09-30' END AS e FROM orders)
SELECT o_orderkey, CASE WHEN e IS NOT NULL AND abs(value - 5.56) <= 0.05 AND NOT coalesce(abs(value - (SELECT v FROM q WHERE e BETWEEN a AND b)) < abs(value - 5.56), FALSE) THEN 'year_typo' WHEN e IS NOT NULL THEN 'period_over'
  WHEN abs(value - 5.56) <= 0.05 THEN 'fine' WHEN abs(value - 6.06) <= 0.05 OR abs(value - 5.58) <= 0.05 THEN 'older_quarter' WHEN abs(value - 5.56) > 0.5 THEN 'far_from_index' ELSE 'off_index' END AS why FROM r""")
def d12_year_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated index values whose period is over: a wrong year beside the value in force, or a value of that time."""
    index = spark.createDataFrame([("ircc_valoare", 5.56, "2026-07-01", "2026-09-30"), ("ircc_valoare", 5.58, "2025-07-01", "2025-09-30"), ("ircc_valoare", 6.06, "2026-04-01", "2026-06-30")], "kind string, value double, a string, b string")
    index = index.select("kind", "value", F.col("a").cast("date").alias("valid_from"), F.col("b").cast("date").alias("valid_to"))
    end = F.when(F.col("o_orderstatus") == "F", "2025-09-30").when(F.col("o_orderstatus") == "P", "2024-09-30").cast("date")
    rates = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("ircc_valoare").alias("kind"), F.round(5.5 + (F.col("o_orderkey") % 60) / 100, 2).alias("value"), end.alias("period_end"))
    return normalise.validate(rates, index, F.lit("2026-09-16").cast("date"), year_typos=True).select("o_orderkey", F.coalesce("why", F.lit("fine")).alias("why"))


@query("""WITH f AS (SELECT 'out/google_' || strftime(o_orderdate, '%Y-%m-%d') AS folder, CASE WHEN o_orderstatus = 'F' THEN 'google_advertiseri.csv' ELSE 'atc_ro_' || o_orderkey || '.csv' END AS file FROM orders),
n AS (SELECT folder, file LIKE 'atc_ro_%' AS ads, max(file) AS file FROM f GROUP BY 1, 2), w AS (SELECT max(folder) AS folder FROM (SELECT folder FROM n GROUP BY 1 HAVING count(*) = 2))
SELECT CASE WHEN ads THEN 'ads' ELSE 'map' END AS name, folder || '/' || file AS path FROM n JOIN w USING (folder)""")
def src16_newest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest dated folder that has both files, and which files these are."""
    file = F.when(F.col("o_orderstatus") == "F", "google_advertiseri.csv").otherwise(F.concat(F.lit("atc_ro_"), F.col("o_orderkey"), F.lit(".csv")))
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("out/google_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), file).alias("path"))
    return readers.newest_complete(files, {"ads": r"^atc_ro_.*\.csv$", "map": r"^google_advertiseri\.csv$"})
