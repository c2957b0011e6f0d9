"""The query surface of ``market`` over the star-schema tables, mapped to the domain's: each question with its DuckDB SQL.

Lineitems are observations (the supplier's nation is the bank), suppliers sources, nations banks, events reviews and runs, customers locations, orders an index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelake.operators import ads, summaries
from quotelake.plans import market
from quotelake.plans.registry import query, table

_BANKS = "b AS (SELECT n_nationkey, lower(n_name) AS slug, n_name AS nume, n_regionkey <> 4 AS activ FROM nation)"
_OBS = f"""{_BANKS},
obs AS (SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS id, slug AS banca, l_suppkey AS id_sursa,
  CASE l_returnflag WHEN 'A' THEN 'administrare_cont' WHEN 'N' THEN 'retragere_numerar' ELSE 'transfer_credit' END AS camp,
  CASE l_suppkey % 4 WHEN 0 THEN 'conturi|pf' WHEN 1 THEN 'conturi|pj' WHEN 2 THEN 'depozite|pf|12 luni' ELSE 'depozite' END AS cod_scenariu,
  CASE WHEN l_linenumber % 3 = 0 THEN (l_discount * 450 + l_linenumber)::DECIMAL(18,6) ELSE (l_extendedprice / 10)::DECIMAL(18,6) END AS valoare_num,
  CASE WHEN l_linenumber % 3 = 0 THEN 'procent' ELSE 'lei' END AS unitate, 'LEI' AS valuta,
  CASE WHEN l_partkey % 6 = 0 THEN l_linenumber || ',5 lei' ELSE 'cost de ' || l_linenumber || ' lei pe luna' END AS citat,
  (0.5 + (l_partkey % 5) / 10.0)::DECIMAL(4,3) AS confidence, l_partkey % 11 = 0 AS ambiguu, CASE WHEN l_linestatus = 'F' THEN 'pdf' ELSE 'html' END AS metoda_extractie,
  CASE WHEN l_linenumber % 2 = 0 THEN 'Depozit ' || l_linenumber || ' luni' ELSE 'serviciu ' || l_linenumber END AS serviciu, CASE WHEN l_linenumber <> 4 THEN l_linenumber END AS pagina,
  l_shipdate::DATE AS data_vigoare, CASE l_orderkey % 7 WHEN 0 THEN 'ISTORIC' WHEN 1 THEN 'DUBLURA' WHEN 2 THEN NULL ELSE 'IN_VIGOARE' END AS stare_data
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN b ON s_nationkey = n_nationkey)"""
_SOURCES = """src AS (SELECT s_suppkey AS id, slug AS banca, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'https://' || slug || '.ro/doc/' || s_suppkey || '.pdf' END AS sursa,
  CASE WHEN s_acctbal > 0 THEN TIMESTAMP '2026-09-01 00:00:00' END AS ultima_rulare, CASE WHEN s_suppkey % 3 = 0 THEN 'nota ' || s_suppkey || ': mai mult' END AS nota_extractie
  FROM supplier JOIN b ON s_nationkey = n_nationkey)"""
_REVIEWS = """rev AS (SELECT event_id AS id, slug AS banca, event_type AS storefront, (1 + event_id % 5)::INTEGER AS stars, ts::DATE AS posted, props AS text, sha256('s|' || user_id) AS autor_hash
  FROM events JOIN b ON user_id % 25 = n_nationkey)"""
_PLACES = """loc AS (SELECT slug AS banca, CASE WHEN c_custkey % 3 = 0 THEN 'sucursala' ELSE 'atm' END AS tip, CASE WHEN c_custkey % 4 = 0 THEN 'partener' ELSE 'proprie' END AS retea,
  43.0 + (c_custkey % 60) / 10.0 AS lat, 20.0 + (c_custkey % 101) / 10.0 AS lon, CASE WHEN c_custkey % 7 <> 0 THEN 1.0 + (c_custkey % 9) / 2.0 END AS rating FROM customer JOIN b ON c_nationkey = n_nationkey)"""
_APPS = """app AS (SELECT slug AS banca, CASE s_suppkey % 2 WHEN 0 THEN 'ios' ELSE 'android' END AS platforma, '1.' || s_suppkey AS versiune, round(1 + abs(s_acctbal) % 4, 2) AS rating, s_suppkey * 10 AS volum
  FROM supplier JOIN b ON s_nationkey = n_nationkey)"""


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("slug"), F.col("n_name").alias("nume"), F.lit("mare").alias("tier"), (F.col("n_regionkey") != 4).alias("activ"))


def _of_bank(spark: SparkSession, sf_dir: str, df: DataFrame, key: str) -> DataFrame:
    own = banks(spark, sf_dir).select(F.col("n_nationkey").alias("__n"), F.col("slug").alias("banca"))
    return df.join(own, F.col(key) == F.col("__n")).drop("__n")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _of_bank(spark, sf_dir, table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey").drop("s_nationkey")
    line = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    c = F.col
    pick = lambda key, n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (c(key) % n + 1).cast("int"))
    number = F.when(c("l_linenumber") % 3 == 0, (c("l_discount") * 450 + c("l_linenumber")).cast("decimal(18,6)")).otherwise((c("l_extendedprice") / 10).cast("decimal(18,6)"))
    return line.select(
        (c("l_orderkey") * 100_000_000 + c("l_partkey") * 10 + c("l_linenumber")).alias("id"), "banca", c("l_suppkey").alias("id_sursa"),
        F.when(c("l_returnflag") == "A", "administrare_cont").when(c("l_returnflag") == "N", "retragere_numerar").otherwise("transfer_credit").alias("camp"),
        pick("l_suppkey", 4, "conturi|pf", "conturi|pj", "depozite|pf|12 luni", "depozite").alias("cod_scenariu"),
        number.alias("valoare_num"), F.when(c("l_linenumber") % 3 == 0, "procent").otherwise("lei").alias("unitate"), F.lit("LEI").alias("valuta"),
        F.when(c("l_partkey") % 6 == 0, F.concat("l_linenumber", F.lit(",5 lei"))).otherwise(F.concat(F.lit("cost de "), "l_linenumber", F.lit(" lei pe luna"))).alias("citat"),
        (F.lit(0.5) + (c("l_partkey") % 5) / 10).cast("decimal(4,3)").alias("confidence"), (c("l_partkey") % 11 == 0).alias("ambiguu"),
        F.when(c("l_linestatus") == "F", "pdf").otherwise("html").alias("metoda_extractie"),
        F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("Depozit "), "l_linenumber", F.lit(" luni"))).otherwise(F.concat(F.lit("serviciu "), "l_linenumber")).alias("serviciu"),
        F.lit(None).cast("string").alias("sectiune"), F.lit(None).cast("string").alias("detaliu"), F.when(c("l_linenumber") != 4, c("l_linenumber")).alias("pagina"),
        c("l_shipdate").cast("date").alias("data_vigoare"), pick("l_orderkey", 7, "ISTORIC", "DUBLURA", None, "IN_VIGOARE", "IN_VIGOARE", "IN_VIGOARE", "IN_VIGOARE").alias("stare_data"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    s = _of_bank(spark, sf_dir, table(spark, sf_dir, "supplier"), "s_nationkey")
    url = F.concat(F.lit("https://"), "banca", F.lit(".ro/doc/"), "s_suppkey", F.lit(".pdf"))
    return s.select(
        c("s_suppkey").alias("id"), "banca", F.when(c("s_suppkey") % 5 == 0, c("s_name")).otherwise(url).alias("sursa"),
        F.when(c("s_acctbal") > 0, F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")).alias("ultima_rulare"), F.lit(None).cast("string").alias("url_public"),
        F.when(c("s_suppkey") % 3 == 0, F.concat(F.lit("nota "), "s_suppkey", F.lit(": mai mult"))).alias("nota_extractie"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("__key", F.col("user_id") % 25)
    rows = _of_bank(spark, sf_dir, e, "__key")
    return rows.select(
        F.col("event_id").alias("id"), "banca", F.col("event_type").alias("storefront"), (F.col("event_id") % 5 + 1).cast("int").alias("stars"), F.to_date("ts").alias("posted"),
        F.col("props").alias("text"), F.sha2(F.concat(F.lit("s|"), F.col("user_id").cast("string")), 256).alias("autor_hash"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = _of_bank(spark, sf_dir, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")
    return rows.select(
        "banca", F.when(c % 3 == 0, "sucursala").otherwise("atm").alias("tip"), F.when(c % 4 == 0, "partener").otherwise("proprie").alias("retea"),
        (F.lit(43.0) + (c % 60) / 10).alias("lat"), (F.lit(20.0) + (c % 101) / 10).alias("lon"), F.when(c % 7 != 0, F.lit(1.0) + (c % 9) / 2).alias("rating"),
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of_bank(spark, sf_dir, table(spark, sf_dir, "supplier"), "s_nationkey")
    return rows.select(
        "banca", F.when(F.col("s_suppkey") % 2 == 0, "ios").otherwise("android").alias("platforma"), F.concat(F.lit("1."), "s_suppkey").alias("versiune"),
        F.round(F.lit(1) + F.abs("s_acctbal") % 4, 2).alias("rating"), (F.col("s_suppkey") * 10).alias("volum"),
    )


@query(f"""WITH {_OBS}, {_SOURCES}
SELECT 'banks' AS metric, count(*) AS n FROM b WHERE activ UNION ALL SELECT 'sources', count(*) FROM src UNION ALL SELECT 'observations', count(*) FROM obs
UNION ALL SELECT 'ambiguous', count(*) FILTER (WHERE ambiguu) FROM obs UNION ALL SELECT 'banks_with_values', count(DISTINCT banca) FROM obs""")
def api_sumar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.summary(observations(spark, sf_dir), sources(spark, sf_dir), banks(spark, sf_dir))


@query(f"""WITH {_OBS}, {_APPS}, o AS (SELECT banca, count(*) AS observations, count(DISTINCT camp) AS fields FROM obs GROUP BY 1), r AS (SELECT banca, round(avg(rating), 2) AS rating, count(*) AS apps FROM app GROUP BY 1)
SELECT slug AS banca, nume, 'mare' AS tier, coalesce(observations, 0) AS observations, coalesce(fields, 0) AS fields, rating, coalesce(apps, 0) AS apps FROM b LEFT JOIN o ON o.banca = slug LEFT JOIN r ON r.banca = slug WHERE activ""")
def api_banci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.bank_list(banks(spark, sf_dir), observations(spark, sf_dir), releases(spark, sf_dir))


@query(f"""WITH {_OBS} SELECT id, banca, camp, valoare_num::DOUBLE AS valoare FROM obs WHERE unitate = 'lei' AND NOT ambiguu AND (serviciu ILIKE '%DEPOZIT%' OR citat ILIKE '%DEPOZIT%')
ORDER BY valoare_num DESC NULLS LAST, id LIMIT 100 OFFSET 10""")
def api_observatii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of what meets all conditions given."""
    found = market.observations(observations(spark, sf_dir), unit="lei", words="DEPOZIT", ambiguous=False)
    return summaries.page_of(found, [F.col("valoare_num").desc_nulls_last(), F.col("id")], 100, 10).select("id", "banca", "camp", F.col("valoare_num").cast("double").alias("valoare"))


@query(f"""WITH {_OBS}, {_SOURCES}, n AS (SELECT id_sursa, count(*) AS observations, count(*) FILTER (WHERE ambiguu) AS ambiguous FROM obs WHERE unitate = 'procent' AND camp = 'transfer_credit' GROUP BY 1)
SELECT id, coalesce(observations, 0) AS observations, coalesce(ambiguous, 0) AS ambiguous, CASE WHEN observations > 0 THEN 'has_data' WHEN ultima_rulare IS NOT NULL THEN 'tried' ELSE 'untouched' END AS state,
  trim(split_part(coalesce(nota_extractie, ''), ':', 1)) AS note, list_last(string_split(regexp_replace(sursa, '[?#].*$', ''), '/')) AS file FROM src LEFT JOIN n ON id = id_sursa""")
def api_surse(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).where("unitate = 'procent' and camp = 'transfer_credit'")
    return market.source_list(sources(spark, sf_dir), obs).select("id", "observations", "ambiguous", "state", "note", "file")


_CELLS = """, m AS (SELECT *, valoare_num::DOUBLE AS v FROM obs WHERE camp IN ('administrare_cont', 'transfer_credit') AND unitate = 'lei' AND NOT ambiguu
  AND (list_contains(string_split(cod_scenariu, '|'), 'pf') OR NOT regexp_matches(cod_scenariu, '(^|[|])(pf|pj|pfa|imm)([|]|$)'))),
r AS (SELECT *, row_number() OVER (PARTITION BY banca, camp ORDER BY v, serviciu, id) AS rn, count(*) OVER (PARTITION BY banca, camp) AS n, min(v) OVER (PARTITION BY banca, camp) AS low, max(v) OVER (PARTITION BY banca, camp) AS high
  FROM m WHERE v <= 10000), x AS (SELECT banca, camp, count(*) FILTER (WHERE v > 10000) AS implausible FROM m GROUP BY 1, 2)"""


@query(f"WITH {_OBS}{_CELLS} SELECT r.banca, r.camp, v AS value, id, serviciu, n, low, high, implausible FROM r JOIN x ON r.banca = x.banca AND r.camp = x.camp WHERE rn = (n + 1) // 2")
def api_matrice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks by fields, a segment's values and those of no segment."""
    cells = market.price_matrix(observations(spark, sf_dir), ["administrare_cont", "transfer_credit"], segment="pf")
    return cells.select("banca", "camp", "value", "id", "serviciu", "n", "low", "high", "implausible")


@query(f"WITH {_OBS} SELECT banca, camp, count(*) AS n FROM obs WHERE camp IN ('administrare_cont', 'transfer_credit') AND unitate = 'lei' AND ambiguu GROUP BY 1, 2")
def api_matrice_ambigue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ambiguous_left_out(observations(spark, sf_dir), ["administrare_cont", "transfer_credit"])


@query(f"""WITH {_OBS}, {_SOURCES}, one AS (SELECT max(slug) AS bank FROM b JOIN supplier ON s_nationkey = n_nationkey)
SELECT obs.id, CASE WHEN sursa LIKE 'http%' THEN 'link' WHEN pagina IS NOT NULL THEN 'page' ELSE 'none' END AS evidence,
  CASE WHEN sursa LIKE 'http%' THEN sursa || CASE WHEN pagina IS NOT NULL THEN '#page=' || pagina || '&search=' || replace(replace(citat, ' ', '%20'), ',', '%2C') ELSE '' END END AS link, left(citat, 240) AS quote
FROM obs LEFT JOIN src ON id_sursa = src.id, one WHERE obs.banca = one.bank AND camp = 'transfer_credit'""")
def api_celula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value behind one cell, with what proves it."""
    own = banks(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi").agg(F.max("slug").alias("bank"))
    obs = observations(spark, sf_dir).crossJoin(F.broadcast(own)).where("banca = bank").withColumn("banca", F.lit("one"))
    return market.cell(obs, sources(spark, sf_dir), "one", "transfer_credit").select("id", "evidence", "link", "quote")


_RATES = """, t AS (SELECT *, valoare_num::DOUBLE AS v, CASE WHEN cod_scenariu LIKE '%12 luni%' THEN 12 ELSE try_cast(regexp_extract(serviciu, 'Depozit ([0-9]+) luni', 1) AS INTEGER) END AS months FROM obs
  WHERE unitate = 'procent' AND list_contains(string_split(cod_scenariu, '|'), 'depozite'))"""


@query(f"""WITH {_OBS}{_RATES}, m AS (SELECT * FROM t WHERE NOT ambiguu), r AS (SELECT *, row_number() OVER (PARTITION BY banca, camp ORDER BY v, serviciu, id) AS rn, count(*) OVER (PARTITION BY banca, camp) AS n FROM m WHERE v <= 12),
x AS (SELECT banca, camp, count(*) FILTER (WHERE v > 12) AS implausible FROM m GROUP BY 1, 2)
SELECT r.banca, r.camp, v AS value, id, coalesce(months, 0) AS months, n, implausible FROM r JOIN x ON r.banca = x.banca AND r.camp = x.camp WHERE rn = (n + 1) // 2""")
def api_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = market.rates(observations(spark, sf_dir), "depozite")
    return found.select("banca", "camp", "value", "id", F.coalesce("months", F.lit(0)).alias("months"), "n", "implausible")


@query(f"""WITH {_OBS}{_RATES}, o AS (SELECT unnest(['1-3', '4-6', '7-12', '>12', 'unknown']) AS option),
c AS (SELECT CASE WHEN months IS NULL THEN 'unknown' WHEN months <= 3 THEN '1-3' WHEN months <= 6 THEN '4-6' WHEN months <= 12 THEN '7-12' ELSE '>12' END AS option, count(*) AS n FROM t GROUP BY 1)
SELECT option, coalesce(n, 0) AS n FROM o LEFT JOIN c USING (option)""")
def api_rate_termene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.term_facets(observations(spark, sf_dir), "depozite")


_CHANGES = """, d AS (SELECT *, valoare_num::DOUBLE AS v FROM obs WHERE NOT (unitate = 'lei' AND valoare_num > 10000) AND NOT (unitate = 'procent' AND valoare_num > 40) AND stare_data <> 'DUBLURA'),
s AS (SELECT *, lag(v) OVER w AS old_value, lag(data_vigoare) OVER w AS old_day FROM d WINDOW w AS (PARTITION BY banca, camp, serviciu, unitate ORDER BY data_vigoare, v, id)),
ch AS (SELECT *, v - old_value AS delta, CASE WHEN old_value <> 0 THEN round(100.0 * (v - old_value) / old_value, 1) END AS percent FROM s WHERE old_value <> v AND old_day <> data_vigoare)"""


@query(f"WITH {_OBS}{_CHANGES} SELECT banca, id, old_value, v AS valoare, round(percent, 1) AS percent FROM ch WHERE camp = 'transfer_credit' AND delta > 0")
def api_istoric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.history_view(market.history(observations(spark, sf_dir)), field="transfer_credit", direction="scumpire")
    return rows.select("banca", "id", "old_value", "valoare", "percent")


@query(f"WITH {_OBS}{_CHANGES} SELECT banca, count(*) AS n, count(*) FILTER (WHERE delta > 0) AS scumpiri, count(*) FILTER (WHERE delta < 0) AS ieftiniri FROM ch GROUP BY 1")
def api_istoric_banci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.history_by_bank(market.history(observations(spark, sf_dir)))


@query(f"WITH {_OBS} SELECT coalesce(stare_data, 'fara datare') AS stare, count(*) AS n FROM obs GROUP BY 1")
def api_istoric_datare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.dating(observations(spark, sf_dir))


_QUEUE = r""", q AS (SELECT *, CASE WHEN unitate = 'lei' AND valoare_num > 10000 THEN 'suma_mare' WHEN unitate = 'procent' AND valoare_num > 40 THEN 'procent_mare' WHEN ambiguu THEN 'ambiguu' WHEN confidence < 0.7 THEN 'incredere_mica' END AS motive
  FROM obs WHERE NOT regexp_matches(trim(citat), '(?i)^[0-9][0-9.,\s]*(lei|euro|eur|usd|ron|%)?$'))"""


@query(f"WITH {_OBS}{_QUEUE} SELECT id, motive FROM q WHERE motive IS NOT NULL")
def api_coada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.review_queue(observations(spark, sf_dir)).select("id", "motive")


@query(f"""WITH {_OBS}{_QUEUE}, g AS (SELECT banca, camp, serviciu, list(DISTINCT valoare_num ORDER BY valoare_num) AS qs, count(*) AS n FROM q WHERE motive IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT banca, camp, serviciu, list(DISTINCT valoare_num ORDER BY valoare_num) AS vs FROM obs GROUP BY 1, 2, 3)
SELECT banca, camp, serviciu, n, array_to_string(vs[1:14], ' ') AS values, len(list_filter(vs, lambda x: list_contains(qs, x)))::INTEGER AS queued FROM g JOIN a USING (banca, camp, serviciu)""")
def agg05_aux07_queue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued values by bank, field and service, with the first fourteen sibling values."""
    groups = market.queue_groups(observations(spark, sf_dir))
    return groups.select("banca", "camp", "serviciu", "n", F.array_join(F.col("values").cast("array<string>"), " ").alias("values"), F.size("queued").alias("queued"))


@query(f"WITH {_OBS}{_QUEUE} SELECT motive, count(*) AS n FROM q WHERE motive IS NOT NULL GROUP BY 1 ORDER BY n DESC, motive LIMIT 5")
def aux09_motives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.commonest_motives(market.review_queue(observations(spark, sf_dir)))


@query(f"""WITH {_OBS}, {_SOURCES}, {_PLACES}, s AS (SELECT banca, count(*) AS sources, count(*) FILTER (WHERE ultima_rulare IS NOT NULL) AS run FROM src GROUP BY 1),
o AS (SELECT banca, count(*) AS observations, count(DISTINCT camp) AS fields FROM obs GROUP BY 1), l AS (SELECT banca, count(*) AS locations FROM loc GROUP BY 1)
SELECT slug AS banca, coalesce(sources, 0) AS sources, coalesce(run, 0) AS run, coalesce(observations, 0) AS observations, coalesce(fields, 0) AS fields, coalesce(locations, 0) AS locations
FROM b LEFT JOIN s ON s.banca = slug LEFT JOIN o ON o.banca = slug LEFT JOIN l ON l.banca = slug WHERE activ""")
def api_acoperire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.coverage(banks(spark, sf_dir), sources(spark, sf_dir), observations(spark, sf_dir), locations(spark, sf_dir))


@query(f"WITH {_BANKS}, {_PLACES} SELECT tip, retea, count(*) AS n, round(avg(rating), 2) AS rating, count(*) FILTER (WHERE lat BETWEEN 43.6 AND 48.3 AND lon BETWEEN 20.2 AND 29.8) AS inside FROM loc GROUP BY 1, 2")
def api_locatii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by kind and network, rated points' mean, points within the country's box."""
    return market.locations_summary(locations(spark, sf_dir))


@query(f"""WITH {_BANKS}, {_REVIEWS} SELECT banca, count(*) AS n, round(avg(stars), 2) AS mean, round(100.0 * count(*) FILTER (WHERE stars >= 4) / count(*), 1) AS good, round(100.0 * count(*) FILTER (WHERE stars <= 2) / count(*), 1) AS bad,
  max(posted) AS newest FROM rev GROUP BY 1""")
def api_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.sentiment(reviews(spark, sf_dir))


@query(f"WITH {_BANKS}, {_PLACES} SELECT banca, count(*) FILTER (WHERE tip = 'sucursala') AS sucursale, count(*) FILTER (WHERE tip = 'atm' AND retea = 'proprie') AS atm, round(avg(rating) FILTER (WHERE tip = 'sucursala'), 2) AS rating_sucursale FROM loc GROUP BY 1")
def api_versus_retea(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.versus_network(locations(spark, sf_dir))


@query(f"WITH {_BANKS}, {_REVIEWS} SELECT banca, count(*) AS review_uri, round(avg(stars), 2) AS medie_text, round(100.0 * count(*) FILTER (WHERE stars <= 2) / count(*), 0) AS pct_negative FROM rev GROUP BY 1")
def api_versus_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.versus_sentiment(reviews(spark, sf_dir))


@query(f"WITH {_OBS}, o AS (SELECT banca, count(DISTINCT camp) AS servicii_cunoscute, count(id) AS valori FROM obs GROUP BY 1) SELECT slug AS banca, coalesce(servicii_cunoscute, 0) AS servicii_cunoscute, coalesce(valori, 0) AS valori FROM b LEFT JOIN o ON banca = slug")
def api_versus_acoperire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.versus_coverage(banks(spark, sf_dir), observations(spark, sf_dir))


@query(f"WITH {_BANKS}, {_APPS}, {_PLACES}, c AS (SELECT banca, count(*) AS capturi FROM loc GROUP BY 1) SELECT app.banca, platforma, versiune, rating, volum, coalesce(capturi, 0) AS capturi FROM app LEFT JOIN c USING (banca)")
def api_versus_mobil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apps with their screenshots; here places stand for the screenshots."""
    return market.versus_mobile(releases(spark, sf_dir), locations(spark, sf_dir))


@query(f"""WITH {_OBS}, {_SOURCES} SELECT 'surse' AS domeniu, count(*) AS randuri, max(ultima_rulare) AS ultima, 'descoperire' AS provenienta FROM src
UNION ALL SELECT 'observatii', count(*), max(data_vigoare)::TIMESTAMP, string_agg(DISTINCT metoda_extractie, ' + ' ORDER BY metoda_extractie) FROM obs UNION ALL SELECT 'banci', count(*), NULL, 'tabela' FROM b""")
def api_stare(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return market.freshness([("surse", sources(spark, sf_dir), "ultima_rulare", "descoperire"), ("observatii", obs, "data_vigoare", F.col("metoda_extractie")), ("banci", banks(spark, sf_dir), None, "tabela")])


@query(f"""WITH {_BANKS}, {_REVIEWS}, {_APPS}, a AS (SELECT banca, max(rating) AS rating_agregat_store FROM app GROUP BY 1)
SELECT banca, storefront, review_uri, rating_mediu_text, rating_agregat_store FROM (SELECT banca, storefront, count(*) AS review_uri, round(avg(stars), 2) AS rating_mediu_text FROM rev GROUP BY 1, 2) LEFT JOIN a USING (banca)""")
def api_mobil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.mobile_reviews(reviews(spark, sf_dir), releases(spark, sf_dir))


@query(f"WITH {_BANKS}, {_REVIEWS} SELECT banca, storefront, stars, left(text, 240) AS text, left(autor_hash, 12) AS autor, posted, id FROM rev ORDER BY posted DESC NULLS LAST, id LIMIT 40")
def api_mobil_recente(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.mobile_recent(reviews(spark, sf_dir))


_ANDROID = """, aa AS (SELECT 'ro.' || s_suppkey AS package, slug AS banca, s_name AS aplicatie, CASE s_suppkey % 2 WHEN 0 THEN 'principal' ELSE 'secundar' END AS rol FROM supplier JOIN b ON s_nationkey = n_nationkey),
av AS (SELECT 'ro.' || l_suppkey AS package, l_linenumber || '.0' AS version_name, count(*) AS nr_trackere, count(DISTINCT l_partkey) AS nr_biblioteci FROM lineitem GROUP BY 1, 2),
nw AS (SELECT package, max(version_name) AS versiune_cea_mai_noua FROM av GROUP BY 1)"""


def _android(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    package = lambda c: F.concat(F.lit("ro."), F.col(c).cast("string")).alias("package")
    line = table(spark, sf_dir, "lineitem").select(package("l_suppkey"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")).alias("version_name"), "l_partkey")
    versions = line.groupBy("package", "version_name").agg(F.count("*").alias("nr_trackere"), F.countDistinct("l_partkey").alias("nr_biblioteci"))
    newest = versions.groupBy("package").agg(F.max("version_name").alias("versiune_cea_mai_noua"))
    apps = _of_bank(spark, sf_dir, table(spark, sf_dir, "supplier"), "s_nationkey").select(package("s_suppkey"), "banca", F.col("s_name").alias("aplicatie"), F.when(F.col("s_suppkey") % 2 == 0, "principal").otherwise("secundar").alias("rol"))
    return apps.join(newest, "package", "left"), versions


@query(f"""WITH {_BANKS}{_ANDROID} SELECT aa.package, banca, aplicatie, rol, nw.versiune_cea_mai_noua, nr_trackere, nr_biblioteci, coalesce(n, 0) AS nr_versiuni FROM aa LEFT JOIN nw ON nw.package = aa.package
LEFT JOIN av ON av.package = aa.package AND av.version_name = nw.versiune_cea_mai_noua LEFT JOIN (SELECT package, count(*) AS n FROM av GROUP BY 1) c ON c.package = aa.package""")
def join03_api_android(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apps joined to the figures of their newest version by package and version."""
    apps, versions = _android(spark, sf_dir)
    return market.android_apps(apps, versions, "germany").select("package", "banca", "aplicatie", "rol", "versiune_cea_mai_noua", "nr_trackere", "nr_biblioteci", "nr_versiuni")


@query(f"""WITH {_BANKS}{_ANDROID}, p AS (SELECT 'ro.' || l_suppkey AS package, l_linenumber || '.0' AS version_name, CASE WHEN p_name LIKE '%widget%' THEN 'obiecte' WHEN p_name LIKE '%small%' OR p_name LIKE '%cold%' THEN 'insusiri' ELSE 'altele' END AS grup
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p.package, grup, count(*) AS n FROM p JOIN nw ON p.package = nw.package AND version_name = versiune_cea_mai_noua GROUP BY 1, 2""")
def d28_permission_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions of each app's newest version by ordered groups; parts' names stand for the permissions."""
    apps, _ = _android(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("permisiune"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.lit("ro."), F.col("l_suppkey").cast("string")).alias("package"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")).alias("version_name"))
    return market.android_groups(line.join(part, F.col("l_partkey") == F.col("p_partkey")), apps, [("obiecte", "widget"), ("insusiri", "small|cold")])


@query("""SELECT p_partkey, p_name, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank FROM part""")
def d28_verdict_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.element_at(F.array(*map(F.lit, (*market.VERDICTS, "necunoscut"))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", market.verdict_rank(verdict).alias("rank"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size > 25 DESC, CASE WHEN p_size % 5 = 0 THEN 'ZZ' ELSE p_brand END, p_name, p_partkey) AS place FROM part ORDER BY place LIMIT 100""")
def api_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred products of the catalogue, in its order."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).alias("produs_prioritar"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("categorie_cod"), F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("denumire"))
    order = Window.orderBy(F.col("produs_prioritar").desc_nulls_last(), F.coalesce("categorie_cod", F.lit("ZZ")), "denumire")
    page = market.product_catalogue(part).limit(100).withColumn("place", F.row_number().over(order))  # of a hundred rows
    return page.select("p_partkey", "place")


@query(f"""WITH {_BANKS}, a AS (SELECT slug AS banca, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 100) + 0.5 END AS pondere FROM orders JOIN customer ON o_custkey = c_custkey JOIN b ON c_nationkey = n_nationkey)
SELECT banca, count(*) FILTER (WHERE pondere >= 50) AS ro, count(*) FILTER (WHERE pondere IS NULL OR pondere < 50) AS altele FROM a GROUP BY 1""")
def aux10_api_reclame_bing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search ads of each bank by whether the home country has the larger part of the impressions; orders stand for the ads."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    home = F.struct(F.lit("Romania").alias("Country"), F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(",5 %")).alias("ImpressionShare"))
    other = F.struct(F.lit("Bulgaria").alias("Country"), F.lit("10%").alias("ImpressionShare"))
    none = F.lit(None).cast("string")
    details = F.struct(none.alias("StartDate"), none.alias("EndDate"), none.alias("TotalImpressionsRange"), F.when(F.col("o_orderkey") % 3 != 0, F.array(other, home)).otherwise(F.array(other)).alias("ImpressionsByCountry"))
    rows = _of_bank(spark, sf_dir, orders, "c_nationkey").select("banca", F.array(F.struct(none.alias("AdvertiserName"), none.alias("Title"), details.alias("AdDetails"))).alias("reclame"))
    return market.search_ads_by_bank(market.search_ads(rows))


@query(f"""WITH {_BANKS}, v AS (SELECT slug AS banca, n_nationkey, event_id AS id, ts::DATE AS publicat_la, event_type = 'click' AS nou FROM events JOIN b ON user_id % 25 = n_nationkey)
SELECT banca, id, publicat_la, nou AND n_nationkey % 3 = 0 AS nou FROM v WHERE n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0""")
def api_youtube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of channels whose snapshot may still be shown; some are past their day, some banks have no channel."""
    e = _of_bank(spark, sf_dir, table(spark, sf_dir, "events").withColumn("__key", F.col("user_id") % 25), "__key")
    n = F.col("__key")
    taken = F.when(n % 5 == 0, "2026-08-01").otherwise("2026-09-10")
    one = F.struct(F.col("event_id").alias("id"), F.to_date("ts").alias("publicat_la"), (F.col("event_type") == "click").alias("nou"))
    snapshot = e.select("banca", taken.alias("data_extragerii"), F.lit(None).cast("string").alias("sterge_la"), F.when(n % 3 == 0, "2026-08-30").alias("nou_fata_de"), F.when(n % 4 != 0, F.col("banca")).alias("canal"), F.array(one).alias("videoclipuri"))
    return market.videos(snapshot, F.lit("2026-09-20").cast("date")).select("banca", "id", "publicat_la", "nou")


_INDEX = "ix AS (SELECT 'robor' AS indice, CASE o_orderkey % 2 WHEN 0 THEN '3M' ELSE '6M' END AS scadenta, o_totalprice AS valoare, o_orderdate::DATE AS valabil_din, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + 40 END AS valabil_pana FROM orders)"


def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.lit("robor").alias("indice"), F.when(F.col("o_orderkey") % 2 == 0, "3M").otherwise("6M").alias("scadenta"), F.col("o_totalprice").alias("valoare"), day.alias("valabil_din"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, 40)).alias("valabil_pana"))


@query(f"WITH {_INDEX} SELECT scadenta, valoare, valabil_din FROM ix WHERE valabil_din <= DATE '1998-06-01' AND (valabil_pana IS NULL OR valabil_pana >= DATE '1998-06-01')")
def aux04_api_indici(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index values in force on a day, open ends too."""
    return market.index_now(_indices(spark, sf_dir), F.lit("1998-06-01").cast("date")).select("scadenta", "valoare", "valabil_din")


@query(f"""WITH {_INDEX} SELECT valabil_din, min(valoare) FILTER (WHERE scadenta = '3M') AS "3M", min(valoare) FILTER (WHERE scadenta = '6M') AS "6M" FROM ix GROUP BY 1""")
def aux03_index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.index_series(_indices(spark, sf_dir), ["3M", "6M"]).drop("indice")


@query(f"""WITH {_BANKS} SELECT slug AS banca, coalesce(min(c_name) FILTER (WHERE c_mktsegment = 'BUILDING'), 'NEGASIT') AS "BUILDING", coalesce(min(c_name) FILTER (WHERE c_mktsegment = 'NONE'), 'NEGASIT') AS "NONE"
FROM customer JOIN b ON c_nationkey = n_nationkey GROUP BY 1""")
def aux06_api_retele(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks by networks: the account, or NEGASIT."""
    rows = _of_bank(spark, sf_dir, table(spark, sf_dir, "customer"), "c_nationkey").select("banca", F.col("c_mktsegment").alias("retea"), F.col("c_name").alias("cont"))
    return market.networks(rows, ["BUILDING", "NONE"])


@query("""WITH r AS (SELECT event_type AS command, 'b' || user_id % 40 AS bank, value AS seconds, event_id % 6 = 0 AND event_type <> 'error' AS ok FROM events),
o AS (SELECT command, bank, median(seconds) AS own FROM r WHERE ok GROUP BY 1, 2), a AS (SELECT command, median(seconds) AS every FROM r WHERE ok GROUP BY 1)
SELECT k.command, k.bank, round(coalesce(own, every, 60.0), 6) AS seconds FROM (SELECT DISTINCT command, bank FROM r) k LEFT JOIN o ON o.command = k.command AND o.bank = k.bank LEFT JOIN a ON a.command = k.command""")
def d29_run_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("command"), F.concat(F.lit("b"), (F.col("user_id") % 40).cast("string")).alias("bank"), F.col("value").alias("seconds"), ((F.col("event_id") % 6 == 0) & (F.col("event_type") != "error")).alias("ok"))
    return market.run_estimate(runs, 60.0).withColumn("seconds", F.round("seconds", 6))


# ---- advertising and campaigns

_ADS = """ad AS (SELECT o_orderkey AS id, 'A' || c_nationkey AS advertiser_id, o_orderdate::DATE AS first_shown, o_orderdate::DATE + (o_orderkey % 60)::INTEGER AS last_shown, o_orderkey % 1000 AS lo,
  CASE WHEN o_orderkey % 9 = 0 THEN 9223372036854775807 ELSE o_orderkey % 1000 + 500 END AS hi, CASE o_orderkey % 4 WHEN 0 THEN 'MAPS:0-1000:;YOUTUBE:4000-5000:' WHEN 1 THEN 'SEARCH:5-9:;MAPS:5-:' WHEN 2 THEN 'MAPS:0-1000:' ELSE '' END AS platforme
  FROM orders JOIN customer ON o_custkey = c_custkey),
adv AS (SELECT 'A' || n_nationkey AS advertiser_id, slug AS banca, CASE n_nationkey % 3 WHEN 0 THEN 'banca' WHEN 1 THEN 'filiala' ELSE 'agentie' END AS rol FROM b),
en AS (SELECT ad.*, banca, CASE id % 4 WHEN 0 THEN 'YOUTUBE' WHEN 1 THEN 'SEARCH+MAPS' WHEN 2 THEN 'sub_1000' ELSE 'fara_date' END AS platform FROM ad JOIN adv USING (advertiser_id) WHERE rol IN ('banca', 'filiala'))"""


def _ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    shown = F.element_at(F.array(*map(F.lit, ("MAPS:0-1000:;YOUTUBE:4000-5000:", "SEARCH:5-9:;MAPS:5-:", "MAPS:0-1000:", ""))), (k % 4 + 1).cast("int"))
    rows = o.select(
        k.alias("id"), F.concat(F.lit("A"), F.col("c_nationkey").cast("string")).alias("advertiser_id"), day.alias("first_shown"), F.date_add(day, (k % 60).cast("int")).alias("last_shown"), (k % 1000).alias("times_shown_lower_bound"),
        F.when(k % 9 == 0, F.lit(ads.OPEN)).otherwise(k % 1000 + 500).alias("times_shown_upper_bound"), shown.alias("platforme"),
    )
    b = banks(spark, sf_dir)
    role = F.element_at(F.array(*map(F.lit, ("banca", "filiala", "agentie"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    who = b.select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("advertiser_id"), F.col("slug").alias("banca"), role.alias("rol"))
    return ads.enrich_ads(rows, who)


@query(f"""WITH {_BANKS}, {_ADS}, last AS (SELECT max(last_shown) AS d FROM en)
SELECT banca, platform, count(*) AS ads, sum(lo)::BIGINT AS low, sum(CASE WHEN hi <> 9223372036854775807 THEN hi ELSE 0 END)::BIGINT AS high, bool_or(hi = 9223372036854775807) AS open, count(*) FILTER (WHERE last_shown >= d - 7) AS active7,
  count(*) FILTER (WHERE last_shown >= d - 30) AS active30, count(*) FILTER (WHERE last_shown >= d - 90) AS active90, count(*) FILTER (WHERE first_shown >= d - 30) AS new30 FROM en, last GROUP BY 1, 2""")
def d25_arr04_reclame_google(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads by bank and main platform: sums of both ends, open ends, activity relative to the last day in the data."""
    return ads.ads_summary(_ads(spark, sf_dir), ["banca", "platform"])


@query(f"WITH {_BANKS}, {_ADS} SELECT id, platform, last_shown - first_shown + 1 AS days FROM en WHERE list_contains(string_split(platform, '+'), 'MAPS') ORDER BY days DESC, id LIMIT 200")
def flt15_ord05_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads on one platform, ordered by a key from a fixed list."""
    rows = ads.on_platform(_ads(spark, sf_dir), "MAPS")
    return summaries.page_of(rows, summaries.order_by("days", {"days": F.col("days"), "low": F.col("low")}, True, F.col("id")), 200).select("id", "platform", "days")


@query(f"""WITH {_BANKS}, {_ADS}, m AS (SELECT month(first_shown) AS month, count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS inc, count(*) FILTER (WHERE id % 2 = 1) AS exc FROM en GROUP BY 1)
SELECT month, n, round(100.0 * inc / n, 1) AS "INCLUDED", round(100.0 * exc / n, 1) AS "EXCLUDED" FROM m""")
def agg21_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ads by month, and the share of each way of targeting."""
    rows = _ads(spark, sf_dir).select(F.month("first_shown").alias("month"), F.when(F.col("id") % 2 == 0, "INCLUDED").otherwise("EXCLUDED").alias("way"))
    return summaries.distribution(rows, "month", "way", ["INCLUDED", "EXCLUDED"])


_EVIDENCE = """ev AS (SELECT o_custkey AS campaign, (1 + o_orderkey % 3)::INTEGER AS rank, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'T' || o_orderkey END AS title, CASE WHEN o_orderkey % 5 > 1 THEN o_orderdate::DATE END AS start,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE + 90 END AS stop, CASE WHEN o_orderkey % 6 = 0 THEN 'B' || o_orderkey END AS benefit, o_orderkey % 7 = 0 AS deduced, o_orderkey % 13 <> 0 AS fetched FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY campaign, rank ORDER BY o_orderkey) AS k FROM ev), e1 AS (SELECT * FROM f WHERE k = 1)"""


@query(f"""WITH {_EVIDENCE}, g AS (SELECT campaign, min_by(title, rank) FILTER (WHERE title IS NOT NULL) AS title, min_by(benefit, rank) FILTER (WHERE benefit IS NOT NULL) AS benefit,
  min_by({{'a': start, 'b': stop, 'd': deduced}}, rank) FILTER (WHERE start IS NOT NULL OR stop IS NOT NULL) AS w, bool_and(fetched) AS ok, count(*) AS pieces FROM e1 GROUP BY 1)
SELECT campaign, title, benefit, pieces, w.a AS start, w.b AS stop, CASE WHEN coalesce(w.d, false) OR (w.a IS NULL) <> (w.b IS NULL) OR NOT ok THEN 'de_verificat' WHEN w.b < DATE '1998-01-01' THEN 'incheiata' WHEN w.a > DATE '1998-01-01' THEN 'viitoare'
  WHEN w.a IS NULL THEN 'nedatata' ELSE 'activa' END AS state FROM g""")
def d19_snk04_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns from their pieces of evidence by precedence; orders of a customer stand for the pieces."""
    from quotelake.operators.upsert import one_of_each

    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    pieces = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("campaign"), (k % 3 + 1).cast("int").alias("rank"), (-k).alias("first"), F.when(k % 4 != 0, F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.when(k % 5 > 1, day).alias("start"),
        F.when(k % 5 > 0, F.date_add(day, 90)).alias("end"), F.when(k % 6 == 0, F.concat(F.lit("B"), k.cast("string"))).alias("benefit"), (k % 7 == 0).alias("deduced"), (k % 13 != 0).alias("fetched"),
    )
    merged = ads.merge_campaign(one_of_each(pieces, ["campaign", "rank"], ["first"]), F.lit("1998-01-01").cast("date"))
    return merged.select("campaign", "title", "benefit", "pieces", "start", F.col("end").alias("stop"), "state")


_SNAP = """c AS (SELECT o_custkey % 40 AS banca, o_orderkey AS campaign, o_orderdate::DATE AS day, CASE o_orderkey % 3 WHEN 0 THEN 'activa' WHEN 1 THEN 'viitoare' ELSE 'incheiata' END AS state, o_orderdate::DATE + (o_orderkey % 900)::INTEGER AS stop FROM orders),
cur AS (SELECT *, state IN ('activa', 'viitoare') AS in_comparison, stop < DATE '1999-06-01' AND state = 'activa' AS ended_today FROM c WHERE day = (SELECT max(day) FROM c x WHERE x.banca = c.banca))"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    state = F.element_at(F.array(*map(F.lit, ("activa", "viitoare", "incheiata"))), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("banca"), k.alias("campaign"), day.alias("data_rulare"), state.alias("state"), F.date_add(day, (k % 900).cast("int")).alias("end"))


@query(f"WITH {_SNAP} SELECT banca, campaign, in_comparison, ended_today FROM cur")
def d20_current_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ads.current_campaigns(_snapshots(spark, sf_dir), F.lit("1999-06-01").cast("date"))
    return found.select("banca", "campaign", "in_comparison", "ended_today")


@query(f"""WITH {_SNAP}, d AS (SELECT l_orderkey AS campaign, '[' || string_agg('{{"url":"p' || lpad(l_partkey::VARCHAR, 8, '0') || '","kind":"k' || l_linenumber || '"}}', ',' ORDER BY 'p' || lpad(l_partkey::VARCHAR, 8, '0'), 'k' || l_linenumber) || ']' AS documents FROM lineitem GROUP BY 1)
SELECT campaign, coalesce(documents, '[]') AS documents FROM cur LEFT JOIN d USING (campaign)""")
def agg07_api_campanii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current campaigns with their documents as a JSON array, ``[]`` where there are none."""
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("campaign"), F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("url"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("kind"))
    return ads.with_documents(ads.current_campaigns(_snapshots(spark, sf_dir), F.lit("1999-06-01").cast("date")), docs).select("campaign", "documents")


@query(f"WITH {_SNAP} SELECT banca, state, count(*) AS n, count(*) FILTER (WHERE in_comparison) AS in_comparison FROM cur GROUP BY 1, 2")
def aux09_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.campaign_tallies(ads.current_campaigns(_snapshots(spark, sf_dir), F.lit("1999-06-01").cast("date")))


@query("""WITH now AS (SELECT user_id % 30 AS banca, event_id AS id, ts::DATE AS published FROM events), ref AS (SELECT user_id % 30 AS banca, event_id AS id FROM events WHERE event_type <> 'click' AND user_id % 30 < 20)
SELECT id, CASE WHEN banca IN (SELECT banca FROM ref) THEN id NOT IN (SELECT id FROM ref) ELSE published > DATE '2024-01-15' END AS is_new FROM now""")
def d27_new_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bank's reference extraction doesn't hold is new; banks without one go by the day."""
    now = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("banca"), F.col("event_id").alias("id"), F.to_date("ts").alias("published"), "event_type")
    reference = now.where("event_type <> 'click' and banca < 20").select("banca", "id")
    return ads.new_labels(now, reference, F.lit("2024-01-15").cast("date")).select("id", "is_new")
