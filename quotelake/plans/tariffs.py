"""Tariff documents over the star-schema tables: every line's wording and every figure in it come from its row, so that SQL knows what must be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelake.operators import catalogue, extract, sections, tariffs
from quotelake.plans.registry import query, table

_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_KEY_LIST = ", ".join(_KEYS)


def _local(value: Column) -> Column:
    """1,234.50 as 1.234,50."""
    return F.translate(F.format_number(value, 2), ",.", ".,")


def _whole(value: Column) -> Column:
    return F.round(value).cast("long").cast("string")


@query(f"""WITH f AS (
  SELECT {_KEY_LIST}, 'comision_procent' AS kind, round(l_discount * 100) + 0.25 AS value, NULL AS currency, NULL AS role, l_returnflag, l_linestatus, l_quantity FROM lineitem
  UNION ALL SELECT {_KEY_LIST}, 'comision_suma', l_linenumber, 'LEI', 'min', l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_returnflag <> 'N'
  UNION ALL SELECT {_KEY_LIST}, 'comision_suma', l_extendedprice, 'EUR', 'max', l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT {_KEY_LIST}, 'comision_suma', round(l_tax * 100), 'LEI', NULL, l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_returnflag = 'N'
)
SELECT {_KEY_LIST}, kind, value::DOUBLE AS value, currency, role, CASE WHEN l_linestatus = 'F' THEN 'lunar' END AS frequency,
  CASE WHEN l_returnflag <> 'A' THEN 'peste ' || l_quantity::BIGINT || '.000 lei' END AS band FROM f""")
def ext03_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with two or three fees each: a percentage bounded below and above, or with a sum beside it, behind a band."""
    percent, low = F.concat(_whole(F.col("l_discount") * 100), F.lit(",25%")), F.concat(F.lit(" min. "), F.col("l_linenumber"), F.lit(" lei"))
    high, beside = F.concat(F.lit(" max. "), _local(F.col("l_extendedprice")), F.lit(" EUR")), F.concat(F.lit("+"), _whole(F.col("l_tax") * 100), F.lit(" RON"))
    band = F.when(F.col("l_returnflag") != "A", F.concat(F.lit(" peste "), _whole(F.col("l_quantity")), F.lit(".000 lei: "))).otherwise(" ")
    flag = F.col("l_returnflag")
    bounds = F.concat(F.when(flag != "N", low).otherwise(""), F.when(flag == "R", high).when(flag == "N", beside).otherwise(""))
    line = F.concat(F.lit("Transfer"), band, percent, bounds, F.when(F.col("l_linestatus") == "F", "/lună").otherwise(""))
    return extract.extract_fees(table(spark, sf_dir, "lineitem").select(*_KEYS, line.alias("line"))).select(*_KEYS, "kind", "value", "currency", "role", "frequency", "band")


@query(f"""SELECT {_KEY_LIST}, CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'conditie' WHEN 'RO' THEN 'conditie' WHEN 'NF' THEN CASE WHEN l_tax > 0 THEN 'conditie' END WHEN 'NO' THEN 'conditie'
  WHEN 'AF' THEN CASE WHEN l_discount >= 0.05 THEN 'conditie' END END AS role FROM lineitem""")
def ext04_condition_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures whose role hangs on the words before and after them, on the label above, on their being zero, or on the label's own band."""
    price, tax, off = _local(F.col("l_extendedprice")), _whole(F.col("l_tax") * 100), _whole(F.col("l_discount") * 100)
    form = F.concat("l_returnflag", "l_linestatus")
    cases = {
        "RF": (F.concat(price, F.lit(" LEI")), F.lit("Limită zilnică"), F.col("l_extendedprice")),
        "RO": (F.concat(F.lit("există o încasare de minimum "), price, F.lit(" LEI")), F.lit("Administrare cont"), F.col("l_extendedprice")),
        "NF": (F.concat(tax, F.lit("% reducere față de plățile standard")), F.lit("Plăți"), F.round(F.col("l_tax") * 100)),
        "NO": (F.concat(price, F.lit(" RON")), F.concat(F.lit("Ordin de plată – sume ≥ "), price, F.lit(" RON / amounts ≥")), F.col("l_extendedprice")),
        "AF": (F.concat(off, F.when(F.col("l_discount") >= 0.05, "% dacă soldul e mai mic decât cerut").otherwise("% dar nu mai puțin de 10 lei, mai mult decât standard")), F.lit("Transfer"), F.round(F.col("l_discount") * 100)),
    }
    pick = lambda i, otherwise: F.coalesce(*(F.when(form == k, v[i]) for k, v in cases.items()), otherwise)
    words, label, value = pick(0, F.concat(F.lit("0,1% min. "), tax, F.lit(" EUR"))), pick(1, F.lit("Transfer")), pick(2, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, extract.condition_role(words, label, value).alias("role"))


def _guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guide for each customer: a chapter for each order in order of time, in capitals or not, and a line, title or heading for each of its items."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    numbered = orders.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))  # a customer has some tens of orders
    of_order = table(spark, sf_dir, "lineitem").repartition("l_orderkey")  # for both the grouping and the join
    item = of_order.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")).alias("i"))
    chapter = F.concat(F.col("n"), F.lit(". "), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("CAPITOLUL "), F.upper("o_orderpriority"))).otherwise(F.concat(F.lit("Capitolul "), F.lower("o_orderpriority"))))
    heads = numbered.select("o_custkey", (F.col("n") * 100).alias("at"), F.lit("title").alias("kind"), chapter.alias("line"))
    number, part, flag = F.col("l_linenumber"), F.col("i.l_partkey"), F.concat("i.l_returnflag", "i.l_linestatus")
    kind = F.when(flag.isin("RF", "NF"), "title").when(flag == "AO", "heading").when(flag == "RO", "text").otherwise("row")
    line = (
        F.when(flag == "RF", F.concat(F.lit("1. Servicii "), part)).when(flag == "NF", F.concat("n", F.lit("."), number, F.lit(" Carduri "), part)).when(flag == "AO", F.concat(F.lit("Scrisori de grup"), part % 3))
        .when(flag == "RO", F.lit("notă")).when(flag == "AF", F.concat("n", F.lit("."), number, F.lit(" Emitere și livrare card "), part, F.lit(" lei"))).otherwise(F.concat(F.lit("- "), part, F.lit(" lei")))
    )
    lines = numbered.join(item, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", (F.col("n") * 100 + number).alias("at"), kind.alias("kind"), line.alias("line"))
    return heads.unionByName(lines)


_GUIDE = """orders_n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
items AS (SELECT l_orderkey, l_linenumber, min({'p': l_partkey, 's': l_suppkey, 'f': l_returnflag, 'l': l_linestatus}) AS i FROM lineitem GROUP BY ALL),
guide AS (
  SELECT o_custkey, n * 100 AS pos, 'title' AS kind, o_orderstatus = 'F' AS capitals, [n] AS no, CASE WHEN o_orderstatus = 'F' THEN 'CAPITOLUL ' || upper(o_orderpriority) ELSE 'Capitolul ' || lower(o_orderpriority) END AS words FROM orders_n
  UNION ALL
  SELECT o_custkey, n * 100 + l_linenumber, CASE WHEN i.f || i.l IN ('RF', 'NF') THEN 'title' WHEN i.f || i.l = 'AO' THEN 'heading' WHEN i.f || i.l = 'RO' THEN 'text' ELSE 'row' END, FALSE,
    CASE i.f || i.l WHEN 'RF' THEN [1] WHEN 'NF' THEN [n, l_linenumber] WHEN 'AF' THEN [n, l_linenumber] END,
    CASE i.f || i.l WHEN 'RF' THEN 'Servicii ' || i.p WHEN 'NF' THEN 'Carduri ' || i.p WHEN 'AO' THEN 'Scrisori de grup' || i.p % 3 WHEN 'AF' THEN 'Emitere și livrare card ' || i.p || ' lei' ELSE 'notă' END
  FROM orders_n JOIN items ON l_orderkey = o_orderkey
),
leveled AS (SELECT *, CASE WHEN kind = 'title' THEN 10 * len(no) WHEN kind = 'heading' THEN 990 END AS level, CASE WHEN kind = 'title' AND capitals THEN 5 WHEN kind = 'title' THEN 10 * len(no) END AS cut,
  {'pos': pos, 'words': words, 'no': no, 'capitals': capitals} AS own FROM guide),
before AS (SELECT *, max(own) FILTER (level = 10) OVER w AS t10, max(own) FILTER (level = 20) OVER w AS t20, max(own) FILTER (level = 990) OVER w AS t990,
  max(pos) FILTER (cut <= 10) OVER w AS c10, max(pos) FILTER (cut <= 20) OVER w AS c20, max(pos) FILTER (cut <= 990) OVER w AS c990, max(pos) FILTER (cut <= 5) OVER w AS c5
  FROM leveled WINDOW w AS (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
acted AS (SELECT *, (kind = 'row' OR (kind = 'title' AND NOT capitals)) AND no = [1] AND coalesce(t10.pos >= coalesce(c10, -1), FALSE) AND t10.capitals AS promoted,
  kind = 'row' AND no IS NOT NULL AND coalesce(t20.pos >= coalesce(c20, -1), FALSE) AND (t20.no[1] < no[1] OR (t20.no[1] = no[1] AND t20.no[2] < no[2])) AS closes,
  kind = 'row' AND no IS NOT NULL AND coalesce(t990.pos >= coalesce(c990, -1), FALSE) AS ends FROM before),
state AS (SELECT *, max(CASE WHEN promoted THEN {'pos': pos, 'words': t10.words} END) OVER w AS chapter, max(pos) FILTER (promoted) OVER w AS moved, max(pos) FILTER (closes) OVER w AS shut, max(pos) FILTER (ends) OVER w AS ended,
  max(own) FILTER (level = 10) OVER w AS n10, max(own) FILTER (level = 20) OVER w AS n20, max(own) FILTER (level = 990) OVER w AS n990,
  max(pos) FILTER (cut <= 10) OVER w AS d10, max(pos) FILTER (cut <= 20) OVER w AS d20, max(pos) FILTER (cut <= 990) OVER w AS d990, max(pos) FILTER (cut <= 5) OVER w AS d5
  FROM acted WINDOW w AS (PARTITION BY o_custkey ORDER BY pos))"""


@query(f"""WITH {_GUIDE}
SELECT o_custkey, pos::BIGINT AS "at", nullif(concat_ws(' > ', CASE WHEN chapter.pos >= coalesce(d5, -1) THEN chapter.words END, CASE WHEN n10.pos >= greatest(-1, d10, moved) THEN n10.words END,
  CASE WHEN n20.pos >= greatest(-1, d20, shut) THEN n20.words END, CASE WHEN n990.pos >= greatest(-1, d990, shut, ended) THEN n990.words END), '') AS section FROM state""")
def ext08_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles above each line of each customer's guide."""
    found = sections.section_paths(_guide(spark, sf_dir), "o_custkey", "at", segment=512)
    return found.select("o_custkey", F.col("at").cast("long").alias("at"), "section")


_CATEGORY = {"ECONOMY": "DEPOZITE", "STANDARD": "CREDIT_IPOTECAR", "PROMO": "CONT_CURENT"}


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    category = F.coalesce(*(F.when(F.col("p_type") == k, v) for k, v in _CATEGORY.items()), F.lit("CARDURI"))
    size, brand = F.col("p_size").cast("string"), F.regexp_extract("p_brand", r"(\d+)", 1)
    words = F.concat(
        F.lit("Abonament "), size, F.lit(" lei/lună pentru "), F.col("p_name"), F.lit(". Dobândă: ~"), brand, F.lit(",25% p.a. la "), size, F.lit("-60 luni, "), size, F.lit(",5% nelimitat; avans "), brand,
        F.lit("%, max. "), _local(F.col("p_retailprice")), F.lit(" lei, cu plăți gratuite"),
    )
    return part.select("p_partkey", words.alias("words"), F.col("p_name").alias("name"), category.alias("category"))


_CATALOGUE = "p AS (SELECT *, CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATEGORY.items()) + " ELSE 'CARDURI' END AS category, regexp_extract(p_brand, '([0-9]+)', 1) AS brand FROM part)"


@query(f"""WITH {_CATALOGUE}
SELECT p_partkey, 'administrare_cont' AS concept, p_size::DOUBLE AS value, 'lunar' AS term, NULL AS detail FROM p WHERE category = 'CONT_CURENT'
UNION ALL SELECT p_partkey, 'nominala', brand::DOUBLE + 0.25, p_size || '-60 luni', 'aproximativ' FROM p WHERE category IN ('DEPOZITE', 'CREDIT_IPOTECAR')
UNION ALL SELECT p_partkey, 'nominala', p_size + 0.5, 'nelimitat', NULL FROM p WHERE category IN ('DEPOZITE', 'CREDIT_IPOTECAR')""")
def ext19_catalogue_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions and interest rates with their terms out of the catalogue's sentences."""
    return catalogue.catalogue_values(_catalogue(spark, sf_dir)).where("kind = 'value'").select("p_partkey", "concept", "value", "term", "detail")


@query(f"""WITH {_CATALOGUE}
SELECT p_partkey, 'abonament la alt produs: ' || category AS reason, 1::BIGINT AS n FROM p WHERE category <> 'CONT_CURENT'
UNION ALL SELECT p_partkey, 'dobândă la sold', 1 FROM p WHERE category NOT IN ('DEPOZITE', 'CREDIT_IPOTECAR')
UNION ALL SELECT p_partkey, 'cifră fără serviciu numit', 1 FROM p WHERE category NOT IN ('DEPOZITE', 'CREDIT_IPOTECAR')
UNION ALL SELECT p_partkey, 'avans minim, nu dobândă', 2 FROM p
UNION ALL SELECT p_partkey, 'gratuitate fără sumă scrisă', 1 FROM p""")
def ext19_catalogue_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the same sentences that no rule reads, counted by reason. A limit within 45 characters of an advance counts as the advance's."""
    return catalogue.catalogue_values(_catalogue(spark, sf_dir)).where("kind = 'unread'").groupBy("p_partkey", "reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 0::BIGINT AS lost, TRUE AS whole FROM part")
def ext19_catalogue_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, unread figures and the words between them put together are the text, and no digit stands outside a figure."""
    rows = catalogue.catalogue_values(_catalogue(spark, sf_dir))
    digits = F.sum(F.when(F.col("kind") == "text", F.regexp_count("fragment", F.lit(r"\d"))).otherwise(0)).cast("long")
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "fragment"))), lambda p: p["fragment"]), "")
    return rows.groupBy("p_partkey").agg(digits.alias("lost"), (pieces == F.min("words")).alias("whole"))


@query(f"""SELECT {_KEY_LIST}, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'taxa_stat' WHEN l_returnflag = 'A' THEN 'dobanda' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'limita' WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 'limita'
  WHEN l_returnflag = 'R' THEN 'comision' WHEN l_linestatus = 'F' THEN 'curs' ELSE 'comision' END AS kind FROM lineitem""")
def ext05_figure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each figure is about, by its section, service, line, own cell and column: prices told beside a limit or ceiling stay prices."""
    form, price = F.concat("l_returnflag", "l_linestatus"), F.concat(_local(F.col("l_extendedprice")), F.lit(" LEI"))
    section = F.when(form == "RF", "LIMITELE BĂNCII > Carduri").otherwise("Carduri")
    service = F.when(form == "AO", "neautorizat").when((form == "RO") & (F.col("l_quantity") > 25), "Limită zilnică").when(form == "RO", "retrageri sub plafonul stabilit").when(form == "NF", "Marjă la curs de schimb").otherwise("Administrare")
    cell = F.when(form == "AO", F.concat(_whole(F.col("l_quantity")), F.lit("% p.a."))).otherwise(price)
    column = F.when(form == "AF", "Taxa către bugetul de stat").otherwise("Tarif")
    return table(spark, sf_dir, "lineitem").select(*_KEYS, extract.figure_kind(section, service, cell, cell, column).alias("kind"))


@query(f"""WITH {_GUIDE},
rows AS (SELECT o_custkey, pos, CASE WHEN no IS NOT NULL THEN 'Emitere și livrare card' ELSE '-' END AS service FROM guide WHERE kind = 'row'),
parts AS (SELECT o_custkey, n * 100 + l_linenumber AS pos, i.p AS value FROM orders_n JOIN items ON l_orderkey = o_orderkey)
SELECT o_custkey, pos::BIGINT AS "at", service, value::DOUBLE AS value, 'LEI' AS currency, 'comision' AS category, CASE WHEN service <> '-' THEN 'emitere_card' END AS own_concept FROM rows JOIN parts USING (o_custkey, pos)""")
def ext03_ext08_tariff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priced line of each customer's guide with its service, figure, category and concept; what a fragment takes from its section isn't compared."""
    rows = tariffs.tariff_rows(_guide(spark, sf_dir), "o_custkey", "at")
    own = F.when(F.col("service") != "-", F.col("concept"))
    return rows.select("o_custkey", F.col("at").cast("long").alias("at"), "service", "value", "currency", "category", own.alias("own_concept"))
