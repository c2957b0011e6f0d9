"""Relational operators on the star-schema tables: joins, aggregates, windows, order, sets, quality and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.functions import arrays, dates, numbers, rules
from quotelake.operators import changes, joins, quality, representative, summaries, upsert
from quotelake.plans.registry import query, table

TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with their supplier's nation: each a price a seller quotes."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, "s_nationkey")


@query("""
WITH o AS (SELECT l.*, n_name FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY n_name, l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn,
  count(*) OVER (PARTITION BY n_name, l_returnflag) AS n, min(l_extendedprice) OVER (PARTITION BY n_name, l_returnflag) AS low,
  max(l_extendedprice) OVER (PARTITION BY n_name, l_returnflag) AS high FROM o WHERE l_extendedprice <= 90000),
x AS (SELECT n_name, l_returnflag, count(*) FILTER (WHERE l_extendedprice > 90000) AS implausible FROM o GROUP BY 1, 2)
SELECT r.n_name, r.l_returnflag, l_extendedprice AS value, l_orderkey, l_linenumber, n, low, high, implausible
FROM r JOIN x ON r.n_name = x.n_name AND r.l_returnflag = x.l_returnflag WHERE rn = (n + 1) // 2
""")
def win02_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representative price of each nation and return flag among plausible ones, with what was left out."""
    out = representative.matrix(offers(spark, sf_dir), "n_name", "l_returnflag", "l_extendedprice", TIES, cap=90000, keep=["l_orderkey", "l_linenumber"])
    return out.drop("mean")


@query("""
WITH o AS (SELECT n_name, l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY n_name, l_returnflag ORDER BY l_extendedprice) AS rn,
  count(*) OVER (PARTITION BY n_name, l_returnflag) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name, max(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS "A", max(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS "N",
  max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS "R" FROM o WHERE rn = (n + 1) // 2 GROUP BY n_name
""")
def agg12_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = representative.representative_rows(offers(spark, sf_dir), ["n_name", "l_returnflag"], "l_extendedprice", TIES)
    return representative.wide(cells, "n_name", "l_returnflag", "l_extendedprice", ["A", "N", "R"])


@query("""
WITH p AS (SELECT l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS day, floor(l_extendedprice * 100 / l_quantity) / 100 AS price, l_orderkey, l_linenumber FROM lineitem),
s AS (SELECT *, lag(price) OVER w AS old_value, lag(day) OVER w AS old_day FROM p WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY day, price, l_orderkey, l_linenumber))
SELECT l_partkey, l_suppkey, day, price, old_value, old_day, round(price - old_value, 2) AS delta, round(100.0 * (price - old_value) / old_value, 1) AS percent
FROM s WHERE old_value <> price AND old_day <> day
""")
def win01_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    prices = line.select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"), (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"), "l_orderkey", "l_linenumber")
    found = changes.price_changes(prices, ["l_partkey", "l_suppkey"], "day", "price", ["l_orderkey", "l_linenumber"])
    return found.drop("l_orderkey", "l_linenumber").withColumn("delta", F.round("delta", 2))


@query("""
WITH p AS (SELECT l_partkey % 50 AS shelf, l_suppkey, CAST(l_shipdate AS DATE) AS day, floor(l_extendedprice * 100 / l_quantity) / 100 AS price FROM lineitem),
s AS (SELECT *, lag(price) OVER w AS old_value, lag(day) OVER w AS old_day FROM p WINDOW w AS (PARTITION BY shelf, l_suppkey ORDER BY day, price))
SELECT shelf, count(*) FILTER (WHERE price > old_value) AS up, count(*) FILTER (WHERE price < old_value) AS down, max(abs(round(100.0 * (price - old_value) / old_value, 1))) AS largest
FROM s WHERE old_value <> price AND old_day <> day GROUP BY shelf
""")
def aux08_change_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    prices = line.select((F.col("l_partkey") % 50).alias("shelf"), "l_suppkey", F.col("l_shipdate").cast("date").alias("day"), (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"))
    found = changes.price_changes(prices, ["shelf", "l_suppkey"], "day", "price")
    return found.groupBy("shelf").agg(F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"), F.max(F.abs("percent")).alias("largest"))


@query("""
SELECT doc_id, fp, occurrences FROM (
  SELECT doc_id, left(sha256(lower(trim(text))), 16) AS fp, n_chars,
    count(*) OVER (PARTITION BY left(sha256(lower(trim(text))), 16)) AS occurrences,
    row_number() OVER (PARTITION BY left(sha256(lower(trim(text))), 16) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1
""")
def d07_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.left(F.sha2(F.lower(F.trim("text")), 256), F.lit(16)).alias("fp"))
    return quality.deduplicate(docs, ["fp"], [F.col("n_chars")], "doc_id").select("doc_id", "fp", "occurrences")


@query("""
WITH g AS (SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS v, count(DISTINCT month(o_orderdate)) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderkey, coalesce(v >= 2 AND s < v, false) AS ambiguous, CASE WHEN v >= 2 AND s < v THEN 'no_sign' END AS reason FROM orders JOIN g USING (o_custkey, o_orderpriority)
""")
def d08_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("sign", F.month("o_orderdate"))
    return quality.mark_ambiguous(orders, ["o_custkey", "o_orderpriority"], "o_orderstatus", ["sign"]).select("o_orderkey", "ambiguous", "reason")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, c_mktsegment, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT *, max(day) OVER (PARTITION BY c_mktsegment, o_custkey) AS newest, max(day) OVER (PARTITION BY c_mktsegment) AS lead_day FROM o)
SELECT o_orderkey, CASE WHEN day < newest THEN 'ISTORIC' WHEN lead_day - newest > 365 THEN 'ISTORIC' ELSE 'IN_VIGOARE' END AS version_state FROM w
""")
def d10_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("owner", F.lit(1))
    return quality.mark_versions(rows, "owner", "c_mktsegment", "o_custkey", "day").select("o_orderkey", "version_state")


@query("""
WITH d AS (SELECT doc_id, source || '-' || doc_id AS name, sha256(text) AS h FROM documents),
b AS (SELECT h, max((length(name), name)) AS best FROM d GROUP BY h)
SELECT doc_id, CASE WHEN best[2] <> name THEN best[2] END AS copy_of FROM d JOIN b USING (h)
""")
def win07_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "doc_id").alias("name"), F.sha2("text", 256).alias("h"))
    return quality.mark_copies(docs, "h", "name").select("doc_id", "copy_of")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
  CASE WHEN l_extendedprice > 80000 THEN 'price' WHEN l_discount >= 0.1 THEN 'discount' WHEN l_tax > 0.07 THEN 'tax' END AS motive
FROM lineitem WHERE l_extendedprice > 80000 OR l_discount >= 0.1 OR l_tax > 0.07
""")
def d14_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("price", F.col("l_extendedprice") > 80000), ("discount", F.col("l_discount") >= 0.1), ("tax", F.col("l_tax") > 0.07)]
    return quality.queue(table(spark, sf_dir, "lineitem"), checks).select(*TIES, "motive")


@query("""
SELECT count(*) FILTER (WHERE l_quantity > 0 AND l_discount BETWEEN 0 AND 0.08) AS valid, count(*) FILTER (WHERE l_quantity > 0 AND NOT l_discount BETWEEN 0 AND 0.08) AS discount FROM lineitem
""")
def d09_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = quality.invalid_rows(table(spark, sf_dir, "lineitem"), [("quantity", F.col("l_quantity") > 0), ("discount", F.col("l_discount").between(0, 0.08))])
    return good.agg(F.count("*").alias("valid")).crossJoin(bad.agg(F.count_if(F.col("reject_reason") == "discount").alias("discount")))


_SEGMENTS = {"pf": ["AUTOMOBILE", "BUILDING"], "pj": ["FURNITURE"], "": ["HOUSEHOLD", "MACHINERY"]}
_COVER_SQL = """
WITH o AS (SELECT o_orderkey, c_nationkey, o_orderpriority, o_orderstatus,
  CASE WHEN o_orderstatus = 'F' THEN 'procent' ELSE 'lei' END AS unit,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'pf' WHEN c_mktsegment = 'FURNITURE' THEN 'pj' END AS seg, o_custkey % 7 AS cat, o_custkey % 10 = 0 AS auth
  FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT c_nationkey, o_orderpriority, unit, cat, bool_or(coalesce(seg = 'pf', false)) AS pf, bool_or(coalesce(seg = 'pj', false)) AS pj FROM o WHERE auth GROUP BY ALL),
hidden AS (SELECT o_orderkey FROM o WHERE NOT auth AND EXISTS (SELECT 1 FROM a WHERE a.c_nationkey = o.c_nationkey AND a.o_orderpriority = o.o_orderpriority AND a.unit = o.unit
  AND (o.unit <> 'procent' OR a.cat = o.cat) AND CASE WHEN seg = 'pf' THEN pf WHEN seg = 'pj' THEN pj ELSE pf AND pj END))
"""


def _with_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    segment = F.when(F.col("c_mktsegment").isin(_SEGMENTS["pf"]), F.array(F.lit("pf"))).when(F.col("c_mktsegment").isin(_SEGMENTS["pj"]), F.array(F.lit("pj"))).otherwise(F.array().cast("array<string>"))
    unit = F.when(F.col("o_orderstatus") == "F", "procent").otherwise("lei")
    rows = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.withColumns({"segments": segment, "unit": unit, "cat": F.col("o_custkey") % 7, "authority": F.col("o_custkey") % 10 == 0})


@query(_COVER_SQL + "SELECT o_orderkey FROM hidden")
def d16_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_segments(spark, sf_dir)
    return quality.replaced_by_authority(rows.where("not authority"), rows.where("authority"), ["c_nationkey", "o_orderpriority"], "unit", ["cat"], "segments").select("o_orderkey")


@query(_COVER_SQL + "SELECT o_orderkey, unit FROM o WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM hidden)")
def d15_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_segments(spark, sf_dir)
    hidden = quality.replaced_by_authority(rows.where("not authority"), rows.where("authority"), ["c_nationkey", "o_orderpriority"], "unit", ["cat"], "segments")
    return quality.current(rows, "o_orderkey", "o_orderstatus", [hidden], past=["P"]).select("o_orderkey", "unit")


_LINES_SQL = """
WITH o AS (SELECT o_orderpriority, c_mktsegment, n_name, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
own AS (SELECT o_orderpriority, c_mktsegment, n_name, median(v) AS m, coalesce(max(v) FILTER (WHERE v <> 0) / min(v) FILTER (WHERE v <> 0), 1) AS w FROM o GROUP BY ALL),
lines AS (SELECT o_orderpriority, c_mktsegment, count(*) AS sellers, median(m) AS md, max(m) / min(m) AS b, max(w) AS w FROM own GROUP BY ALL)
"""


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus", "o_orderdate")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


@query(_LINES_SQL + "SELECT o_orderpriority, c_mktsegment, sellers, round(md, 4) AS median, round(b, 6) AS between_, round(w, 6) AS within_, b <= 5 AND w <= 5 AS trusted FROM lines WHERE sellers >= 3")
def d23_comparable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = representative.comparable_lines(_prices(spark, sf_dir), ["o_orderpriority", "c_mktsegment"], "n_name", "o_totalprice")
    return lines.select("o_orderpriority", "c_mktsegment", "sellers", F.round("median", 4).alias("median"), F.round("between", 6).alias("between_"), F.round("within", 6).alias("within_"), "trusted")


@query("""
WITH v AS (SELECT o_orderpriority, round(l_discount, 2) AS d, count(DISTINCT l_suppkey) AS sellers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sellers DESC, d) AS rn FROM v)
SELECT o_orderpriority, d, sellers FROM r WHERE rn = 1 AND sellers >= 3
""")
def agg16_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round("l_discount", 2).alias("d")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return representative.consensus(rows, ["o_orderpriority"], "l_suppkey", "d")


@query("""
WITH m AS (SELECT o_orderpriority, n_name, median(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
a AS (SELECT o_orderpriority, max(v) FILTER (WHERE n_name = 'FRANCE' OR n_name = (SELECT min(n_name) FROM nation)) AS mine,
  min(v) FILTER (WHERE n_name <> (SELECT min(n_name) FROM nation)) AS low, max(v) FILTER (WHERE n_name <> (SELECT min(n_name) FROM nation)) AS high,
  count(v) FILTER (WHERE n_name <> (SELECT min(n_name) FROM nation)) AS others FROM m WHERE true GROUP BY 1)
SELECT o_orderpriority, round(mine, 4) AS mine, round(low, 4) AS low, round(high, 4) AS high, others,
  CASE WHEN mine IS NULL THEN 'none' WHEN others = 0 THEN 'alone' WHEN mine <= low THEN 'wins' WHEN mine >= high THEN 'loses' ELSE 'middle' END AS verdict FROM a
""".replace("n_name = 'FRANCE' OR ", ""))
def d26_versus(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = representative.medians(_prices(spark, sf_dir), ["o_orderpriority", "n_name"], "o_totalprice")
    reference = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    found = representative.versus(medians, ["o_orderpriority"], "n_name", "median", reference)
    return found.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in ("mine", "low", "high")), "others", "verdict")


@query("""
SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def win03_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return quality.latest_of(events, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(e.ts AS DATE)) FROM events e WHERE e.user_id = events.user_id)")
def win04_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    last = events.groupBy("user_id").agg(F.max("day").alias("day"))
    return events.join(last, ["user_id", "day"], "left_semi").select("event_id", "user_id")


@query("""
WITH all_options AS (SELECT DISTINCT event_type AS option FROM events UNION SELECT 'refund' UNION SELECT 'unknown')
SELECT option, coalesce(n, 0) AS n FROM all_options LEFT JOIN (SELECT event_type AS option, count(*) AS n FROM events WHERE value > 50 GROUP BY 1) USING (option)
""")
def agg10_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    options = events.select("event_type").distinct().unionByName(spark.createDataFrame([("refund",)], "event_type string"))
    return summaries.facets(events.where("value > 50"), options, "event_type")


@query("SELECT item, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS item FROM part) GROUP BY item")
def arr01_item_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.item_facets(table(spark, sf_dir, "part"), F.split("p_name", " "))


@query("""
WITH q AS (SELECT l_suppkey, floor(l_quantity / 10)::BIGINT * 10 AS low, CASE WHEN l_quantity >= 40 THEN 9223372036854775807 ELSE (floor(l_quantity / 10)::BIGINT + 1) * 10 END AS high FROM lineitem)
SELECT l_suppkey, sum(low)::BIGINT AS low, sum(CASE WHEN high <> 9223372036854775807 THEN high ELSE 0 END)::BIGINT AS high, bool_or(high = 9223372036854775807) AS open FROM q GROUP BY 1
""")
def agg20_open_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    tens = F.floor(F.col("l_quantity") / 10).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (tens * 10).alias("low"), F.when(F.col("l_quantity") >= 40, F.lit(2**63 - 1)).otherwise((tens + 1) * 10).alias("high"))
    return summaries.open_sum(rows, ["l_suppkey"], "low", "high")


@query("""
SELECT coalesce(c_mktsegment, 'TOTAL') AS c_mktsegment, count(*) AS n, round(100.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*), 1) AS positive,
  round(100.0 * count(*) FILTER (WHERE c_nationkey < 10) / count(*), 1) AS near FROM customer GROUP BY ROLLUP (c_mktsegment)
""")
def agg24_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.scorecard(table(spark, sf_dir, "customer"), "c_mktsegment", {"positive": F.col("c_acctbal") > 0, "near": F.col("c_nationkey") < 10})


@query("""
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS rank FROM c)
SELECT p_type, n, rank, sum(n) OVER (ORDER BY rank)::BIGINT AS running, round(100.0 * sum(n) OVER (ORDER BY rank) / (SELECT count(*) FROM part), 2) AS share FROM t WHERE rank <= 10
""")
def win08_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.coverage(table(spark, sf_dir, "part"), ["p_type"], 10)


@query("SELECT l_suppkey, round(l_tax, 2) AS tax, count(DISTINCT l_partkey) AS items FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 3")
def agg18_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.repeated_across(table(spark, sf_dir, "lineitem").withColumn("tax", F.round("l_tax", 2)), ["l_suppkey", "tax"], "l_partkey", 3)


_SERIES_SQL = """
WITH s AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS q, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1),
i AS (SELECT q, v, (q + INTERVAL 6 MONTH)::DATE AS valid_from, (q + INTERVAL 9 MONTH - INTERVAL 1 DAY)::DATE AS valid_to FROM s)
"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarterly index and the days on which it applies: the quarter two after its own."""
    q = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    s = table(spark, sf_dir, "orders").groupBy(q.alias("q")).agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    label = F.concat(F.year("q").cast("string"), F.lit("T"), F.quarter("q").cast("string"))
    first, last = dates.quarter_interval(label)
    return s.select("q", "v", first.alias("valid_from"), last.alias("valid_to"))


@query(_SERIES_SQL + """SELECT o_orderkey, v FROM orders JOIN i ON CAST(o_orderdate AS DATE) BETWEEN valid_from AND valid_to""")
def join16_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return joins.in_interval(orders, "day", _index(spark, sf_dir), "valid_from", "valid_to").select("o_orderkey", "v")


@query(_SERIES_SQL + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, v FROM lineitem ASOF LEFT JOIN i ON CAST(l_shipdate AS DATE) >= valid_from""")
def join17_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(*TIES, F.col("l_shipdate").cast("date").alias("day"))
    return joins.as_of(line, "day", _index(spark, sf_dir), "valid_from", "v").drop("day")


@query(_SERIES_SQL + """SELECT a.q, b.q AS next_q FROM i a JOIN i b ON a.valid_from = b.valid_from AND a.valid_to = b.valid_to""")
def join18_same_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _index(spark, sf_dir).select("q", "valid_from", "valid_to")
    return a.join(a.withColumnRenamed("q", "next_q"), ["valid_from", "valid_to"]).select("q", "next_q")


@query("""
SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 25 GROUP BY c_custkey
""")
def join19_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    found = joins.within_band(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", suppliers, "s_acctbal", 25.0, "s_suppkey")
    return found.select("c_custkey", F.col("s_s_suppkey").alias("s_suppkey"))


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT a.o_orderkey, b.o_orderkey AS r_o_orderkey FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.rn = b.rn
""")
def join15_greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    found = changes.paired(orders.where(F.col("o_orderdate") < split), orders.where(F.col("o_orderdate") >= split), ["o_custkey"], ["o_totalprice", "o_orderkey"])
    return found.select("o_orderkey", "r_o_orderkey")


@query("""
WITH a AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
b AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS old, b.v AS new,
  CASE WHEN a.v IS NULL THEN 'NOU' WHEN b.v IS NULL THEN 'LIPSA' WHEN a.v = b.v THEN 'NESCHIMBAT' ELSE 'SCHIMBAT' END AS state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
""")
def join14_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    a = orders.where(F.col("o_orderdate") < at("1998-01-01")).groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    b = orders.where(F.col("o_orderdate") >= at("1997-06-01")).groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return changes.key_union(a, b, ["o_custkey"], "v")


@query("""
WITH r(label, pattern, o) AS (VALUES ('green', 'green|lime', 1), ('red', 'red|rose', 2), ('metal', 'steel|BRASS|brass', 3))
SELECT p_partkey, (SELECT min_by(label, o) FROM r WHERE regexp_matches(p_name || ' ' || p_type, pattern)) AS label FROM part
""")
def join09_first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("words"))
    r = spark.createDataFrame([("green", "green|lime", 1), ("red", "red|rose", 2), ("metal", "steel|BRASS|brass", 3)], "label string, pattern string, o int")
    return joins.first_rule(parts, "words", r, "pattern", "label", "o").select("p_partkey", "label")


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^STANDARD') THEN 'standard' WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'hard' ELSE 'other' END AS label FROM part
""")
def join22_rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rules.first_match(F.col("p_type"), [("standard", "^STANDARD"), ("hard", "STEEL|TIN")], F.lit("other")).alias("label"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))")
def join10_tuple_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.broadcast(spark.createDataFrame([("F", "1-URGENT"), ("O", "5-LOW")], "o_orderstatus string, o_orderpriority string"))
    return table(spark, sf_dir, "orders").join(wanted, ["o_orderstatus", "o_orderpriority"], "left_semi").select("o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def join02_left_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join05_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join06_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name, x.r FROM nation, (VALUES (1), (2)) AS x(r) WHERE n_regionkey = 0")
def join11_cross_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("r"))


@query("SELECT r_name, n_name, n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def join24_scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    nation = table(spark, sf_dir, "nation")
    both = table(spark, sf_dir, "region").join(nation, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return both.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("r_name", "n_name", "n")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_suppkey % 97 + 1 AS dst FROM lineitem),
w AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON node = src WHERE depth < 3)
SELECT node, min(depth) AS depth FROM w GROUP BY node
""")
def aux01_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") % 97 + 1).alias("dst")).distinct()
    return joins.reachable(e, spark.createDataFrame([(1,)], "node long"), 3)


@query("""
SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id), doc_id) AS rn FROM labels) WHERE rn <= 20
""")
def ord08_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.sample_by_quota(table(spark, sf_dir, "labels"), "quality", 20, "doc_id", seed="7").select("doc_id", "quality")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 25")
def ord02_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    return summaries.page_of(rows, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 50, 25)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def ord07_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("SELECT 'customers' AS metric, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'open', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders")
def set01_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    rows = orders.select(F.expr("stack(2, 'orders', orders, 'open', open) as (metric, n)"))
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("n")).select(F.lit("customers").alias("metric"), "n").unionByName(rows)


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set03_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey")
    return table(spark, sf_dir, "part").select("p_partkey").distinct().join(known, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


_UPSERT_SQL = """
WITH old AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal FROM customer),
new AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000000 END AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name || '!' END AS c_name, c_acctbal - 100 AS c_acctbal FROM customer)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers twice: as they were, with some names unknown, and as they come, half of them under new keys."""
    c = table(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name"), "c_acctbal")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1_000_000_000)
    new = c.select(key.alias("c_custkey"), F.when(F.col("c_custkey") % 7 != 0, F.concat("c_name", F.lit("!"))).alias("c_name"), (F.col("c_acctbal") - 100).alias("c_acctbal"))
    return old, new


@query(_UPSERT_SQL + "SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, round(greatest(o.c_acctbal, n.c_acctbal), 2) AS c_acctbal FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey")
def snk02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return upsert.upsert(old, new, ["c_custkey"], {"c_acctbal": "greatest"}).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(_UPSERT_SQL + """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND o.c_acctbal > 5000 THEN o.c_name ELSE coalesce(n.c_name, o.c_name) END AS c_name,
  round(CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND o.c_acctbal > 5000 THEN o.c_acctbal ELSE coalesce(n.c_acctbal, o.c_acctbal) END, 2) AS c_acctbal FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey""")
def snk03_upsert_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return upsert.upsert(old, new, ["c_custkey"], keep_old=F.col("c_acctbal") > 5000).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(_UPSERT_SQL + "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM old UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2) FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def snk06_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return upsert.insert_new(old, new, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(_UPSERT_SQL + "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM old WHERE coalesce(c_name, '') NOT LIKE '%1' UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2) FROM new WHERE c_name LIKE '%1!'")
def snk01_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return upsert.replace_by(old, new.where("c_name like '%1!'"), F.col("c_name").like("%1")).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(_UPSERT_SQL + "SELECT o.c_custkey, coalesce(n.c_name, o.c_name) AS c_name, round(o.c_acctbal, 2) AS c_acctbal FROM old o LEFT JOIN new n USING (c_custkey)")
def snk08_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return upsert.annotate(old, new.select("c_custkey", "c_name"), ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT l_shipmonth, n FROM (SELECT month(l_shipdate) AS l_shipmonth, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05 AND (l_returnflag = 'R' OR l_returnflag = 'A') GROUP BY 1)")
def flt01_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only given parameters filter."""
    given = {"discount": (0.02, 0.05), "flags": ["R", "A"], "line": None}
    tests = [F.col("l_discount").between(*given["discount"]), F.col("l_returnflag").isin(given["flags"]), None if given["line"] is None else F.col("l_linenumber") == given["line"]]
    return table(spark, sf_dir, "lineitem").where(rules.both(tests)).groupBy(F.month("l_shipdate").alias("l_shipmonth")).agg(F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) FILTER (WHERE d >= last - 7) AS active7, count(*) FILTER (WHERE d >= last - 20) AS active20 FROM
  (SELECT event_type, CAST(ts AS DATE) AS d, (SELECT max(CAST(ts AS DATE)) FROM events) AS last FROM events) GROUP BY 1
""")
def flt14_active_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts relative to the last day in the data."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("d"))
    last = events.agg(F.max("d").alias("last"))
    rows = events.crossJoin(F.broadcast(last))
    active = lambda n: F.count_if(summaries.active_on(F.col("d"), F.col("d"), F.col("last"), n)).alias(f"active{n}")
    return rows.groupBy("event_type").agg(active(7), active(20))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def jsn02_json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", arrays.json_key(F.col("props"), "key", "k").try_cast("int").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <> 0 THEN round(o_orderkey / o_totalprice, 8) END AS ratio FROM orders")
def mth04_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(numbers.ratio(F.col("o_orderkey"), F.col("o_totalprice")), 8).alias("ratio"))


@query("SELECT n_regionkey, string_agg(DISTINCT left(n_name, 3), ' + ' ORDER BY left(n_name, 3)) AS names FROM nation GROUP BY 1")
def agg06_joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(arrays.joined_distinct(F.collect_list(F.left("n_name", F.lit(3))), " + ").alias("names"))


@query("SELECT month(ts) AS m, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL")
def agg01_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.month("ts").alias("m"), "event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")
    )


def join20_most_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the name most like theirs (and its part) among other parts of the same brand, size and type."""
    parts = table(spark, sf_dir, "part")
    block = F.concat_ws("/", "p_brand", "p_size", "p_type")
    left = parts.select(F.col("p_partkey"), "p_name", block.alias("block"))
    right = parts.select(F.col("p_partkey").alias("other_partkey"), F.col("p_name").alias("other"), block.alias("block"))
    return joins.most_alike(left, right, "block", "p_name", "other", 0.9, ids=("p_partkey", "other_partkey"))


query()(join20_most_alike)
