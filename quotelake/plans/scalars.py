"""Text, URL, date and number functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.functions import arrays, dates, numbers, rules, text
from quotelake.plans.registry import query, table

EN = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "as")
FR = ("le", "la", "les", "de", "des", "un", "une", "et", "que", "qui")


@query("SELECT doc_id, sha256(lower(strip_accents(text))) AS folded FROM documents")
def str02_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\x{00A0}]+', ' ', 'g'))) AS collapsed, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\x{00A0}]+', '', 'g')) AS n FROM documents")
def str04_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("collapsed"), F.length(text.without_space(F.col("text"))).cast("long").alias("n"))


@query("""
SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
  list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS name FROM pages
""")
def str06_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_path(F.col("url")).alias("path"), text.url_host(F.col("url")).alias("host"), text.file_name(F.col("url")).alias("name"))


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '(#.*)$', 1) AS frag, regexp_replace(url, '#.*$', '') AS bare FROM pages),
v AS (SELECT page_id, frag, regexp_extract(bare, '[?](.*)$', 1) AS q, regexp_replace(bare, '[?].*$', '') AS base FROM u),
w AS (SELECT *, regexp_extract(base, '^([a-zA-Z]+://[^/]*)', 1) AS host,
  array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(gclid(=|$)|dclid(=|$)|gbraid(=|$)|wbraid(=|$)|fbclid(=|$)|msclkid(=|$)|_hsenc(=|$)|_hsmi(=|$)|utm_|gad_|sfmc_|mc_)')), '&') AS kept FROM v)
SELECT page_id, lower(host) || regexp_replace(substr(base, length(host) + 1), '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || frag AS url FROM w
""")
def str07_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query("SELECT doc_id, left(sha256(text), 16) AS fp, CASE WHEN source IS NOT NULL THEN left(sha256('salt|' || source), 32) END AS pseudonym FROM documents")
def str13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fp"), text.pseudonym(F.col("source"), "salt").alias("pseudonym"))


_EN, _FR = (", ".join(f"'{w}'" for w in words) for words in (EN, FR))


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: x IN ({_EN}))) AS a, len(list_filter(ws, lambda x: x IN ({_FR}))) AS b FROM w)
SELECT doc_id, a >= 5 AND coalesce(a / nullif(a + b, 0), 0) >= 0.85 AS translation FROM c
""")
def str20_language_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop-word shares of every whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", text.is_translation(F.col("text"), EN, FR).alias("translation"))


@query("SELECT item, n FROM (SELECT regexp_replace(c_name, '[0-9]', '#', 'g') AS item, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, item LIMIT 5)")
def aux13_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = table(spark, sf_dir, "customer").groupBy(text.masked_digits(F.col("c_name")).alias("item")).agg(F.count("*").alias("n"))
    return masked.orderBy(F.desc("n"), "item").limit(5)


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN greatest(1, round(p_size * 20 / 30.0)::INTEGER) ELSE p_size * 12 END AS months FROM part
""")
def dat01_term_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit(" luni"))).when(F.col("p_size") % 3 == 1, F.concat((F.col("p_size") * 20).cast("string"), F.lit(" de zile"))).otherwise(F.concat("p_size", F.lit(" ani")))
    return table(spark, sf_dir, "part").select("p_partkey", dates.term_months(unit).alias("months"))


@query("SELECT CASE WHEN p_size <= 3 THEN '1-3' WHEN p_size <= 6 THEN '4-6' WHEN p_size <= 12 THEN '7-12' ELSE '>12' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def dat02_term_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(dates.term_bucket(F.col("p_size")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, (date_trunc('quarter', o_orderdate) + INTERVAL 6 MONTH)::DATE AS first, (date_trunc('quarter', o_orderdate) + INTERVAL 9 MONTH - INTERVAL 1 DAY)::DATE AS last FROM orders
""")
def dat03_quarter_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("T"), F.quarter("o_orderdate").cast("string"))
    first, last = dates.quarter_interval(label)
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first"), last.alias("last"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate::DATE > DATE '2000-01-01' THEN 'VIITOR' ELSE 'IN_VIGOARE' END AS state, (o_orderdate::DATE - INTERVAL 3 MONTH)::DATE AS before FROM orders")
def dat07_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.state_on(day, F.lit("2000-01-01").cast("date")).alias("state"), dates.months_before(day, 3).alias("before"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_extendedprice AS value FROM lineitem")
def mth01_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written the local way (thousands by dots, decimals after a comma) and read back."""
    written = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", numbers.decimal_number(written).alias("value"))


@query("""
SELECT s_suppkey, least(CASE s_suppkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.5 END, CASE s_suppkey % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.5 ELSE 1 END)::DOUBLE AS confidence FROM supplier
""")
def mth05_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("ridicata", "medie", "scazuta", "x"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, ("DATA_NECUNOSCUTA", "SUSPECT", "IN_VIGOARE"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", numbers.confidence(word, state).alias("confidence"))


@query("SELECT p_partkey, (CASE WHEN p_name LIKE '%a%' THEN 4 ELSE 0 END) - (CASE WHEN p_type LIKE '%TIN%' THEN 1 ELSE 0 END) AS points, greatest(CASE WHEN p_type LIKE '%STEEL%' THEN 30 ELSE 0 END, CASE WHEN p_name LIKE '%e%' THEN 10 ELSE 0 END) AS best FROM part")
def str17_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat_ws("|", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", rules.score(words, [("^[^|]*a", 4), (r"[|].*TIN", -1)]).alias("points"), rules.score(words, [(r"[|].*STEEL", 30), ("^[^|]*e", 10)], "max").alias("best")
    )


@query("SELECT event_id, list_filter([CASE WHEN value > 90 THEN 'high' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL) AS reasons FROM events WHERE value > 90 OR event_type = 'error'")
def str14_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.reasons(("high", F.col("value") > 90), ("error", F.col("event_type") == "error"))
    return table(spark, sf_dir, "events").select("event_id", found.alias("reasons")).where(F.size("reasons") > 0)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN {'value': c_name, 'source': 'name'} ELSE {'value': c_mktsegment, 'source': 'segment'} END AS first FROM customer
""".replace("{'value': c_name, 'source': 'name'}", "c_name || '<name>'").replace("{'value': c_mktsegment, 'source': 'segment'}", "c_mktsegment || '<segment>'"))
def cnd02_first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = arrays.first_known(("name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))), ("segment", F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(pick["value"], F.lit("<"), pick["source"], F.lit(">")).alias("first"))


@query("""
WITH b0 AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS i FROM b0)),
whole AS (SELECT item_id, count(*) AS runs FROM b WHERE k <> '' GROUP BY 1),
s AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s, (SELECT DISTINCT n FROM b)))
SELECT doc_id, item_id, count(*)::BIGINT AS found, any_value(runs)::BIGINT AS runs FROM d JOIN b USING (n, k) JOIN whole USING (item_id) WHERE k <> '' GROUP BY 1, 2
""")
def d31_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a passage's eight-word runs (of a shorter one the whole) stand in a document, and how many it has: equal numbers prove the passage. Every run of
    every text, met by equality, not a search of each in each."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")

    def runs(w: Column, n: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))

    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.least(F.size("w"), F.lit(8)).alias("n"))
    items = items.select("item_id", "n", F.explode(runs(F.col("w"), F.col("n"))).alias("k")).where("k <> ''").distinct()
    whole = items.groupBy("item_id").agg(F.count("*").alias("runs"))
    lengths = F.broadcast(items.select("n").distinct())  # at most eight rows
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).crossJoin(lengths).select("doc_id", "n", F.explode(F.array_distinct(runs(F.col("w"), F.col("n")))).alias("k"))
    found = docs.join(items, ["n", "k"]).groupBy("doc_id", "item_id").agg(F.countDistinct("k").alias("found"))
    return found.join(whole, "item_id").select("doc_id", "item_id", "found", "runs")
