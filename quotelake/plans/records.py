"""Sources read back from files that Spark wrote of the tables, sinks that may run twice, and column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake import storage
from quotelake.functions import arrays, dates, numbers, rules, text
from quotelake.functions import vocabulary as V
from quotelake.operators import campaigns, discovery, extract, normalise, quality, upsert
from quotelake.plans.registry import query, table
from quotelake.sources import readers, sinks
from quotelake.streaming import incremental

# ---- sources


@query(r"""SELECT page_id, regexp_replace(left(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www[.])?', ''), '[^a-z0-9]+', '_', 'g'), 80), '^_|_$', '', 'g') || '_' || left(sha256(url), 16) AS name FROM pages""")
def src02_stored_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", readers.stored_name(F.col("url")).alias("name"))


@query("SELECT event_id, user_id, value, FALSE AS bad FROM events WHERE event_type <> 'error' UNION ALL SELECT NULL, NULL, NULL, TRUE FROM events WHERE event_type = 'error'")
def src05_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of JSON lines, those of errors cut off in the middle."""
    whole = F.to_json(F.struct("event_id", "user_id", "value"))
    path = storage.folder(spark, "journal")
    table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole).alias("value")).write.text(path)
    good, bad = readers.journal(spark, path, "event_id long, user_id long, value double")
    none = F.lit(None)
    return good.withColumn("bad", F.lit(False)).unionByName(bad.select(none.cast("long").alias("event_id"), none.cast("long").alias("user_id"), none.cast("double").alias("value"), F.lit(True).alias("bad")))


@query("SELECT c_custkey, CASE WHEN c_nationkey > 2 THEN ' ' || c_name || ' \"x\", y' || chr(10) || 'z ' END AS name, c_acctbal AS balance FROM customer")
def src06_src07_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, commas, line ends and no-break spaces, kept as they are; empty ones are null."""
    path = storage.folder(spark, "csv")
    name = F.when(F.col("c_nationkey") > 2, F.concat(F.lit(" "), F.col("c_name"), F.lit(' "x", y\nz ')))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.col("c_acctbal").alias("balance"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.csv(spark, path, "c_custkey long, name string, balance double", verbatim=True)


@query("""SELECT 'c' || c_custkey AS id, c_name AS name, c_acctbal / 1000 AS lat, c_nationkey::DOUBLE AS lon, 0.5::DOUBLE AS confidence, c_mktsegment AS address, CASE WHEN c_nationkey % 2 = 0 THEN 'a,b' ELSE 'b,c' END AS datasets
FROM customer WHERE c_acctbal / 1000 BETWEEN 1 AND 5 AND c_nationkey BETWEEN 3 AND 20""")
def src10_arr02_nested_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested table by its leaves and a box; data sets of each place, sorted and once each."""
    path = storage.folder(spark, "places")
    lat, lon = F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")
    box = F.struct(lat.alias("ymin"), lat.alias("ymax"), lon.alias("xmin"), lon.alias("xmax"))
    source = lambda name: F.struct(F.lit(name).alias("dataset"), F.lit("x").alias("record"))
    sources = F.array(source("b"), F.struct(F.when(F.col("c_nationkey") % 2 == 0, "a").otherwise("c").alias("dataset"), F.lit("y").alias("record")), source("b"))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.struct(F.col("c_name").alias("primary"), F.lit("?").alias("other")).alias("names"), box.alias("bbox"), F.lit(0.5).alias("confidence"),
        F.array(F.struct(F.col("c_mktsegment").alias("freeform"), F.lit("RO").alias("country"))).alias("addresses"), sources.alias("sources"), F.col("c_nationkey").alias("part"),
    )
    rows.write.partitionBy("part").parquet(path)
    return readers.nested_places(spark, path, (1.0, 5.0, 3.0, 20.0))


@query("SELECT o_orderdate::DATE AS day, 'C' || left(o_orderpriority, 1) AS currency, round(sum(o_totalprice) / 100, 6) AS rate FROM orders GROUP BY 1, 2")
def src11_exchange_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML feed of day cubes whose rates are for a hundred units."""
    path = storage.folder(spark, "rates")
    day = F.col("o_orderdate").cast("date")
    sums = table(spark, sf_dir, "orders").groupBy(day.alias("day"), F.concat(F.lit("C"), F.left("o_orderpriority", F.lit(1))).alias("currency")).agg(F.round(F.sum("o_totalprice"), 4).alias("v"))
    rate = F.struct(F.col("v").alias("_VALUE"), F.col("currency").alias("_currency"), F.lit(100).alias("_multiplier"))
    sums.groupBy(F.col("day").cast("string").alias("_date")).agg(F.collect_list(rate).alias("Rate")).write.format("xml").option("rowTag", "Cube").option("rootTag", "Body").save(path)
    return readers.exchange_rates(spark, path)


@query("""SELECT o_custkey, 'https://b.ro/p?a=1&o=' || o_orderkey AS loc, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS lastmod, o_custkey % 2 = 0 AS is_index FROM orders""")
def src12_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each customer, every third packed by gzip: indexes and lists, with and without dates."""
    tag = F.when(F.col("o_custkey") % 2 == 0, "sitemap").otherwise("url")
    entry = F.concat(F.lit("<"), tag, F.lit(">\n<loc> https://b.ro/p?a=1&amp;o="), F.col("o_orderkey"), F.lit("</loc>"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("<lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(""), F.lit("</"), tag, F.lit(">"))
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(entry), "\n").alias("all"), F.max(tag).alias("tag"))
    root = F.when(F.col("tag") == "sitemap", "sitemapindex").otherwise("urlset")
    body = F.concat(F.lit("<"), root, F.lit(">"), F.col("all"), F.lit("</"), root, F.lit(">")).cast("binary")
    packed = F.when(F.col("o_custkey") % 3 == 0, readers.gzipped(body)).otherwise(body)
    return extract.sitemap_entries(files.select("o_custkey", readers.unpacked(packed).alias("body")), keep=["o_custkey"])


# ---- sinks


@query("SELECT DISTINCT source, left(sha256(text), 16) AS hash FROM documents WHERE source IS NOT NULL")
def snk09_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints appended twice: a second run adds only what is new."""
    path = storage.folder(spark, "fingerprints")
    new = table(spark, sf_dir, "documents").where("source is not null").select("source", text.fingerprint(F.col("text")).alias("hash"), "lang")
    none = new.where("false").select("source", "hash")
    sinks.append_fingerprints(none, new.where("lang in ('en', 'fr')").select("source", "hash"), path)
    sinks.append_fingerprints(spark.read.schema("source string, hash string").parquet(path), new.select("source", "hash"), path)
    return spark.read.schema("source string, hash string").parquet(path)


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def snk07_overwritten_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table of which one partition is replaced twice; the others stay."""
    path = storage.folder(spark, "partitions")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    sinks.overwrite_partitions(rows, path, ["o_orderstatus"])
    for _ in range(2):
        sinks.overwrite_partitions(rows.where("o_orderstatus = 'F'").withColumn("price", F.col("price") * 2), path, ["o_orderstatus"])
    return spark.read.schema("o_orderkey long, price double, o_orderstatus string").parquet(path).select("o_orderkey", "o_orderstatus", "price")


@query("SELECT CASE WHEN o_totalprice > 400000 THEN 'too_large' WHEN o_orderstatus = 'P' THEN 'open' ELSE 'late' END AS reject_reason, count(*) AS n FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P' OR o_orderdate > TIMESTAMP '1998-01-01' GROUP BY 1")
def snk12_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each rule refuses, the first that a row breaks."""
    rules_ = [("too_large", F.col("o_totalprice") <= 400000), ("open", F.col("o_orderstatus") != "P"), ("late", F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp"))]
    return quality.reject_report(quality.invalid_rows(table(spark, sf_dir, "orders"), rules_)[1])


@query("SELECT o_orderkey FROM orders WHERE date_diff('day', o_orderdate::DATE, DATE '1998-08-02') < 900 AND (o_orderstatus <> 'F' OR DATE '1998-08-02' < (o_orderdate + INTERVAL 24 MONTH)::DATE)")
def snk14_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows young enough, and before their own date of deletion where they have one."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("taken"), F.when(F.col("o_orderstatus") == "F", F.add_months(day, 24)).alias("delete_on"))
    return upsert.kept_until(rows, "taken", "delete_on", F.lit("1998-08-02").cast("date"), 900).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def snk10_snk11_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that has lost no rows and few signals passes both guards."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", 1).alias("signal"))
    new = upsert.guard_shrink(orders.withColumn("signal", F.lit(1)), orders, "signal")
    return upsert.reconcile(orders.count(), new).select("o_orderkey", "o_totalprice")


# ---- texts and numbers


@query(r"""WITH w AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(lower(translate(source || ' the Running of runners ' || lang, 'é', 'e')), '[a-z0-9]+'), lambda x: len(x) > 2 AND x NOT IN ('the', 'and')), lambda x: left(x, 5))) AS ws FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(ws)[1:3], ' ') AS signature FROM w""")
def str12_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return docs.select("doc_id", text.signature(F.concat("source", F.lit(" the Running of runners "), "lang"), ("the", "and"), 5, 3).alias("signature"))


@query(r"""SELECT p_partkey, split_part(p_name, ' ', 2) AS second, split_part(p_name, ' ', 9) AS ninth, list_filter(list_transform(string_split(p_name || '| ' || p_brand || ' || |' || p_type, '|'), lambda x: trim(x)), lambda x: x <> '').list_aggregate('string_agg', '/') AS items FROM part""")
def str01_arr06_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of delimited texts, and their trimmed items that aren't empty."""
    whole = F.concat("p_name", F.lit("| "), "p_brand", F.lit(" || |"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.part(F.col("p_name"), " ", 2).alias("second"), text.part(F.col("p_name"), " ", 9).alias("ninth"), F.array_join(text.items(whole), "/").alias("items"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate::DATE END AS day,
  CASE l_returnflag WHEN 'A' THEN l_quantity + 0.25 WHEN 'R' THEN round(l_extendedprice) / 1 ELSE l_quantity * 1000 END::DOUBLE AS number, CASE WHEN l_quantity <= 9 THEN l_quantity + 0.125 ELSE l_quantity + 0.125 END::DOUBLE AS share FROM lineitem""")
def dat14_mth01_written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted dates, and numbers and percentages in the ways in which they are written: decimals by comma, thousands by point or comma."""
    flag, q = F.col("l_returnflag"), F.col("l_quantity").cast("int")
    day = F.when(flag == "N", F.date_format("l_shipdate", "yyyy/MM/dd")).otherwise(F.date_format("l_shipdate", "d.M.yyyy"))
    words = F.when(flag == "A", F.concat(q, F.lit(",25"))).when(flag == "R", F.translate(F.format_number(F.round("l_extendedprice"), 0), ",", ".")).otherwise(F.concat(q, F.lit(",000")))
    share = F.concat(q, F.lit(",125"))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(*keys, dates.dotted_date(day).alias("day"), numbers.decimal_number(words).alias("number"), numbers.decimal_number(share, True).alias("share"))


@query("""SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR AS raw, CASE WHEN c_nationkey % 3 = 0 THEN 'lat' ELSE 'latitude' END || c_custkey AS place, 1::BIGINT AS objects,
  CASE WHEN c_nationkey % 4 = 0 THEN 'link' WHEN c_acctbal > 0 THEN 'page' ELSE 'none' END AS evidence FROM customer""")
def jsn02_jsn03_cnd03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row as JSON, objects and alternative keys out of a text, and how strong the evidence is."""
    n, key = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    name = F.when(n % 3 == 0, "lat").otherwise("latitude")
    body = F.concat(F.lit("var a = [{\"other\": 1}, {\"id\": 7, \""), name, F.lit('": "'), name, key, F.lit("\"}];"))
    found = arrays.json_objects(body, "id")
    level = arrays.evidence_level(F.when(n % 4 == 0, "https://b.ro"), F.when(F.col("c_acctbal") > 0, 1))
    return table(spark, sf_dir, "customer").select("c_custkey", arrays.row_json("c_custkey", "c_name", "c_nationkey").alias("raw"), arrays.json_key(found[0], "lat", "latitude").alias("place"), F.size(found).cast("long").alias("objects"), level.alias("evidence"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'sepa' WHEN p_size % 5 = 2 THEN 'ue' WHEN p_size % 5 = 3 THEN 'extern' END AS destination, CASE WHEN p_size < 10 THEN 'dobanda' WHEN p_size < 20 THEN 'limita' WHEN p_size < 30 THEN 'curs' WHEN p_size < 35 THEN 'taxa_stat' ELSE 'comision' END AS category FROM part""")
def set06_ext05_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most special of several matching labels, none if two exclude each other; and what kind of figure a line holds."""
    size = F.col("p_size")
    words = F.when(size % 5 == 0, "plată intrabancar și interbancar").when(size % 5 == 1, "plată externă SEPA în UE").when(size % 5 == 2, "extern, în UE").when(size % 5 == 3, "plată în străinătate").otherwise("plată")
    found = rules.all_matches(F.concat(words, F.lit(" "), F.col("p_name")), V.insensitive(V.DESTINATIONS))
    line = F.concat(F.col("p_name"), F.when(size < 10, " dobândă").when(size < 20, " limită zilnică").when(size < 30, " curs de schimb").when(size < 35, " taxă de timbru").otherwise(" administrare"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.most_specific(found, V.DESTINATION_CHAIN, V.DESTINATION_EXCLUSIVE).alias("destination"), extract.figure_category(line).alias("category"))


# ---- rates, links, places, runs


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'marja_ircc' WHEN 'O' THEN 'marja_robor' ELSE 'nominala' END AS kind, 1.0 + o_orderkey % 9 AS value, CASE WHEN o_orderpriority = '1-URGENT' THEN 2.0 + o_orderkey % 9 END AS high FROM orders),
i AS (SELECT * FROM r UNION ALL SELECT o_orderkey, kind, high, high FROM r WHERE high IS NOT NULL)
SELECT o_orderkey, kind, value::DOUBLE AS value, FALSE AS derived FROM i UNION ALL SELECT o_orderkey, 'nominala', round(value + 5.56, 4)::DOUBLE, TRUE FROM i WHERE kind = 'marja_ircc'""")
def mth07_mth08_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals get a row for their upper end, margins over an index in force a derived total; an index without a value gives none."""
    index = spark.createDataFrame([("ircc_valoare", 5.56, "2026-07-01", None), ("robor_valoare", 6.0, "2025-01-01", "2025-03-31")], "kind string, value double, a string, b string")
    index = index.select("kind", "value", F.col("a").cast("date").alias("valid_from"), F.col("b").cast("date").alias("valid_to"))
    kind = F.when(F.col("o_orderstatus") == "F", "marja_ircc").when(F.col("o_orderstatus") == "O", "marja_robor").otherwise("nominala")
    value = (F.col("o_orderkey") % 9 + 1).cast("double")
    rates = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), value.alias("value"), F.when(F.col("o_orderpriority") == "1-URGENT", value + 1).alias("high"))
    return normalise.derived_totals(normalise.interval_ends(rates), index, F.lit("2026-09-16").cast("date")).select("o_orderkey", "kind", "value", "derived")


@query("""WITH u AS (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN '/privat/a' WHEN 'MACHINERY' THEN '/privat/public/b' WHEN 'HOUSEHOLD' THEN '/x.pdf' ELSE '/p' END || c_custkey AS path FROM customer)
SELECT c_custkey, NOT (path LIKE '/privat/%' AND path NOT LIKE '/privat/public/%') AND NOT (c_nationkey % 2 = 0 AND path LIKE '/p%' AND path NOT LIKE '/privat/public/%') AS allowed, CASE WHEN c_nationkey % 2 = 0 THEN 5.0::DOUBLE END AS crawl_delay FROM u""")
def str19_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses a host's rules allow: the agent's own group or everybody's, the longest match, patterns, a delay."""
    path = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "/privat/a").when(F.col("c_mktsegment") == "MACHINERY", "/privat/public/b").when(F.col("c_mktsegment") == "HOUSEHOLD", "/x.pdf").otherwise("/p"), F.col("c_custkey"))
    urls = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("h"), F.col("c_nationkey")).alias("host"), path.alias("path"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("h"), F.col("n_nationkey")).alias("host"), (F.col("n_nationkey") % 2 == 0).alias("own"))
    kinds = [("*", "disallow", "/privat/", False), ("*", "allow", "/*/public", False), ("mip", "disallow", "/privat", True), ("mip", "allow", "/privat/public/", True), ("mip", "disallow", "/p*", True), ("mip", "delay", "5", True)]
    given = F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(k).alias("kind"), F.lit(v).alias("value"), F.lit(o).alias("only_own")) for a, k, v, o in kinds)))
    rules_ = nation.select("host", "own", given.alias("r")).where("own or not r.only_own").select("host", "r.agent", "r.kind", "r.value")
    verdict = extract.robots_verdict(urls.select("host", "path"), rules_, "MIP")
    return urls.join(verdict, ["host", "path"]).select("c_custkey", "allowed", "crawl_delay")


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'regulament' WHEN 'MACHINERY' THEN 'act_aditional' WHEN 'HOUSEHOLD' THEN 'landing' END AS role FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_nationkey % 2 = 0""")
def ext12_campaign_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a hub that lead to campaigns, on the bank's own hosts, with what they lead to."""
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    path = F.when(segment == "BUILDING", F.concat(F.lit("/doc/regulament-campanie-"), key, F.lit(".pdf"))).when(segment == "MACHINERY", F.concat(F.lit("/doc/act-aditional-campanie-"), key, F.lit(".pdf"))).when(segment == "HOUSEHOLD", F.concat(F.lit("/campanii/oferta-"), key)).otherwise(F.concat(F.lit("/despre/"), key))
    host = F.when(F.col("c_nationkey") % 2 == 0, "https://www.banca.ro").otherwise("https://alta.ro")
    links = table(spark, sf_dir, "customer").select("c_custkey", F.lit("https://www.banca.ro/campanii").alias("page_url"), F.concat(host, path).alias("url"), F.lit("Detalii").alias("text"))
    return campaigns.candidates(links, ["banca.ro"], strict=True).select("c_custkey", "role")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def aux02_relevant_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose text or address speaks of what is looked for."""
    links = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://b.ro/"), F.when(F.col("c_mktsegment") == "BUILDING", "Economii").otherwise("x")).alias("url"), F.when(F.col("c_mktsegment") == "MACHINERY", "Depozite la termen").otherwise("y").alias("text"))
    return discovery.relevant_links(links, ["depozit", "economii"]).select("c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'atm' ELSE 'branch' END AS kind, round(44.0 + c_nationkey / 10.0, 6) AS lat, 26.0::DOUBLE AS lon, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'partener' ELSE 'proprie' END AS network FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20""")
def ext17_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches and machines out of pages' JSON and elements, within the country, once each."""
    name = F.when(F.col("c_mktsegment") == "BUILDING", "ATM Unirii").when(F.col("c_mktsegment") == "MACHINERY", "Agentia Euronet").otherwise("Agentia Unirii")
    lat = F.when(F.col("c_acctbal") > 0, F.lit(44.0) + F.when(F.col("c_nationkey") < 20, F.col("c_nationkey") / 10).otherwise(30.0)).otherwise(0.0)
    point = F.concat(F.lit('{"name": "'), name, F.lit('", "latitude": "'), lat, F.lit('", "lng": 26.0}'))
    body = F.concat(F.lit("<script>var p = ["), point, F.lit(","), point, F.lit("]</script>"))
    pages = table(spark, sf_dir, "customer").select("c_custkey", body.alias("html"))
    return extract.extract_points(pages).select("c_custkey", "kind", "lat", "lon", "network")


@query("SELECT o_orderkey, o_orderstatus <> 'P' AS comparable FROM orders WHERE NOT (o_orderdate::DATE = DATE '1997-05-28' AND o_orderstatus = 'F')")
def stm05_stm08_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a broken run hasn't finished, and whether its values may be compared with the last run's."""
    orders = table(spark, sf_dir, "orders")
    done = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    todo = incremental.remaining(orders, done, ["o_orderkey"], F.lit("1997-05-28").cast("date"))
    parser = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise("v1")
    return todo.select("o_orderkey", incremental.comparable(parser, F.lit("v1")).alias("comparable"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of orders: some without a bank, a source or a value."""
    from quotelake.schemas import RAW_RECORD

    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    given: dict[str, Column] = {
        "banca": F.when(key % 10 != 0, F.concat(F.lit(" Banca "), F.col("o_custkey") % 5)), "sursa": F.when(key % 10 != 1, "https://b.ro"), "valoare": F.when(key % 10 != 2, F.round(F.col("o_totalprice") / 100, 2)), "tip": F.lit("comision_suma"),
        "moneda": F.when(status == "F", "LEI").otherwise("EUR"), "concept": F.lit("administrare_cont"), "rol": F.when(status == "O", "min"), "categorie": F.lit("comision"), "segment": F.lit("pf"), "incredere": F.lit("medie"), "serviciu": F.repeat(F.lit("s"), F.lit(400)),
        "citat": F.repeat(F.lit("c"), F.lit(600)),
    }
    kinds = [c.strip().split(" ") for c in RAW_RECORD.split(",")]
    return table(spark, sf_dir, "orders").select("o_orderkey", *(given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds))


@query("""SELECT 'banca ' || o_custkey % 5 AS banca, CASE WHEN o_orderstatus = 'O' THEN 'administrare_cont_min' ELSE 'administrare_cont' END AS camp, CASE WHEN o_orderstatus = 'F' THEN 'lei' ELSE 'eur' END AS unitate, 'comision|pf' AS cod_scenariu, 0.6::DOUBLE AS confidence,
  300::BIGINT AS service, 500::BIGINT AS quote, count(*) AS n FROM orders WHERE o_orderkey % 10 > 2 GROUP BY ALL""")
def d06_str11_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records to observations: slugs, fields with their role, scenarios, confidence, texts cut to their limits."""
    good, _ = normalise.normalise(_raw(spark, sf_dir))
    rows = good.select("banca", "camp", "unitate", "cod_scenariu", F.col("confidence").cast("double").alias("confidence"), F.length("serviciu").cast("long").alias("service"), F.length("citat").cast("long").alias("quote"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderkey % 10 WHEN 0 THEN 'no_bank' WHEN 1 THEN 'no_source' ELSE 'no_value' END AS reject_reason, count(*) AS n FROM orders WHERE o_orderkey % 10 < 3 GROUP BY 1")
def d06_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records that no observation is made of, by reason."""
    return quality.reject_report(normalise.normalise(_raw(spark, sf_dir))[1])


@query("SELECT c_custkey, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def src03_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each hold a JSON array of some thousand records over several lines."""
    path = storage.folder(spark, "records")
    record = F.to_json(F.struct("c_custkey", F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance")))
    files = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 5000").alias("file")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value"))
    files.write.partitionBy("file").text(path)
    return readers.json_records(spark, path, "c_custkey long, name string, balance double").select("c_custkey", "name", "balance")


@query("SELECT 'c' || c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def src04_json_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each hold a JSON object of some thousand records by their ids."""
    path = storage.folder(spark, "keyed")
    record = F.concat(F.lit('"c'), F.col("c_custkey"), F.lit('": '), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))))
    files = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 5000").alias("file")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(record), ",\n"), F.lit("}")).alias("value"))
    files.write.partitionBy("file").text(path)
    return readers.json_by_key(spark, path, "segment string, nation int", "id")


@query("SELECT 'h' || n_nationkey AS name, 'differs' AS state FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'h' || n_nationkey, 'missing' FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT 'h' || n_nationkey, 'unlisted' FROM nation WHERE n_nationkey % 5 = 2")
def src08_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of files against its manifest: one of each five has changed, one isn't there, one isn't listed."""
    nation = table(spark, sf_dir, "nation")
    k, body = F.col("n_nationkey") % 5, F.concat(F.col("n_name"), F.lit(" body"))
    name = F.concat(F.lit("h"), F.col("n_nationkey"))
    files = nation.where(k != 1).select(F.concat(F.lit("store/package/"), name).alias("path"), F.sha2(body.cast("binary"), 256).alias("hash"))
    manifest = nation.where(k != 2).select(name.alias("name"), F.upper(F.sha2(F.when(k == 0, "old").otherwise(body).cast("binary"), 256)).alias("sha256"))
    return readers.check_manifest(files, manifest)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def snk07_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose order a new snapshot still holds."""
    new = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return upsert.replace_all(new, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "o_orderkey", "l_orderkey")[1]


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k, source FROM documents WHERE source IS NOT NULL), s AS (SELECT source, source = (SELECT min(source) FROM d) AS skipped FROM d GROUP BY 1)
SELECT doc_id, CASE WHEN k = 0 THEN CASE WHEN skipped THEN 'NEVERIFICAT' ELSE 'LIPSA' END WHEN k = 1 THEN 'NOU' WHEN k = 2 THEN 'NEDESCARCAT' WHEN k = 3 THEN 'AMBIGUU' WHEN k = 4 THEN 'SCHIMBAT' ELSE 'NESCHIMBAT' END AS state FROM d JOIN s USING (source)""")
def stm02_every_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in each state there is: known and gone, known of a source that wasn't crawled, new, seen but not read, seen with two contents, changed, unchanged."""
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.col("doc_id").alias("url"), F.col("source").alias("owner"), (F.col("doc_id") % 6).alias("k"), F.sha2("text", 256).alias("hash"))
    known = d.where("k <> 1").select("url", "owner", F.when(F.col("k") == 4, "old").otherwise(F.col("hash")).alias("hash"))
    seen = d.where("k <> 0").select("url", "owner", F.when(F.col("k") != 2, F.col("hash")).alias("hash"), (F.col("k") != 2).alias("ok"))
    twice = d.where("k = 3").select("url", "owner", F.lit("other").alias("hash"), F.lit(True).alias("ok"))
    first = d.agg(F.min("owner").alias("__first"))
    crawled = d.select("owner").distinct().join(F.broadcast(first), F.col("owner") == F.col("__first"), "left_anti")
    return incremental.document_states(known, seen.unionByName(twice), crawled).select(F.col("url").alias("doc_id"), "state")
