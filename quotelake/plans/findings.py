"""Press lists, deposits, publication pages, applications and nested reviews: pages and documents are composed from rows, so that SQL knows what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.operators import findings
from quotelake.plans.registry import query, table
from quotelake.sources import variants


@query("""WITH o AS (SELECT *, (o_orderdate + INTERVAL 300 MONTH)::DATE AS day FROM orders)
SELECT o_custkey AS page, 'https://b' || o_custkey || '.ro' || CASE WHEN o_orderstatus = 'O' THEN strftime(day, '/%Y/%m/%d/stire-') ELSE '/comunicate/' END || o_orderkey AS url,
  'Comunicatul ' || o_orderkey || ' despre ' || o_orderpriority AS title, CASE WHEN o_orderstatus <> 'P' THEN day END AS published, CASE o_orderstatus WHEN 'O' THEN 'url' WHEN 'F' THEN 'lista' END AS published_from FROM o""")
def ext20_press_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A press list for each customer: an item for each order, dated beside its link, in its address, or not at all; items stand in items of a list of lists."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 300)
    status, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    path = F.concat(F.when(status == "O", F.date_format(day, "/yyyy/MM/dd/'stire-'")).otherwise("/comunicate/"), key)
    item = F.concat(
        F.lit("<li><a href='"), path, F.lit("'>Comunicatul</a><div><a href='"), path, F.lit("'>Comunicatul "), key, F.lit(" despre "), F.col("o_orderpriority"), F.lit("</a></div>"),
        F.when(status == "F", F.concat(F.lit(" <span>"), F.date_format(day, "dd.MM.yyyy"), F.lit("</span>"))).otherwise(""), F.lit("</li>"),
    )
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.array_join(F.collect_list(item), "").alias("items"))  # some tens of orders
    html = F.concat(F.lit("<html><body><nav><ul><li><a href='/comunicate/0'>Un meniu lung, 01.01.2020</a></ul></nav><ul><li>Arhiva<ul>"), F.col("items"), F.lit("</ul></li></ul><footer>02.02.2020</footer></body></html>"))
    pages = lists.select("page", F.concat(F.lit("https://b"), F.col("page"), F.lit(".ro/presa")).alias("url"), html.alias("html"))
    return findings.press_in_blocks(pages, F.lit("2026-09-30").cast("date"), page="page").select("page", "url", "title", "published", "published_from")


@query("""SELECT DISTINCT p_partkey // 20 AS page, 'depozitul ' || lower(p_name) AS name FROM part""")
def ext18_deposit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deposits that pages of twenty products each name in headings, links and text, once each."""
    item = F.concat(F.lit("<h2>Depozitul "), F.initcap("p_name"), F.lit("</h2><p>ce este un depozit?</p><a href='/d'>depozitul "), F.lower("p_name"), F.lit("</a><h3>Cum alegi un depozit bun</h3>"))
    pages = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 20").alias("page")).agg(F.array_join(F.collect_list(item), "").alias("html"))
    return findings.deposit_names(pages.withColumn("url", F.lit("https://b.ro")), page="page")


_LINK = """CASE c_mktsegment WHEN 'BUILDING' THEN '/tarife/' WHEN 'MACHINERY' THEN '/tarife/' ELSE '/p/' END"""
_SAID = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Tarife și comisioane' WHEN 'MACHINERY' THEN 'Contact' WHEN 'HOUSEHOLD' THEN 'Documente' ELSE 'Despre noi' END"


@query(f"""WITH v AS (SELECT c_nationkey AS owner, 'https://www.b' || c_nationkey || '.ro' || {_LINK} || c_custkey AS url, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END AS points,
  CASE WHEN c_acctbal < 0 THEN 'necitita' WHEN c_acctbal > 5000 THEN 'confirmat' ELSE 'nu_mentioneaza' END AS verdict FROM customer)
SELECT owner, url, points, verdict FROM v WHERE points > 0""")
def aux14_publication_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by their links, proved by the content of the pages they lead to; customers stand for links and pages."""
    c = table(spark, sf_dir, "customer")
    site = F.concat(F.lit("https://www.b"), F.col("c_nationkey"), F.lit(".ro"))
    url = F.concat(site, F.expr(_LINK), F.col("c_custkey"))
    links = c.select(site.alias("page_url"), F.concat(url, F.lit("?utm_source=x#sus")).alias("url"), F.expr(_SAID).alias("text"))
    pages = c.where("c_acctbal >= 0").select(url.alias("url"), F.when(F.col("c_acctbal") > 5000, "Lista de PREȚURI").otherwise("Rapoarte anuale").alias("text"))
    hosts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("owner"), F.concat(F.lit("b"), F.col("n_nationkey"), F.lit(".ro")).alias("host"))
    return findings.publication_pages(links, hosts, pages)


@query("""WITH n AS (SELECT n_nationkey, n_name, replace(lower(n_name), ' ', '-') AS slug FROM nation),
r AS (SELECT slug, n_name, c_custkey, c_mktsegment = 'BUILDING' AS seller, c_mktsegment = 'MACHINERY' AS title, c_acctbal > 0 AS finance, c_acctbal > 5000 AS home FROM customer JOIN n ON c_nationkey = n_nationkey),
f AS (SELECT slug, n_name, CASE WHEN seller THEN 'seller' ELSE 'title' END AS sign_in, home AS sure, c_custkey FROM r WHERE (seller OR title) AND finance)
SELECT slug, c_custkey AS app_id, sign_in, sure FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY sure DESC, c_custkey) AS rn FROM f) WHERE rn = 1""")
def ext25_matched_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's application among its customers: by seller or title, category and language; a sure one before any other."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.replace(F.lower("n_name"), F.lit(" "), F.lit("-")).alias("slug"))
    banks = n.select("slug", F.col("n_name").alias("name"), F.array().cast("array<string>").alias("domains"))
    own = F.concat(F.lower("n_name"), F.lit(" apps"), F.replace("slug", F.lit("-"), F.lit("")))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    results = c.select(
        "slug", F.col("c_custkey").alias("rank"), F.col("c_custkey").alias("app_id"), F.when(F.col("c_mktsegment") == "BUILDING", own).otherwise("zzz").alias("seller"), F.lit("com.x").alias("bundle"),
        F.when(F.col("c_mktsegment") == "MACHINERY", own).otherwise("zzz").alias("title"), F.when(F.col("c_acctbal") > 0, F.array(F.lit(6015), F.lit(1))).otherwise(F.array(F.lit(7000))).alias("genres"),
        F.when(F.col("c_acctbal") > 5000, F.array(F.lit("EN"), F.lit("ro"))).otherwise(F.array(F.lit("EN"))).alias("languages"),
    )
    return findings.matched_application(results, banks).select("slug", "app_id", "sign_in", "sure")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer: reviews and star counts, as deep as the customer's nation says."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_join(F.collect_list(F.concat(F.lit('{"$kind":"Review","id":"'), F.col("o_orderkey"), F.lit('","price":'), F.col("o_totalprice").cast("decimal(20,2)"), F.lit("}"))), ",").alias("all"),
        *(F.count_if(F.col("o_orderpriority").startswith(str(k))).alias(f"s{k}") for k in range(1, 6)),
    )
    c = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    stars = F.concat(F.lit('{"ratingCounts":['), F.concat_ws(",", *(F.col(f"s{k}").cast("string") for k in range(1, 6))), F.lit('],"more":{"ratingCounts":[1,2]}}'))
    depth = F.col("c_nationkey") % 7
    body = F.concat(F.repeat(F.lit('{"x":[0,'), depth), F.lit('{"items":['), F.col("all"), F.lit('],"page":'), stars, F.lit("}"), F.repeat(F.lit("]}"), depth))
    return c.select("c_custkey", body.alias("document"))


@query("SELECT o_custkey AS c_custkey, o_orderkey::VARCHAR AS id, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey")
def src15_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews of every document, however deep."""
    found = variants.reviews(_reviews(spark, sf_dir), ["c_custkey"], F.col("document"))
    return found.select("c_custkey", "id", F.round(F.variant_get("review", "$.price", "double"), 2).alias("price"))


@query("""WITH s AS (SELECT o_custkey AS c_custkey, """ + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{k}%') AS s{k}" for k in range(1, 6)) + """ FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, s1 + s2 + s3 + s4 + s5 AS ratings, round((5.0 * s1 + 4 * s2 + 3 * s3 + 2 * s4 + s5)::DOUBLE / (s1 + s2 + s3 + s4 + s5), 2) AS average, s1 + s2 AS best, s5 AS worst, 0 IN (s1, s2, s3, s4, s5) AS gaps FROM s""")
def arr05_star_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five star counts of every document, wherever they stand, and what they say."""
    counts = variants.star_counts(_reviews(spark, sf_dir), ["c_custkey"], F.col("document"))
    return counts.select("c_custkey", variants.star_distribution(F.col("counts")).alias("s")).select("c_custkey", "s.*")
