"""Press lists, deposits, publication pages, applications, nested regions and streamed histories."""

import datetime

import pytest
from pyspark.sql import functions as F

from quotelake.operators import findings
from quotelake.sources import readers
from quotelake.streaming import history

PRESS = """<html><head><title>Presa 01.01.2020</title></head><body><nav><ul><li><a href="/comunicate/meniu">Un titlu lung din meniu 02.02.2021</a></ul></nav>
<ul><li>12.03.2026 <a href="/comunicate/a">Prima știre despre carduri</a><li><a href="/comunicate/b">A doua știre, cu detalii</a> <span>5 mai 2026</span>
<ul><li><a href="/comunicate/c">A treia știre, din interior</a></li></ul></li></ul>
<article><h2>Noutăți</h2><p><a href="/comunicate/d">Scurt</a> <a href="/comunicate/d#x">Același comunicat, titlu lung</a> 2026-06-07</p></article>
<div><a href="/2026/09/25/stire">O știre cu ziua în adresă</a></div><p>fără <a href="https://alt.ro/x">O știre de pe alt site, lungă</a></p><a href="/p?page=2">Pagina a doua a listei</a></body></html>"""


def test_press_items_take_the_date_of_their_block(spark):
    pages = spark.createDataFrame([(1, "https://www.b.ro/presa", PRESS, "x"), (2, "https://www.b.ro/gol", None, "x")], "page_id int, url string, html string, title string")
    rows = findings.press_in_blocks(pages, F.lit("2026-09-30").cast("date")).collect()
    got = {r["url"].rsplit("b.ro")[-1]: (r["title"], str(r["published"]), r["published_from"]) for r in rows}
    assert got == {
        "/comunicate/a": ("Prima știre despre carduri", "2026-03-12", "lista"), "/comunicate/b": ("A doua știre, cu detalii", "2026-05-05", "lista"),
        "/comunicate/c": ("A treia știre, din interior", "None", None), "/comunicate/d": ("Același comunicat, titlu lung", "2026-06-07", "lista"),
        "/2026/09/25/stire": ("O știre cu ziua în adresă", "2026-09-25", "url"),
    }
    with_prefix = findings.press_in_blocks(pages, F.lit("2026-09-30").cast("date"), prefix="/comunicate/").count()
    assert with_prefix == 4
    assert findings.press_in_blocks(pages.limit(0), F.lit("2026-09-30").cast("date")).collect() == []


def test_deposit_names(spark):
    body = """<h1>Depozite</h1><h3>Ce este un depozit?</h3><h2>Depozitul Junior Plus</h2><a href="/d">depozitul junior plus</a><a href="/e">Mergi la depozite</a>
    <p>Alegeți Depozitul VISTA KIDS sau Contul de Economii Smart. Depozit la Termen.</p><a href="/x">Cum alegi economii potrivite</a><a href="/y">Economii pentru copii mici și mari de toate vârstele</a>"""
    pages = spark.createDataFrame([(1, "https://b.ro", body), (2, "https://b.ro/2", None)], "page_id int, url string, html string")
    got = {r["name"] for r in findings.deposit_names(pages).collect()}
    assert got == {"depozitul junior plus", "Depozitul VISTA KIDS", "Contul de Economii Smart", "Depozit la Termen"}


def test_publication_pages_are_proved_by_their_content(spark):
    links = spark.createDataFrame(
        [("https://b.ro", "https://www.b.ro/documente?x=1", "Documente"), ("https://b.ro", "https://b.ro/x1", "Tarife și comisioane"), ("https://b.ro", "https://b.ro/tarife", "Taxe"), ("https://b.ro", "https://b.ro/t.pdf", "Tarife"),
         ("https://b.ro", "https://alt.ro/tarife", "Tarife"), ("https://b.ro", "https://b.ro/contact", "Contact"), ("https://b.ro", "https://b.ro/pricing", "Abonamente")], "page_url string, url string, text string",
    )
    pages = spark.createDataFrame([("https://www.b.ro/documente", "Rapoarte anuale"), ("https://b.ro/x1", "Lista de PREȚURI"), ("https://b.ro/tarife#sus", "comisioane de cont")], "url string, text string")
    hosts = spark.createDataFrame([("b", "www.b.ro")], "owner string, host string")
    verdicts = findings.publication_pages(links, hosts, pages)
    got = {(r["url"].rsplit("/", 1)[-1], r["points"], r["verdict"]) for r in verdicts.collect()}
    assert got == {("documente", 3, "nu_mentioneaza"), ("x1", 2, "confirmat"), ("tarife", 3, "confirmat"), ("pricing", 1, "necitita")}
    assert [tuple(r) for r in findings.best_publication_page(verdicts).collect()] == [("b", "https://b.ro/tarife")]


def test_applications_are_matched_with_their_signs(spark):
    banks = [("bt", "Banca Transilvania", ["https://www.bancatransilvania.ro"]), ("tbi", "TBI Bank", ["https://tbibank.ro"]), ("revolut", "Revolut", ["https://www.revolut.com"]), ("pko", "PKO Bank Polski", ["https://pkobp.pl"]), ("none", "Nimic Bank", None)]
    results = [
        ("bt", 1, "g", "Alt SRL", "ro.alt", "Jocuri Transilvania", [7000], ["RO"]), ("bt", 2, "a", "Banca Transilvania S.A.", "com.x", "BT Pay", [6015, 1], ["EN"]), ("bt", 3, "b", "X", "ro.bancatransilvania", "Y", [6000], None),
        ("tbi", 1, "c", "Trade Bank of Iraq", "com.tbi.tbibanking", "TBI Banking", [6015], ["AR", "EN"]), ("revolut", 1, "d", "Revolut Ltd", "com.revolut", "Revolut", [6015], ["en", "ro"]),
        ("pko", 1, "e", "PKO", "pl.pko", "IKO polski", [6015], ["PL"]), ("none", 1, "f", None, None, None, None, None),
    ]
    b = spark.createDataFrame(banks, "slug string, name string, domains array<string>")
    r = spark.createDataFrame(results, "slug string, rank int, app_id string, seller string, bundle string, title string, genres array<int>, languages array<string>")
    got = {x["slug"]: tuple(x)[1:] for x in findings.matched_application(r, b).collect()}
    assert got == {
        "bt": ("b", "bancatransilvania", "bundle", "bundle", True), "tbi": ("c", "tbibank", "bundle", None, False), "revolut": ("d", "revolut", "seller", "languages", True), "pko": ("e", "polski", "title", None, False),
    }


def test_nested_regions_read_only_their_leaves(spark, tmp_path):
    surface = "struct<surface:string,times_shown_lower_bound:long,times_shown_upper_bound:long,note:string>"
    kind = f"creative_id string, advertiser struct<name:string,location:string>, region_stats array<struct<region_code:string,first_shown:string,last_shown:string,times_shown_lower_bound:long,times_shown_upper_bound:long,extra:string,surface_serving_stats:struct<surface_serving_stats:array<{surface}>,total:long>>>"
    ro = ("RO", "2026-01-02", "2026-03-04", 5, 9, "x", ([("YOUTUBE", 1, 2, "n"), ("MAPS", None, 3, "n")], 7))
    spark.createDataFrame([("c1", ("A", "B"), [ro, ("DE", "2026-01-01", None, 1, 2, "y", ([], 0))]), ("c2", None, None)], kind).write.parquet(str(tmp_path / "t"))
    found = readers.region_stats(spark, str(tmp_path / "t"), "RO")
    assert [tuple(r) for r in found.collect()] == [("c1", "RO", datetime.date(2026, 1, 2), datetime.date(2026, 3, 4), 5, 9, 2, "MAPS:-3;YOUTUBE:1-2")]
    schema = found._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert "region_code" in schema and "advertiser" not in schema and "extra" not in schema and "total" not in schema


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_history_goes_on_after_a_restart_and_forgets(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    day = lambda d, h=0: datetime.datetime(2026, 1, d, h)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "bank string, rate string, ts timestamp"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = history.value_history(stream, "5 days", "1 day", "bank", "rate").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted((r["key"], r["event"], r["value"], r["first_seen"].day, r["last_seen"].day, r["sightings"]) for r in spark.read.parquet(out).collect())

    try:
        first = run([("b", "5", day(1)), ("b", "5", day(2)), ("b", "6", day(3)), ("c", "1", day(3)), ("c", None, day(3))])
        assert first == [("b", "began", "5", 1, 1, 1), ("b", "began", "6", 3, 3, 1), ("b", "replaced", "5", 1, 2, 2), ("c", "began", "1", 3, 3, 1)]
        second = run([("b", "6", day(4)), ("b", "5", day(2, 5)), ("d", "9", day(20))])
        assert set(second) - set(first) >= {("d", "began", "9", 20, 20, 1)} and not [r for r in second if r[0] == "b" and r[1] == "began" and r[3] == 2]
        third = run([("d", "9", day(21))])
        assert ("c", "silent", "1", 3, 3, 1) in third and ("b", "silent", "6", 3, 4, 2) in third and len(third) == len(set(third))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
