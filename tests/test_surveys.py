"""Small operators of the survey pages: running maxima, pages, samples, flags, campaigns by address, repeated ranges, verdicts with year typos, folders."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quotelake import storage
from quotelake.functions import arrays, text
from quotelake.operators import campaigns, discovery, joins, normalise, scans, summaries
from quotelake.sources import readers


@pytest.mark.parametrize("segment", [1, 4, 1000])
def test_running_max_equals_a_plain_walk(spark, segment):
    rng = random.Random(segment)
    rows = [(k, i, rng.randrange(100) if rng.random() < 0.7 else None) for k in ("a", "b", None) for i in range(40)]
    frame = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    got = {(r["k"], r["at"]): r["m"] for r in scans.running_max(frame, ["k"], "at", {"m": F.col("v")}, segment).collect()}
    for k in ("a", "b", None):
        best = None
        for _, i, v in [r for r in rows if r[0] == k]:
            assert got[k, i] == best
            best = v if best is None else best if v is None else max(best, v)
    assert scans.running_max(frame.limit(0), ["k"], "at", {"m": F.col("v")}).collect() == []


def test_pages_have_their_total_and_natural_order(spark):
    frame = spark.createDataFrame([("10",), ("9",), ("b",), ("a",), (None,), (" ",), ("1.5",)], "v string")
    page = summaries.page_with_total(frame, [*summaries.natural_order(F.col("v")), F.col("v")], 4, 1).collect()
    assert [r["v"] for r in page] == ["9", "10", "a", "b"] and {r["total"] for r in page} == {7}
    down = frame.orderBy(*summaries.natural_order(F.col("v"), descending=True)).collect()
    assert [r["v"] for r in down[:2]] == ["b", "a"] and [r["v"] for r in down[2:5]] == ["10", "9", "1.5"]


def test_samples_are_topped_up(spark):
    frame = spark.createDataFrame([("x", "one" if i < 18 else f"b{i}", i) for i in range(20)] + [("y", "one", 100)], "kind string, bank string, id int")
    plain, topped = ({k: [r["bank"] for r in rows if r["kind"] == k] for k in ("x", "y")} for rows in (summaries.sample_by_quota(frame, "kind", 8, "id", "bank", 3, top_up=t).collect() for t in (False, True)))
    assert len(plain["x"]) == 5 and len(topped["x"]) == 8 and topped["x"].count("one") == 6 and topped["y"] == ["one"]


def test_firsts_and_flags(spark):
    frame = spark.createDataFrame([("a", 2, True), ("a", 1, None), (None, 5, True), (None, 4, False), ("b", 3, None)], "k string, at int, f boolean")
    assert {(r["k"], r["at"]) for r in summaries.first_of_each(frame, ["k"], F.col("at")).collect()} == {("a", 1), (None, 4), ("b", 3)}
    assert {(r["k"], r["any"]) for r in summaries.any_in_group(frame, ["k"], {"any": F.col("f")}).collect()} == {("a", True), (None, True), ("b", False)}


def test_campaigns_by_address(spark):
    urls = {
        "https://b.ro/doc/Regulament%20campanie.pdf": "regulament", "https://b.ro/plata-in-rate/regulament": None, "https://promo.b.ro/carduri": None, "https://b.ro/promo/x": "campanie", "https://b.ro/promos/x": None,
        "https://b.ro/castigatori": None, "https://b.ro/castiga": "campanie", "https://b.ro/bonus-50": "campanie", "https://b.ro/%2520campanii": "campanie", "https://b.ro/credite": None, None: None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", discovery.campaign_kind(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in rows} == urls


def test_a_repeated_range_is_judged_by_each_of_its_places(spark):
    span = "01.03.2026 - 31.03.2026"
    texts = [f"La ghișeu {span}. " + "Fără rost. " * 20 + f"Perioada campaniei: {span}.", f"La ghișeu {span}.", f"Perioada campaniei: {span}."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(campaigns.period(F.col("t")).alias("p")).collect()
    assert [r["p"]["anchored"] for r in got] == [True, False, True] and {str(r["p"]["start"]) for r in got} == {"2026-03-01"}
    places = spark.createDataFrame([("ab ab xab",)], "t string").select(text.located(F.col("t"), "ab").alias("l")).first()["l"]
    assert [(p["found"], p["at"]) for p in places] == [("ab", 1), ("ab", 4), ("ab", 8)]


def test_a_wrong_year_beside_the_value_in_force(spark):
    day = lambda *a: datetime.date(*a)
    index = spark.createDataFrame([("ircc_valoare", 5.56, day(2026, 7, 1), day(2026, 9, 30)), ("ircc_valoare", 5.58, day(2025, 7, 1), day(2025, 9, 30))], "kind string, value double, valid_from date, valid_to date")
    rates = [("a", 5.56, day(2025, 9, 30)), ("b", 5.58, day(2025, 9, 30)), ("c", 5.56, None), ("d", 5.56, day(2024, 9, 30))]
    frame = spark.createDataFrame([(i, "ircc_valoare", v, e) for i, v, e in rates], "id string, kind string, value double, period_end date")
    got = {r["id"]: (r["verdict"], r["why"]) for r in normalise.validate(frame, index, F.lit("2026-09-16").cast("date"), year_typos=True).collect()}
    assert got == {"a": ("VALID", "year_typo"), "b": ("SURSA_VECHE", "period_over"), "c": ("VALID", None), "d": ("VALID", "year_typo")}
    assert {r["why"] for r in normalise.validate(frame.where("id = 'a'"), index, F.lit("2026-09-16").cast("date")).collect()} == {"period_over"}


def test_the_newest_folder_must_be_whole(spark):
    files = ["o/g_2026-01-01/a.csv", "o/g_2026-01-01/m.csv", "o/g_2026-02-01/a1.csv", "o/g_2026-02-01/a2.csv", "o/g_2026-02-01/m.csv", "o/g_2026-03-01/a.csv"]
    frame = spark.createDataFrame([(f,) for f in files], "path string")
    assert {tuple(r) for r in readers.newest_complete(frame, {"ads": "^a", "map": "^m"}).collect()} == {("ads", "o/g_2026-02-01/a2.csv"), ("map", "o/g_2026-02-01/m.csv")}
    assert readers.newest_complete(frame.where("path like '%2026-03%'"), {"ads": "^a", "map": "^m"}).collect() == []


def test_names_labels_and_bindings(spark):
    frame = spark.createDataFrame([("BRD — Groupe", "comision_max"), ("X N.V. Y", "a_b"), (None, None)], "n string, f string")
    got = frame.select(text.short_name(F.col("n")).alias("s"), text.field_label(F.col("f"), {"comision": "Comision"}, {"max": "maxim"}).alias("l"), arrays.let(F.upper("n"), lambda x: F.concat(x, x)).alias("t")).collect()
    assert [tuple(r) for r in got] == [("BRD", "Comision · maxim", "BRD — GROUPEBRD — GROUPE"), ("X", "a b", "X N.V. YX N.V. Y"), (None, None, None)]


def test_levels_are_cut(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(3, 0)], "src int, dst int")
    reached = joins.reachable(links, spark.createDataFrame([(0,)], "node int"), 4)
    assert {tuple(r) for r in reached.collect()} == {(k, k) for k in range(5)}
    assert storage.cut(links).collect() == links.collect() or sorted(storage.cut(links).collect()) == sorted(links.collect())
    assert storage.folder(spark, "x").startswith("file:") and storage.folder(spark, "x") != storage.folder(spark, "x")
