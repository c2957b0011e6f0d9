"""The query surface on a small market."""

import datetime

import pytest
from pyspark.sql import functions as F

from quotelake import schemas
from quotelake.plans import market

D = datetime.date


@pytest.fixture(scope="module")
def obs(spark):
    names = [c.split()[0] for c in schemas.OBSERVATION.split(", ")]
    base = dict.fromkeys(names) | {"banca": "a", "camp": "administrare_cont", "unitate": "lei", "ambiguu": False, "confidence": 0.9, "id_sursa": 1, "stare_data": "IN_VIGOARE"}
    rows = [
        {"valoare_num": 5.0, "serviciu": "cont", "cod_scenariu": "conturi|pf", "data_vigoare": D(2026, 7, 1), "citat": "cost 5 lei"},
        {"valoare_num": 7.0, "serviciu": "cont", "cod_scenariu": "conturi|pf", "data_vigoare": D(2026, 8, 1), "citat": "7 lei"},
        {"valoare_num": 9.0, "serviciu": "cont imm", "cod_scenariu": "conturi|pj"},
        {"valoare_num": 50_000.0, "serviciu": "prag", "citat": "peste 50.000 lei"},
        {"banca": "b", "valoare_num": 3.0, "serviciu": "x", "ambiguu": True, "citat": "3"},
        {"banca": "b", "valoare_num": 4.0, "serviciu": "x"},
        {"banca": "b", "camp": "nominala", "unitate": "procent", "valoare_num": 6.0, "cod_scenariu": "depozite|pf", "serviciu": "Depozit 12 luni"},
        {"banca": "b", "camp": "nominala", "unitate": "procent", "valoare_num": 45.0, "cod_scenariu": "depozite|pf", "serviciu": "Depozit 6 luni", "confidence": 0.5},
    ]
    from decimal import Decimal

    full = [base | {"id": i} | r for i, r in enumerate(rows)]
    for r in full:
        r["valoare_num"] = Decimal(str(r["valoare_num"]))
        r["confidence"] = Decimal(str(r["confidence"]))
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schemas.OBSERVATION).cache()


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_matrix(obs):
    cells = market.price_matrix(obs, ["administrare_cont"], segment="pf")
    assert got(cells, "banca", "value", "n", "implausible") == [("a", 5.0, 2, 1), ("b", 4.0, 1, 0)]
    assert got(market.ambiguous_left_out(obs, ["administrare_cont"]), "banca", "n") == [("b", 1)]


def test_rates_and_facets(obs):
    assert got(market.rates(obs, "depozite"), "banca", "value", "months", "implausible") == [("b", 6.0, 12, 1)]
    assert market.rates(obs, "depozite", term="1-3").count() == 0
    assert dict(got(market.term_facets(obs, "depozite"), "option", "n")) == {"1-3": 0, "4-6": 1, "7-12": 1, ">12": 0, "unknown": 0}


def test_history_and_queue(obs):
    assert got(market.history(obs), "banca", "old_value", "valoare", "percent") == [("a", 5.0, 7.0, 40.0)]
    assert got(market.review_queue(obs), "id", "motive") == [(3, "suma_mare"), (7, "procent_mare")]
    groups = got(market.queue_groups(obs), "banca", "camp", "n")
    assert groups == [("a", "administrare_cont", 1), ("b", "nominala", 1)]


def test_lists(spark, obs):
    banks = spark.createDataFrame([(1, "a", "A", "1", "r", True, None, None), (2, "b", "B", "1", "r", True, None, None), (3, "c", "C", "1", "r", True, None, None)], schemas.BANK)
    releases = spark.createDataFrame([("a", 4.0), ("a", 5.0)], "banca string, rating double")
    assert got(market.bank_list(banks, obs, releases), "banca", "observations", "apps", "rating") == [("a", 4, 2, 4.5), ("b", 4, 0, None), ("c", 0, 0, None)]
    sources = spark.createDataFrame([(1, "http://a/x.pdf", None, "note: more"), (2, "http://a/y", datetime.datetime(2026, 1, 1), None), (3, "http://a/z", None, None)], "id long, sursa string, ultima_rulare timestamp, nota_extractie string")
    assert got(market.source_list(sources, obs), "id", "state", "note", "file") == [(1, "has_data", "note", "x.pdf"), (2, "tried", "", "y"), (3, "untouched", "", "z")]
    evidence = market.cell(obs, sources.withColumn("url_public", F.lit(None).cast("string")), "a", "administrare_cont").first()
    assert (evidence["evidence"], evidence["link"]) == ("link", "http://a/x.pdf")
    locations = spark.createDataFrame([("a", "atm", "own", 44.4, 26.1, 4.5), ("a", "atm", "own", 10.0, 26.1, None)], "banca string, tip string, retea string, lat double, lon double, rating double")
    assert got(market.locations_summary(locations), "tip", "n", "rating", "inside") == [("atm", 2, 4.5, 1)]
    cover = market.coverage(banks, sources.withColumn("banca", F.lit("a")), obs, locations)
    assert got(cover, "banca", "sources", "run", "observations", "locations") == [("a", 3, 1, 4, 2), ("b", 0, 0, 4, 0), ("c", 0, 0, 0, 0)]
    assert dict(got(market.summary(obs, sources, banks), "metric", "n"))["ambiguous"] == 1
    assert got(market.observations(obs, words="COST"), "id") == [(0,)] and market.observations(obs).count() == 8


def test_small_questions(spark):
    reviews = spark.createDataFrame([("a", 5, D(2026, 1, 1)), ("a", 1, D(2026, 2, 1)), ("a", 4, D(2026, 1, 5))], "banca string, stars int, posted date")
    assert got(market.sentiment(reviews), "n", "mean", "good", "bad", "newest") == [(3, 3.33, 66.7, 33.3, D(2026, 2, 1))]
    index = spark.createDataFrame([("robor", "3M", 5.9, D(2026, 9, 1), None), ("robor", "6M", 6.0, D(2026, 9, 1), D(2026, 9, 10))], "indice string, scadenta string, valoare double, valabil_din date, valabil_pana date")
    assert got(market.index_now(index, F.lit(D(2026, 9, 20))), "scadenta") == [("3M",)]
    assert got(market.index_series(index, ["3M", "6M"]), "indice", "3M", "6M") == [("robor", 5.9, 6.0)]
    assert got(market.networks(spark.createDataFrame([("a", "x", "@a")], "banca string, retea string, cont string"), ["x", "y"]), "banca", "x", "y") == [("a", "@a", "NEGASIT")]
    runs = spark.createDataFrame([("c", "a", 10.0, True), ("c", "a", 30.0, True), ("c", "b", 1.0, False), ("d", "a", 1.0, False)], "command string, bank string, seconds double, ok boolean")
    assert got(market.run_estimate(runs, 7.0), "command", "bank", "seconds") == [("c", "a", 20.0), ("c", "b", 20.0), ("d", "a", 7.0)]
