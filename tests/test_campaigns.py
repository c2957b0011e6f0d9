"""Campaigns, dated documents, concepts, places and responses: golden cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from quotelake.functions import dates
from quotelake.operators import campaigns, extract, normalise
from quotelake.plans import labels

D = datetime.date


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_periods(spark):
    p = campaigns.period(F.col("s"))
    cases = {
        "Campania se desfasoara in perioada 01.07.2026 - 30.09.2026.": (D(2026, 7, 1), D(2026, 9, 30), True),
        "Oferta valabila intre 1 si 31 august 2026.": (D(2026, 8, 1), D(2026, 8, 31), True),
        "Campania: 1 - 31 august 2026": (D(2026, 8, 1), D(2026, 8, 31), True),
        "in perioada 01.07 - 30.09.2026": (D(2026, 7, 1), D(2026, 9, 30), True),
        "Promoția e valabilă în perioada 15 decembrie – 15 ianuarie 2027": (D(2026, 12, 15), D(2027, 1, 15), True),
        "Oferta valabila pana la 31.05.2018.": (None, D(2018, 5, 31), True),
        "contract nr. 2177 din 05.01.2017 - 30.03.2018": (D(2017, 1, 5), D(2018, 3, 30), False),
        "in perioada 15.09.2026 ora 00:00 AM – 31.12.2026": (D(2026, 9, 15), D(2026, 12, 31), True),
        "conform art. 8.1 si 8.2 de mai sus": (None, None, None),
        "Oferta ING. Exemplul este valabil pana la 31.07.2026.": (None, None, None),
    }
    assert values(spark, [(c,) for c in cases], "s string", p["start"], p["end"], p["anchored"]) == list(cases.values())
    u = campaigns.period_in_url(F.col("s"))
    assert values(spark, [("https://x.ro/wp-content/uploads/2026/08/Regulament-12-rate-09.07-30.09.pdf",), (None,)], "s string", u["end"], u["year_deduced"]) == [(D(2026, 9, 30), True), (None, None)]
    label = campaigns.period(F.col("s"), label=True)
    rows = [("Campanie Cafeaua BOILER - 27 septembrie 2025",), ("Cursa Plăților – 15-17 Octombrie 2025",)]
    assert values(spark, rows, "s string", label["start"], label["end"], label["one_day"]) == [(D(2025, 9, 27), D(2025, 9, 27), True), (D(2025, 10, 15), D(2025, 10, 17), False)]


def test_words_of_campaigns(spark):
    rows = [("In cazul in care Organizatorul va decide modificarea duratei, se va incheia un act aditional",), ("ACTUL ADITIONAL NR. 1 la Regulamentul campaniei",), ("Se prelungeste durata Programului pana la 31 Octombrie 2026",), (None,)]
    assert values(spark, rows, "s string", campaigns.has_added_act(F.col("s"))) == [(False,), (True,), (True,), (False,)]
    rows = [("Premieră în bankingul românesc",), ("Câștigătorii au fost anunțați",), ("O nouă campanie de phishing vizează clienții",), ("Câștigă 500 lei cu cardul",), (None,)]
    assert values(spark, rows, "s string", campaigns.press_word(F.col("s"))) == [(None,), (None,), (None,), ("castiga",), (None,)]
    rows = [("Salut. Primesti 500 lei bonus la deschidere! Restul.", None), ("Capital social 1000 lei, bonus.", None), ("nimic aici de citit.", "Cashback 5% la cumparaturi"), (None, None)]
    assert values(spark, rows, "s string, h string", campaigns.benefit(F.col("s"), F.col("h"))) == [("Primesti 500 lei bonus la deschidere!",), (None,), ("Cashback 5% la cumparaturi",), (None,)]
    rows = [("Concurs. Organizatorul „Câștigă cu Mastercard” este Raiffeisen Bank S.A. cu Visa",), ("Organizatorul este Mastercard Europe SA",), ("Organizator: Acme SRL",), ("nimic",)]
    assert values(spark, rows, "s string", campaigns.organiser(F.col("s"), banks=["raiffeisen bank"])) == [("banca",), ("schema_card",), ("partener",), (None,)]
    rows = [("https://b.ro/imm/x", None), ("https://b.ro/persoane-fizice/imm-x", "Firme"), ("https://b.ro/x", "Oferta pentru companii"), ("https://b.ro/x", None)]
    assert values(spark, rows, "u string, t string", campaigns.segment(F.col("u"), F.col("t"))) == [("PJ",), (None,), ("PJ",), (None,)]
    assert values(spark, [("perioada nedeterminata",), ("30 zile",)], "s string", campaigns.is_open_ended(F.col("s"))) == [(True,), (False,)]
    assert values(spark, [("https://b.ro/2026/09/25/x",), ("https://b.ro/20260921-reg.pdf",), ("https://b.ro/x",)], "s string", campaigns.date_in_url(F.col("s"))) == [(D(2026, 9, 25),), (D(2026, 9, 21),), (None,)]


def test_candidates_and_press_items(spark):
    page = "https://b.ro/campanii"
    rows = [("https://b.ro/campanii/vara", "x"), ("https://b.ro/carduri", "Cashback 5%"), ("https://b.ro/credite", "Credite"), ("https://b.ro/doc/regulament-vara.pdf", "Regulament"), ("https://b.ro/doc/act-aditional-1.pdf", None),
            ("https://b.ro/doc/tarife.pdf", "Tarife"), ("https://b.ro/promotii", "Lista"), ("https://c.ro/campanii/x", "y"), ("https://www.b.ro/a.png", "campanie"), (page, "campanii")]
    links = spark.createDataFrame([(page, u, t) for u, t in rows], "page_url string, url string, text string")
    got = {r["url"]: r["role"] for r in campaigns.candidates(links, ["b.ro"]).collect()}
    assert got == {"https://b.ro/campanii/vara": "landing", "https://b.ro/carduri": "landing", "https://b.ro/doc/regulament-vara.pdf": "regulament", "https://b.ro/doc/act-aditional-1.pdf": "act_aditional", "https://b.ro/promotii": "lista"}
    members = [("a", "a", None, None), ("a", "r.pdf", None, "h"), ("r.pdf", "r.pdf", "label", None), ("s.pdf", "s.pdf", None, None)]
    got = campaigns.unified(spark.createDataFrame(members, "campaign string, url string, label string, hub string")).collect()
    assert sorted((r["campaign"], r["url"]) for r in got) == [("a", "a"), ("a", "r.pdf"), ("a", "r.pdf"), ("s.pdf", "s.pdf")]
    press = [("https://b.ro/2026/09/25/stire", "Un titlu destul de lung"), ("https://b.ro/2026/09/25/stire", "Un titlu si mai lung decat primul"), ("https://b.ro/x?page=2", "Pagina urmatoare a listei"), ("https://b.ro/y", "scurt")]
    got = campaigns.press_items(spark.createDataFrame([("https://b.ro/presa", u, t) for u, t in press], "page_url string, url string, text string")).collect()
    assert [(r["title"], r["published"]) for r in got] == [("Un titlu si mai lung decat primul", D(2026, 9, 25))]


def test_dates_of_documents(spark):
    t = dates.date_in_text(F.col("s"), F.lit(D(2026, 9, 24)))
    cases = {
        "Tarife în vigoare începând cu data de 21.09.2026": (D(2026, 9, 21), "day", "vigoare"), "valabil pana la 30.09.2026": (None, None, None), "Actualizat la 3 mai 2025; valabil din 01 octombrie 2026": (D(2026, 10, 1), "day", "valabil"),
        "Data: 2026-02-03": (D(2026, 2, 3), "day", "camp_data"), "versiunea 3/ sep. 2025": (D(2025, 9, 1), "month", "versiune"), "in vigoare din 01.01.1999": (None, None, None), "x" * 1300 + " in vigoare din 01.01.2026": (None, None, None),
    }
    assert values(spark, [(c,) for c in cases], "s string", t["date"], t["precision"], t["anchor"]) == list(cases.values())
    n = dates.date_in_name(F.col("s"))
    names = {"BCR_Tarife_1-iulie-2026.pdf": (D(2026, 7, 1), "day"), "12345678_lista_15-iulie-2026.pdf": (D(2026, 7, 15), "day"), "x_2025.pdf": (None, None), "lista 20260901.pdf": (D(2026, 9, 1), "day"), "tarife oct.2024.pdf": (D(2024, 10, 1), "month")}
    assert values(spark, [(c,) for c in names], "s string", n["date"], n["precision"]) == list(names.values())
    assert values(spark, [("Wed, 16 Sep 2026 10:00:00 GMT",), ("soon",)], "s string", dates.header_date(F.col("s"))) == [(D(2026, 9, 16),), (None,)]
    assert values(spark, [(D(2026, 9, 16), D(2026, 9, 1), "month"), (D(2026, 9, 16), D(2026, 9, 1), "day")], "m date, n date, p string", dates.agrees_with_name(F.col("m"), F.col("n"), F.col("p"))) == [(True,), (False,)]


@pytest.mark.parametrize(
    "service,section,want",
    [
        ("Taxa recuperare card reținut de ATM", "", "recuperare_card"), ("Contestare nejustificată a unei tranzacții", "", "refuz_plata"), ("- la ghișeu", "CARDURI > Retragere numerar", "retragere_numerar"),
        ("Plăți - alte conturi", "Standing order (plată programată)", "plata_programata"), ("George, conţinând: - administrarea Cont curent; - furnizarea unui Card", "", "administrare_cont"),
        ("Administrare cont de plăţi", "", "administrare_cont"), ("* vezi anexa", "PLATI > Plăți", None), ("varianta standard", "PLATI > Emitere card", "emitere_card"), (None, None, None),
    ],
)
def test_concepts(spark, service, section, want):
    frame = spark.createDataFrame([(service, section)], "a string, b string")
    none = F.lit(None).cast("string")
    got = frame.select(normalise.service_concept(F.col("a"), F.col("b"), none, none, none)).first()[0]
    assert got == want


def test_responses(spark):
    real = "<main>" + "Depozite la termen, dobânzi și comisioane. " * 60 + '<script src="https://www.google.com/recaptcha/api.js"></script></main>'
    rows = [(s, "text/html", "x") for s in (401, 403, 407, 429, 451)]
    rows += [(200, "text/html", "<html><title>Access Denied</title>Reference #18.2f</html>"), (200, "text/html", real), (503, "text/html", "Just a moment..."), (503, "text/html", "maintenance"), (404, "text/html", ""), (200, "application/pdf", "%PDF-1.7 ..."),
             (200, "text/html", '<html><body><div id="root"></div>' + "<script></script>" * 3), (200, "text/html", "<main>" + "Depozit la termen 12 luni 5,5% " * 40), (200, "text/html", "HTTP/1.0 302 Found\r\nLocation: x"), (None, None, None)]
    got = [r[0] for r in values(spark, rows, "s int, t string, b string", extract.response_class(F.col("s"), F.col("t"), F.col("b")))]
    assert got == ["BLOCAT"] * 5 + ["BLOCAT", "OK", "BLOCAT", "REINCEARCA", "DISPARUT", "OK", "JS", "OK", "REDIRECT_SERIALIZAT", "REINCEARCA"]


def test_places_of_two_banks_and_attributes(spark):
    pages = [(1, '{"lat": 44.4, "lng": 26.1, "name": "A", "type": "agency,atm"}{"lat": 44.4, "lng": 26.1, "type": "ATM", "name": "Euronet"}'), (2, '<div class="atm" data-lat="45.1" data-lon="25.2">Bancomat Centru</div>{"lat": 44.4, "lng": 26.1, "type": "ATM"}'), (3, None)]
    got = extract.extract_points(spark.createDataFrame(pages, "id int, html string")).select("id", "kind", "lat", "network").collect()
    assert sorted(tuple(r) for r in got) == [(1, "atm", 44.4, "partener"), (1, "branch", 44.4, "proprie"), (2, "atm", 44.4, "proprie"), (2, "atm", 45.1, "proprie")]


def test_index_values_in_brackets(spark):
    frame = spark.createDataFrame([(1, "Indice de referință IRCC trimestrial (5,56%) + 4,77% marjă fixă"), (2, "4.50% % + IRCC (10.18%)")], "n int, line string")
    got = sorted((r["n"], r["kind"], r["value"]) for r in extract.extract_rates(frame).collect())
    assert got == [(1, "ircc_valoare", 5.56), (1, "marja_fixa", 4.77), (2, "marja_ircc", 4.5)]


def test_concepts_of_a_small_file_are_dealt_to_all_cores(spark, small):
    """The part table is one small file, but each label is asked for many patterns (F13)."""
    assert labels.d01_concept_levels(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_campaign_texts_are_dealt_to_all_cores_and_read_the_same_when_flat(spark, small):
    """The orders are one small file (F11); a text that is flat already gives what the text itself gives."""
    assert labels.ext13_ext16_campaign_texts(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    words = ["Perioada campaniei: 1.02.2030 – 3 martie 2030. Organizator: Acme SRL", "ACTUL ADIȚIONAL NR. 1 la Regulament, perioadă nedeterminată", "", None]
    both = lambda whole, in_flat: (whole(F.col("w")).alias("a"), in_flat(campaigns.flat(F.col("w"))).alias("b"))
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    for pair in ((campaigns.period, campaigns.period_in), (campaigns.organiser, campaigns.organiser_in), (campaigns.has_added_act, campaigns.has_added_act_in), (campaigns.is_open_ended, campaigns.is_open_ended_in)):
        rows = frame.select(*both(*pair)).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows] and any(rows[i]["a"] for i in (0, 1))
