"""Golden cases of extraction, normalisation and validation."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotelake import schemas
from quotelake.functions import dates, html, numbers, text
from quotelake.functions import vocabulary as V
from quotelake.operators import extract, normalise
from quotelake.plans import pages


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def rates(spark, line):
    frame = spark.createDataFrame([(line,)], "line string")
    return [(r["kind"], r["value"], r["instalments"]) for r in extract.extract_rates(frame).collect()]


@pytest.mark.parametrize(
    "line,want",
    [
        ("DAE 4\t8,91%\t8,04%\t6,96%\t5,49%", [("dae", 8.91, None), ("dae", 8.04, None), ("dae", 6.96, None), ("dae", 5.49, None)]),
        ("EURIBOR 6 Luni + Marjă Fixă** 5,2 p.p.\tFIXĂ 3 ani 6% pe an", [("marja_euribor", 5.2, None)]),
        ("Ai până la 12 rate cu 0% dobândă", [("rate_fara_dobanda", 0.0, 12)]),
        ("4.50% % + IRCC (10.18%)", [("marja_ircc", 4.5, None)]),
        ("Avans minim 15% din preț", []),
        ("Dobândă fixă 5,99% pe an, comision de analiză 1%", [("comision_procent", 1.0, None), ("nominala", 5.99, None)]),
        ("IRCC valabil la data: 5.56%", [("ircc_valoare", 5.56, None)]),
        ("fără cifre", []),
        (None, []),
    ],
)
def test_rates(spark, line, want):
    assert rates(spark, line) == want


def test_rate_interval_and_currency(spark):
    frame = spark.createDataFrame([("Dobândă între 5,99% - 15,99% în lei pe 5 ani",)], "line string")
    r = extract.extract_rates(frame).first()
    assert (r["low"], r["high"], r["currency"], r["period"], r["plausible"]) == (5.99, 15.99, "LEI", "pe 5 ani", True)


def test_fees(spark):
    frame = spark.createDataFrame([(1, "Retragere 0,5% min 10 lei"), (2, "Administrare cont 12 lei/lună"), (3, "Interogare sold gratuit"), (4, "Transfer peste 1.000 lei: 5 EUR")], "n int, line string")
    got = {}
    for r in extract.extract_fees(frame).collect():
        got.setdefault(r["n"], []).append((r["kind"], r["value"], r["currency"], r["role"], r["frequency"], r["band"]))
    assert got[1] == [("comision_procent", 0.5, None, None, None, None), ("comision_suma", 10.0, "LEI", "min", None, None)]
    assert got[2] == [("comision_suma", 12.0, "LEI", None, "lunar", None)]
    assert got[3] == [("gratuit", 0.0, None, None, None, None)]
    assert got[4] == [("comision_suma", 5.0, "EUR", None, None, "peste 1.000 lei")]


def test_numbers(spark):
    rows = [("2,568", True, 2.568), ("20,000", False, 20000.0), ("5,84", True, 5.84), ("1.234,56", False, 1234.56), ("1,234.56", False, 1234.56), ("1.234.567", False, 1234567.0), ("150,000", True, 150000.0), ("x", False, None), ("", True, None), (None, True, None)]
    frame = spark.createDataFrame(rows, "s string, p boolean, want double")
    got = frame.select(F.when(F.col("p"), numbers.decimal_number(F.col("s"), True)).otherwise(numbers.decimal_number(F.col("s"))).alias("v"), "want").collect()
    assert [r["v"] for r in got] == [r["want"] for r in got]
    assert values(spark, [("0,0125%",), ("comision 1500%",), ("19 %",)], "s string", numbers.percent(F.col("s"))) == [("0,0125",), (None,), ("19",)]
    assert values(spark, [("9.06% (IRCC + 3.5%)",), ("3% + IRCC (8.68%)",), ("fixă apoi variabilă",)], "s string", numbers.implied_index(F.col("s"))) == [(5.56,), (5.68,), (None,)]
    assert values(spark, [("1K-5K",), ("2.5M",), ("300",)], "s string", numbers.shorthand(F.col("s"))) == [(1000.0,), (2.5e6,), (300.0,)]


def test_dates(spark):
    first, last = dates.quarter_interval(F.col("s"))
    d = datetime.date
    assert values(spark, [("2026T1",), ("2025T4",), ("x",)], "s string", first, last) == [(d(2026, 7, 1), d(2026, 9, 30)), (d(2026, 4, 1), d(2026, 6, 30)), (None, None)]
    period = dates.validity_period(F.col("s"))
    assert values(spark, [("01.07 - 30.09.2026",), ("valabil de la 01.07.2026",), ("nimic",)], "s string", period["start"], period["end"]) == [(d(2026, 7, 1), d(2026, 9, 30)), (d(2026, 7, 1), None), (None, None)]
    assert values(spark, [("PT1H2M3S",), ("PT45S",), ("x",), ("PT",)], "s string", dates.iso_duration(F.col("s"))) == [(3723,), (45,), (None,), (None,)]
    assert values(spark, [(3723,), (45,)], "s long", dates.clock(F.col("s"))) == [("1:02:03",), ("0:45",)]
    assert values(spark, [("90 zile",), ("12 luni",), ("2 ani",), ("un an",), ("10 zile",), ("mereu",)], "s string", dates.term_months(F.col("s"))) == [(3,), (12,), (24,), (12,), (1,), (None,)]
    named = dates.date_in_name(F.col("s"))
    assert values(spark, [("tarife_01.07.2026.pdf",), ("tarife-2026-07-15.pdf",), ("lista_15072026.pdf",), ("tarife iulie 2026.pdf",), ("tarife.pdf",)], "s string", named["date"], named["precision"]) == [
        (d(2026, 7, 1), "day"), (d(2026, 7, 15), "day"), (d(2026, 7, 15), "day"), (d(2026, 7, 1), "month"), (None, None),
    ]
    windows = spark.range(1).select(dates.windows_back(F.lit(d(2026, 9, 30)), 70).alias("w")).first()["w"]
    assert [(w["first"], w["last"]) for w in windows] == [(d(2026, 8, 31), d(2026, 9, 30)), (d(2026, 8, 1), d(2026, 8, 31)), (d(2026, 7, 22), d(2026, 8, 1))]


def test_urls_and_names(spark):
    assert values(spark, [("https://X.ro/p?utm_source=fb&id=3&gclid=abc#top",), ("http://a.ro/x/",), ("http://a.ro/x?gclid=1",)], "u string", text.canonical_url(F.col("u"))) == [("https://x.ro/p?id=3#top",), ("http://a.ro/x",), ("http://a.ro/x",)]
    assert values(spark, [("a%2520b+c",), ("100%",), (None,)], "u string", text.decoded(F.col("u"))) == [("a b+c",), ("100%",), (None,)]
    assert values(spark, [("Tarife_si_Comisioane_PJ.pdf",), ("lista-tarife-persoane-fizice.pdf",), ("document.pdf",)], "u string", normalise.name_segment(F.col("u"))) == [("pj",), ("pf",), (None,)]
    families = values(spark, [("https://b.ro/tarife_PF_iulie_2026.pdf",), ("tarife_pf_01.09.2026.pdf",), ("Tarife-PF-v2.pdf",)], "u string", text.family_key(F.col("u")))
    assert {f[0] for f in families} == {"tarife_pf"}
    assert values(spark, [("http://a/x.pdf", 3, "doar   atât"), ("http://a/x#y", None, "p q"), ("http://a/x#y", None, "nine words"), ("http://a/x.pdf", None, "nine words")], "u string, p int, q string", text.anchor(F.col("u"), F.col("p"), F.col("q"))) == [("http://a/x.pdf#page=3&search=doar%20at%C3%A2t",), ("http://a/x",), ("http://a/x#:~:text=nine%20words",), ("http://a/x.pdf",)]
    assert values(spark, [("Com",), ("taxa de",), ("Cost 5 lei pe an",), ("Administrare cont",)], "s string", text.label_faults(F.col("s"))) == [(["too_short"],), (["starts_lower", "ends_with_connector"],), (["holds_price"],), ([],)]


def test_html(spark):
    page = "<html><head><title>Card X | Bank</title><style>a{}</style></head><body><nav>menu</nav><main><h1>Card <b>X</b></h1><table><tr><td>DAE</td><td>8,9 %</td></tr></table><p>Now 12:30, all&nbsp;good &amp; well</p></main><a href='/p?a=1'>more</a><a href='/p?a=1'>m</a><a href='mailto:a@b'>m</a><a href='http://['>bad</a></body></html>"
    frame = spark.createDataFrame([(page, "http://x.ro/a/"), (None, None), ("", "")], "h string, u string")
    rows = frame.select(html.html_lines("h").alias("l"), html.main_text("h").alias("m"), html.page_titles("h").alias("t"), html.page_links("h", "u").alias("k")).collect()
    assert rows[0]["l"][0] == "DAE\t8,9 %" and "menu" not in rows[0]["l"] and "Now 12:30, all good & well" in rows[0]["l"]
    assert rows[0]["t"]["name"] == "Card X" and rows[0]["t"]["title"] == "Card X | Bank"
    assert [(k["url"], k["text"]) for k in rows[0]["k"]] == [("http://x.ro/p?a=1", "more")]
    later = spark.createDataFrame([(page.replace("12:30", "13:45"),), (page.replace("good", "bad"),)], "h string").select(html.main_text("h")["hash"].alias("x")).collect()
    assert later[0]["x"] == rows[0]["m"]["hash"] != later[1]["x"]
    assert rows[1]["l"] == [] and rows[2]["k"] == []


def test_sitemap_points_robots_and_responses(spark):
    got = extract.sitemap_entries(spark.createDataFrame([("<urlset><url><loc> http://a/x?y=1&amp;z=2 </loc><lastmod>2026-01-01</lastmod></url><url><loc>http://b</loc></url></urlset>",)], "body string")).collect()
    assert [tuple(r) for r in got] == [("http://a/x?y=1&z=2", "2026-01-01", False), ("http://b", None, False)]
    js = 'x = [{"lat": 44.4, "lng": 26.1, "name": "A", "type": "ATM"}, {"latitude": "44.4", "longitude": "26.1", "type": "ATM"}, {"lat": 10, "lon": 26}]'
    points = extract.extract_points(spark.createDataFrame([(js,)], "html string")).collect()
    assert [(p["kind"], p["lat"], p["lon"]) for p in points] == [("atm", 44.4, 26.1)]
    rules = [("h", "*", "disallow", "/"), ("h", "bot", "disallow", "/private"), ("h", "bot", "allow", "/private/ok"), ("h", "bot", "disallow", "/*.pdf$"), ("h", "bot", "delay", "5"), ("g", "*", "disallow", "/x")]
    urls = [("h", "/a"), ("h", "/private/x"), ("h", "/private/ok/1"), ("h", "/d/a.pdf"), ("h", "/d/a.pdf?x"), ("g", "/x1"), ("k", "/x")]
    verdict = extract.robots_verdict(spark.createDataFrame(urls, "host string, path string"), spark.createDataFrame(rules, "host string, agent string, kind string, value string"), "Bot")
    assert {(r["host"], r["path"]): (r["allowed"], r["crawl_delay"]) for r in verdict.collect()} == {
        ("h", "/a"): (True, 5.0), ("h", "/private/x"): (False, 5.0), ("h", "/private/ok/1"): (True, 5.0), ("h", "/d/a.pdf"): (False, 5.0), ("h", "/d/a.pdf?x"): (True, 5.0), ("g", "/x1"): (False, None), ("k", "/x"): (True, None),
    }
    shell = '<html><div id="root"></div><script>' + "x" * 500 + "</script></html>"
    rows = [(200, "text/html", "<p>" + "words " * 60), (404, None, None), (403, None, ""), (503, None, ""), (None, None, None), (200, "text/html", shell), (200, "text/html", "Captcha please")]
    assert values(spark, rows, "s int, t string, b string", extract.response_class(F.col("s"), F.col("t"), F.col("b"))) == [("OK",), ("DISPARUT",), ("BLOCAT",), ("REINCEARCA",), ("REINCEARCA",), ("JS",), ("BLOCAT",)]


def test_vocabulary(spark):
    assert values(spark, [("la ghișeu",), ("prin ATM",), ("Internet Banking",), ("altfel",)], "s string", normalise.channel(F.col("s"))) == [("ghiseu",), ("atm",), ("internet_banking",), (None,)]
    rows = [("transfer_credit", "Plati in afara UE", None), ("transfer_credit", "Plati SEPA in UE", None), ("transfer_credit", "intrabancar si interbancar", None), ("emitere_card", "extern", None), ("incasare", "Incasare", "din conturi proprii")]
    assert values(spark, rows, "c string, n string, x string", normalise.destination(F.col("c"), F.col("n"), F.col("x"))) == [("extern",), ("sepa",), (None,), (None,), ("intrabancar",)]
    assert values(spark, [("Credit de nevoi personale cu ipotecă", None), ("x", "depozit la termen")], "t string, p string", normalise.rate_product(F.col("t"), F.col("p"))) == [("credit_nevoi_personale",), ("depozit_termen",)]


def test_concept(spark):
    table = [("retragere", "(?iu)retrager"), ("card", "(?iu)card"), ("cont", "(?iu)cont")]
    rows = [("Retragere cu cardul", "Cont", None), ("pe zi", "Cont > Carduri", None), ("pe zi", "Alta", "cont curent"), ("un nume lung fără sens", "Carduri", "card"), (None, None, None)]
    assert values(spark, rows, "n string, p string, c string", normalise.concept(F.col("n"), F.col("p"), F.col("c"), table)) == [("retragere",), ("card",), ("cont",), (None,), (None,)]


def test_normalise(spark):
    base = dict.fromkeys(f.split()[0] for f in schemas.RAW_RECORD.split(", "))
    rows = [
        base | {"banca": "EximBank", "sursa": "u", "tip": "dae", "categorie": "credite", "valoare": 31.0, "incredere": "ridicata", "segment": "pf", "nr_rate": 12},
        base | {"banca": "a", "sursa": "u", "tip": "comision_suma", "valoare": 5.0, "moneda": "RON", "concept": "incasare", "rol": "min", "incredere": "0.8", "stare_data": "DATA_NECUNOSCUTA"},
        base | {"banca": "a", "sursa": "u"},
    ]
    good, bad = normalise.normalise(spark.createDataFrame([tuple(r.values()) for r in rows], schemas.RAW_RECORD))
    a, b = good.orderBy("valoare_num", ascending=False).collect()
    assert (a["banca"], a["produs"], a["camp"], a["cod_scenariu"], a["unitate"], a["confidence"], a["ambiguu"], a["motiv_ambiguu"]) == ("exim", "dae", "comision", "credite|pf|12", "procent", 0.9, True, "valoare neplauzibila")
    assert (b["camp"], b["unitate"], b["valuta"], b["confidence"], b["ambiguu"], b["cod_scenariu"]) == ("incasare_min", "lei", "RON", 0.7, False, None)
    assert [r["reject_reason"] for r in bad.collect()] == ["no_value"]


def test_validate(spark):
    d = datetime.date
    index = spark.createDataFrame([("ircc_valoare", 5.56, d(2026, 7, 1), d(2026, 9, 30)), ("ircc_valoare", 6.06, d(2026, 4, 1), d(2026, 6, 30))], "kind string, value double, valid_from date, valid_to date")
    rows = [("a", "ircc_valoare", 5.56, None), ("b", "ircc_valoare", 6.06, None), ("c", "ircc_valoare", 4.2, None), ("d", "robor_valoare", 5.9, None), ("e", "nominala", 55.0, None), ("f", "nominala", 5.0, d(2026, 1, 1)), ("g", "dae", 7.0, None)]
    frame = spark.createDataFrame(rows, "banca string, kind string, value double, period_end date")
    got = {r["banca"]: (r["verdict"], r["why"]) for r in normalise.validate(frame, index, F.lit(d(2026, 9, 16))).collect()}
    assert got == {"a": ("VALID", None), "b": ("SURSA_VECHE", "older_quarter"), "c": ("SUSPECT", "far_from_index"), "d": ("NEVERIFICAT", "no_reference"), "e": ("SUSPECT", "outside_interval"), "f": ("SURSA_VECHE", "period_over"), "g": ("VALID", None)}
    totals = normalise.derived_totals(spark.createDataFrame([("a", "marja_ircc", 3.5, None)], frame.schema), index, F.lit(d(2026, 9, 16))).collect()
    assert sorted((r["kind"], r["value"], r["derived"]) for r in totals) == [("marja_ircc", 3.5, False), ("nominala", 9.06, True)]


def test_figure_in_text(spark):
    rows = [(1234.5, "costă 1.234,50 lei"), (5.9, "DAE 5,9%"), (7.0, "doar 6"), (12.0, "12 luni"), (None, "x")]
    assert values(spark, rows, "v double, t string", extract.figure_in_text(F.col("v"), F.col("t"))) == [(True,), (True,), (False,), (True,), (False,)]
    assert V.RATES[0][0] == "ircc_valoare"


def test_rates_of_long_rows(spark):
    line = "dobanda\t" + "\t".join(f"{k / 100 + 1:.2f}%".replace(".", ",") for k in range(130))
    frame = spark.createDataFrame([(line,)], "line string")
    got = frame.select(extract._with_columns(F.col("line"), F.array(extract._rate(F.lit("k"), F.lit(1.0)))).alias("r")).first()["r"]
    assert [round(x["value"], 2) for x in got] == [round(k / 100 + 1, 2) for k in range(130)]


def test_headings_keep_references_that_are_no_escapes(spark, tmp_path):
    """A heading cut within a reference, and quotes written as references, stay as they are written; the operator's own name reads them all."""
    rows = [(1, "<h1>a &amp;&amp</h1>"), (2, "<p>\n\n<h1 id='x'> b &lt;c&gt; &quot;d&quot; </h1></p><h1>e</h1>"), (3, "<p>none</p>"), (4, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.name for r in pages.ext10_page_name(spark, str(tmp_path)).collect()}
    assert got == {1: "a &&amp", 2: "b <c> &quot;d&quot;", 3: "", 4: None}
    read = spark.createDataFrame(rows[:2], "page_id long, html string").select(html.page_titles("html").alias("t")).select("t.name").collect()
    assert [r.name for r in read] == ["a &&", 'b <c> "d" e']


def test_pages_are_handed_on_in_pieces():
    """A batch of large pages isn't held with all its results; rows stay in order, null pages too."""
    bodies = pd.Series([f"<p>{k}</p>" + " " * 400_000 if k % 3 else None for k in range(10)])
    pieces = list(html.html_lines.func(iter([bodies])))
    assert len(pieces) > 2 and [x for p in pieces for x in p] == [[str(k)] if k % 3 else [] for k in range(10)]
    frames = list(html.page_ranges.func(iter([(bodies, bodies)])))
    assert len(frames) == len(pieces) and sum(map(len, frames)) == 10


def test_rates_with_odd_letters_and_large_values(spark):
    """Letters that only patterns without regard to case take for plain ones are still read; a percentage beyond 100 with three digits after its mark is thousands."""
    lines = ["ıRCC + 2,5%", "İRCC + 2,5%", "3% caſhback", "DOBÂNDĂ 5% ıar DAE 6%", "comision 123,456%", "comision 100,000%", "marja IRCC, marjă de 2,5 p.p.", "Dobânda\t5%\t6% %\t7%\tobs\t9%\tmarja\t4%", "x 5%\ty"]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = sorted((r["n"], r["kind"], r["value"], r["column"]) for r in extract.extract_rates(frame).collect())
    want = [(0, "marja_ircc", 2.5, None), (1, "marja_ircc", 2.5, None), (2, "cashback", 3.0, None), (3, "dae", 6.0, None), (3, "nominala", 5.0, None), (4, "comision_procent", 123456.0, None), (5, "comision_procent", 100.0, None)]
    want += [(6, "marja_ircc", 2.5, None), (7, "nominala", 5.0, None), (7, "nominala", 6.0, 2), (7, "nominala", 7.0, 3), (7, "nominala", 9.0, 5)]
    assert got == want


def test_rates_patterns_are_tried_only_where_they_may_match(spark):
    """What lets a pattern be passed over (F1) never stands against it: wherever it matches, all its signs are there, and it finds the same in small letters."""
    rng = random.Random(1)
    words = ["IRCC", "Euribor 6 luni", "ROBOR", "marjă", "marja fixă", "DAE", "dobândă", "DOBÂNZII", "dobanda anuala efectiva", "Rată", "fixa", "cashback", "comision", "taxa", "fee", "APY", "interest", "p.a.", "per annum", "p.p.", "=", "valoarea de", "+", "(", ")", "01.02.2030", "\t"]
    words += ["avans", "din brut", "impozit", "reducere de dob", "5% reducere", "îndatorat", "TVA", "100 % on", "din suma", "LTV", "subvenție", "LIBOR", "garantare:", "cifra de afaceri", "puncte bonus", "a cotat", "rata Lombard", "marja la curs", "conversie valutară", "grant", "retragere la limita", "12 rate", "0% dob", "fără dobândă", "3 instalments 0%"]
    pick = lambda: rng.choice(words) if rng.random() < 0.6 else f"{rng.randrange(200)},{rng.randrange(999)}%"
    lines = [rng.choice([" ", ""]).join(pick() for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    frame = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.lower("line").alias("low"))
    low, matched = F.col("low"), []
    for _, p in V.RATES:
        found = F.regexp_extract_all("line", F.lit(V.I + p), F.lit(1))
        need = extract._signs_of(p)
        matched.append((F.size(found) > 0, (F.size(found) == 0) | (extract._signs_in(low).bitwiseAND(F.lit(need)) == need) & (found == F.regexp_extract_all(low, F.lit(p.lower()), F.lit(1)))))
    for patterns, some in ((V.NO_RATES, V.NO_RATES_WORDS), (V.INSTALMENTS, V.INSTALMENTS_WORDS)):
        there = F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(F.col("low"), w))
        matched += [(F.col("line").rlike(V.I + p), ~F.col("line").rlike(V.I + p) | there) for p in patterns]
    counts = frame.select(*(F.sum(hit.cast("int")).alias(f"h{k}") for k, (hit, _) in enumerate(matched)), *(F.min(right).alias(f"r{k}") for k, (_, right) in enumerate(matched))).first()
    assert all(counts[f"r{k}"] for k in range(len(matched)))
    assert sum(counts[f"h{k}"] > 0 for k in range(len(matched))) > 40


def test_rates_patterns_are_compiled(spark):
    """No pattern of rates is left in the generator (F1), where Spark interprets it for every line, and the steps aren't written out again as a filter inferred from it."""
    plan = extract.extract_rates(spark.createDataFrame([("x",)], "line string"))._jdf.queryExecution().optimizedPlan().toString()
    generator = [x for x in plan.split("\n") if "Generate explode" in x]
    assert len(generator) == 1 and "IRCC\\b" not in generator[0] and "IRCC\\b" in plan
    assert "Filter" not in plan and len(plan) < 60_000
