"""Text extraction, dates, concepts and validation over whole tables: the texts are composed from columns, so that SQL knows what must be found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.functions import dates, numbers, text
from quotelake.operators import campaigns, changes, discovery, extract, normalise, representative, summaries
from quotelake.plans.registry import query, table
from quotelake.streaming import incremental


def _pick(key: Column, values: Sequence[str | None]) -> Column:
    """The value at the key modulo their number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _case(key: str, values: Sequence[str | None], quoted: bool = True) -> str:
    """The same in SQL."""
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if quoted else str(v)
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a day of the twenties."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.col("o_orderdate").cast("date"), 300).alias("day"))


_DAY = "o AS (SELECT o_orderkey, (o_orderdate + INTERVAL 300 MONTH)::DATE AS day FROM orders)"
_NAMES = dates._MONTH_NO

# ---- concepts and their axes

_SERVICES = (
    ("Taxa recuperare card reținut de ATM", "recuperare_card"), ("Contestare nejustificată a unei tranzacții", "refuz_plata"), ("Emitere card de debit", "emitere_card"), ("Administrare cont curent", "administrare_cont"),
    ("Retragere numerar de la ATM", "retragere_numerar"), ("Depunere numerar la ghișeu", "depunere_numerar"), ("Încasări intrabancare", "incasare"), ("Ordin de plată interbancar", "transfer_credit"),
    ("Interogare sold la ATM", "interogare_sold"), ("Închidere cont curent", "inchidere_cont"), ("Înlocuire token", "token"), ("Alerte SMS pe card", "alerta_sms"), ("Plăţi cu ordin programat", "plata_programata"),
)


@query(f"SELECT p_partkey, {_case('p_partkey', [c for _, c in _SERVICES])} AS concept FROM part".replace("'plata_programata'", "'transfer_credit'"))
def d01_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services by the ordered table of concepts."""
    none = F.lit(None).cast("string")
    services = [s for s, _ in _SERVICES[:-1]] + ["Ordine de plată"]
    return table(spark, sf_dir, "part").select("p_partkey", normalise.service_concept(_pick(F.col("p_partkey"), services), none, none, none, none).alias("concept"))


_CHANNELS = (("la ghișeu", "ghiseu"), ("prin ATM", "atm"), ("Internet Banking", "internet_banking"), ("prin e-mail", "email"), ("altfel", None), ("mesaj SWIFT", "swift"))


@query(f"SELECT c_custkey, {_case('c_custkey', [c for _, c in _CHANNELS])} AS channel FROM customer")
def d02_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", normalise.channel(_pick(F.col("c_custkey"), [n for n, _ in _CHANNELS])).alias("channel"))


_WHERE = (("Plati in afara UE", "extern"), ("Plati SEPA in UE", "sepa"), ("intrabancar si interbancar", None), ("plata nationala", None), ("in cadrul bancii", "intrabancar"))


@query(f"SELECT c_custkey, {_case('c_custkey', [c for _, c in _WHERE[:3]] + [None, 'intrabancar'])} AS destination FROM customer")
def d03_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for n, _ in _WHERE[:3]] + ["emitere", "în cadrul băncii"]
    concept = _pick(F.col("c_custkey"), ["transfer_credit", "transfer_credit", "transfer_credit", "emitere_card", "incasare"])
    return table(spark, sf_dir, "customer").select("c_custkey", normalise.destination(concept, _pick(F.col("c_custkey"), names), F.lit("")).alias("destination"))


_FILES = (("Tarife_si_Comisioane_PJ", "pj"), ("lista-tarife-persoane-fizice", "pf"), ("document", None), ("tarife_imm", "pj"), ("pfizer", None))


@query(f"SELECT s_suppkey, {_case('s_suppkey', [c for _, c in _FILES])} AS segment, {_case('s_suppkey', ['tarife_si_comisioane_pj', 'lista_tarife_persoane_fizice', 'document', 'tarife_imm', 'pfizer'])} AS family FROM supplier")
def d05_str09_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment in a document's name, and the key that its versions share."""
    name = F.concat(_pick(F.col("s_suppkey"), [n for n, _ in _FILES]), F.lit("_"), _pick(F.col("s_suppkey"), ["01.07.2026", "iulie_2026"]), F.lit(".pdf"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", normalise.name_segment(name).alias("segment"), text.family_key(name).alias("family"))


# ---- dates and periods


@query(f"WITH {_DAY} SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN day END AS date, {_case('o_orderkey', ['vigoare', 'valabil', 'camp_data', None])} AS anchor FROM o")
def dat04_text_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchored date of each document's header; the last kind only says until when."""
    before = _pick(F.col("o_orderkey"), ["Lista de tarife în vigoare începând cu data de ", "Oferta e valabilă din ", "Data: ", "Valabil până la "])
    words = F.concat(before, F.date_format("day", "dd.MM.yyyy"), F.lit(" pentru toți clienții"))
    return _orders(spark, sf_dir).withColumn("d", dates.date_in_text(words, F.lit("2027-01-01").cast("date"))).select("o_orderkey", F.col("d.date").alias("date"), F.col("d.anchor").alias("anchor"))


@query(f"WITH {_DAY} SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN date_trunc('month', day)::DATE WHEN 4 THEN NULL ELSE day END AS date, {_case('o_orderkey', ['day', 'day', 'day', 'month', None])} AS precision FROM o")
def dat05_name_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date in a file name: digits, a month's name with and without a day, glued digits, or a year alone, which is none."""
    month = F.element_at(F.array(*(F.lit(m) for m in _NAMES)), F.month("day"))
    names = F.array(
        F.concat(F.lit("tarife_"), F.date_format("day", "dd.MM.yyyy"), F.lit(".pdf")), F.concat(F.lit("Tarife_"), F.dayofmonth("day").cast("string"), F.lit("-"), month, F.lit("-"), F.year("day").cast("string"), F.lit(".pdf")),
        F.concat(F.lit("lista "), F.date_format("day", "yyyyMMdd"), F.lit(".pdf")), F.concat(F.lit("tarife "), month, F.lit(" "), F.year("day").cast("string"), F.lit(".pdf")), F.concat(F.lit("tarife_"), F.year("day").cast("string"), F.lit(".pdf")),
    )
    found = _orders(spark, sf_dir).withColumn("d", dates.date_in_name(F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int"))))
    return found.select("o_orderkey", F.col("d.date").alias("date"), F.col("d.precision").alias("precision"))


@query(f"WITH {_DAY} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN day ELSE day + 40 END AS date, {_case('o_orderkey', ['name', 'text', 'text'])} AS source, o_orderkey % 3 <> 0 AND date_trunc('month', day) <> date_trunc('month', day + 40) AS disagreement FROM o")
def dat06_text_beats_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 3 != 0, F.date_add("day", 40))
    return _orders(spark, sf_dir).withColumn("d", dates.text_beats_name(said, F.col("day"))).select("o_orderkey", "d.date", "d.source", "d.disagreement")


@query(f"WITH {_DAY} SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 2 THEN day END AS start, day + 60 AS stop, o_orderkey % 4 <> 3 AS anchored FROM o")
def dat08_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign periods: full dates, months by name, only an end, and a range far from any word that anchors it."""
    month = lambda c: F.element_at(F.array(*(F.lit(m) for m in _NAMES)), F.month(c))
    named = lambda c: F.concat(F.dayofmonth(c).cast("string"), F.lit(" "), month(c), F.lit(" "), F.year(c).cast("string"))
    a, b = F.date_format("day", "dd.MM.yyyy"), F.date_format("stop", "dd.MM.yyyy")
    words = F.array(
        F.concat(F.lit("Campania se desfășoară în perioada "), a, F.lit(" - "), b, F.lit(".")), F.concat(F.lit("Oferta e valabilă între "), named("day"), F.lit(" și "), named("stop")),
        F.concat(F.lit("Promoția e valabilă până la "), b), F.concat(F.lit("Contract nr. 7 din "), a, F.lit(" – "), b),
    )
    rows = _orders(spark, sf_dir).withColumn("stop", F.date_add("day", 60))
    found = rows.withColumn("p", campaigns.period(F.element_at(words, (F.col("o_orderkey") % 4 + 1).cast("int"))))
    return found.select("o_orderkey", F.col("p.start").alias("start"), F.col("p.end").alias("stop"), F.col("p.anchored").alias("anchored"))


@query(f"WITH {_DAY} SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN day END AS start, CASE WHEN o_orderkey % 3 = 0 THEN day + 30 END AS stop FROM o")
def dat09_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.date_format("day", "dd.MM.yyyy"), F.date_format(F.date_add("day", 30), "dd.MM.yyyy")
    words = F.array(F.concat(F.lit("valabil în perioada "), a, F.lit(" - "), b), F.concat(F.lit("valabil de la "), a), F.lit("fără termen"))
    found = _orders(spark, sf_dir).withColumn("p", dates.validity_period(F.element_at(words, (F.col("o_orderkey") % 3 + 1).cast("int"))))
    return found.select("o_orderkey", F.col("p.start").alias("start"), F.col("p.end").alias("stop"))


@query("""SELECT event_id, s AS seconds, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock
FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)""")
def dat10_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("event_id") * 7 % 9000
    iso = F.concat(F.lit("PT"), F.floor(s / 3600).cast("string"), F.lit("H"), F.floor(s % 3600 / 60).cast("string"), F.lit("M"), (s % 60).cast("string"), F.lit("S"))
    rows = table(spark, sf_dir, "events").select("event_id", dates.iso_duration(iso).alias("seconds"))
    return rows.withColumn("clock", dates.clock(F.col("seconds")))


@query(f"WITH {_DAY} SELECT o_orderkey, day AS date, o_orderkey % 30 <= 14 AS agrees FROM o")
def dat13_header_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTTP date, and whether it is within a fortnight of the day in the file's name."""
    rows = _orders(spark, sf_dir).withColumn("h", dates.header_date(F.concat(F.lit("Mon, "), F.date_format("day", "dd MMM yyyy"), F.lit(" 10:00:00 GMT"))))
    named = F.date_sub("day", (F.col("o_orderkey") % 30).cast("int"))
    return rows.select("o_orderkey", F.col("h").alias("date"), dates.agrees_with_name(F.col("h"), named, F.lit("day")).alias("agrees"))


@query(f"WITH {_DAY} SELECT o_orderkey, 3 AS n, day - 70 AS first, day AS last FROM o")
def aux11_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = dates.windows_back(F.col("day"), 70)
    return _orders(spark, sf_dir).select("o_orderkey", F.size(w).alias("n"), w[F.size(w) - 1]["first"].alias("first"), w[0]["last"].alias("last"))


# ---- rates, fees and numbers

_TENTH = "l.*, 1 + l_orderkey % 30 AS a, l_linenumber AS b"
_LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""SELECT {_LINE_KEYS}, {_case('l_orderkey', ['dae', 'nominala', 'marja_ircc', 'cashback', 'rate_fara_dobanda'])} AS kind, CASE WHEN l_orderkey % 5 = 4 THEN 0 ELSE (1 + l_orderkey % 18) + l_linenumber / 10.0 END::DOUBLE AS value FROM lineitem""")
def ext01_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that state one rate each, of several kinds, and lines about an advance, which state none."""
    v = F.concat((F.col("l_orderkey") % 18 + 1).cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit("%"))
    lines = F.array(F.concat(F.lit("DAE "), v), F.concat(F.lit("Dobândă fixă de "), v), F.concat(F.lit("IRCC + "), v), F.concat(v, F.lit(" cashback la cumpărături")), F.lit("Ai până la 12 rate cu 0% dobândă"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.element_at(lines, (F.col("l_orderkey") % 5 + 1).cast("int")).alias("line"))
    noise = rows.withColumn("line", F.concat(F.lit("Avans minim "), v, F.lit(" din preț")))
    return extract.extract_rates(rows.unionByName(noise)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", F.round("value", 4).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN round((5 + o_orderkey % 4) + 0.56, 2) END AS value FROM orders")
def mth06_implied_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total less margin: 3.5 and the index make the total."""
    whole = (F.col("o_orderkey") % 4 + 8).cast("string")
    words = F.array(F.concat((F.col("o_orderkey") % 4 + 9).cast("string"), F.lit(".06% (IRCC + 3.5%)")), F.concat(F.lit("3% + IRCC ("), whole, F.lit(".56%)")), F.lit("fixă, apoi variabilă"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.implied_index(F.element_at(words, (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("value"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN (1 + event_id % 9) * 1000 WHEN 1 THEN (1 + event_id % 9) * 1000000 ELSE 1 + event_id % 9 END::DOUBLE AS n, (1 + event_id % 9) + 0.5 AS share, round((1 + event_id % 9) / 100.0, 6) AS rate FROM events")
def mth09_mth11_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorthand numbers, shares with a comma, and rates given for a hundred units."""
    k = F.col("event_id") % 9 + 1
    short = F.concat(k.cast("string"), _pick(F.col("event_id"), ["K-50K", "M", ""]))
    return table(spark, sf_dir, "events").select("event_id", numbers.shorthand(short).alias("n"), numbers.comma_share(F.concat(k.cast("string"), F.lit(",5 %"))).alias("share"), numbers.rate_per_unit(k.cast("double"), F.lit(100)).alias("rate"))


@query(f"SELECT {_LINE_KEYS}, l_orderkey % 3 < 2 AS found FROM lineitem")
def ext21_figure_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the figure stand in the text, in the local way, in the other way, or not at all?"""
    local = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    words = F.array(F.concat(F.lit("costă "), local, F.lit(" lei")), F.concat(F.lit("price "), F.regexp_replace(F.regexp_replace(F.format_number("l_extendedprice", 2), ",", ""), r"\.?0+$", "")), F.lit("fără preț"))
    found = extract.figure_in_text(F.col("l_extendedprice"), F.element_at(words, (F.col("l_orderkey") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found.alias("found"))


_VALIDATED = """r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ircc_valoare' WHEN 1 THEN 'nominala' ELSE 'robor_valoare' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN [5.56, 6.06, 4.2, 5.7][(o_orderkey % 4 + 1)::INTEGER] ELSE 3.0 + o_orderkey % 50 END::DOUBLE AS value,
  CASE WHEN o_orderkey % 7 = 0 THEN DATE '2026-01-01' END AS period_end FROM orders)"""


@query(f"""WITH {_VALIDATED} SELECT o_orderkey, CASE WHEN (kind = 'ircc_valoare' AND value NOT BETWEEN 4 AND 8) OR (kind = 'nominala' AND value NOT BETWEEN 0 AND 40) OR (kind = 'robor_valoare' AND value NOT BETWEEN 4 AND 9) THEN 'SUSPECT' WHEN period_end IS NOT NULL THEN 'SURSA_VECHE'
  WHEN kind = 'nominala' THEN 'VALID' WHEN kind = 'robor_valoare' THEN 'NEVERIFICAT' WHEN value = 5.56 THEN 'VALID' WHEN value = 6.06 THEN 'SURSA_VECHE' ELSE 'SUSPECT' END AS verdict FROM r""")
def d12_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates against their intervals, their own period, and the index in force and before."""
    index = spark.createDataFrame([("ircc_valoare", 5.56, "2026-07-01", "2026-09-30"), ("ircc_valoare", 6.06, "2026-04-01", "2026-06-30")], "kind string, value double, a string, b string")
    index = index.select("kind", "value", F.col("a").cast("date").alias("valid_from"), F.col("b").cast("date").alias("valid_to"))
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.element_at(F.array(*map(F.lit, (5.56, 6.06, 4.2, 5.7))), (k % 4 + 1).cast("int"))).otherwise((k % 50 + 3).cast("double"))
    rates = table(spark, sf_dir, "orders").select("o_orderkey", _pick(k, ["ircc_valoare", "nominala", "robor_valoare"]).alias("kind"), value.alias("value"), F.when(k % 7 == 0, F.lit("2026-01-01").cast("date")).alias("period_end"))
    return normalise.validate(rates, index, F.lit("2026-09-16").cast("date")).select("o_orderkey", "verdict")


# ---- campaigns and labels

_BENEFITS = (("Bun venit. Primești 500 lei bonus la deschidere! Detalii mai jos.", "Primești 500 lei bonus la deschidere!"), ("Capital social 1000 lei, bonus pentru toți.", None), ("Condițiile se găsesc pe site-ul nostru.", None), ("Cashback 5% la toate cumpărăturile.", "Cashback 5% la toate cumpărăturile."))


@query(f"SELECT c_custkey, {_case('c_custkey', [b for _, b in _BENEFITS])} AS benefit FROM customer")
def ext13_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", campaigns.benefit(_pick(F.col("c_custkey"), [t for t, _ in _BENEFITS])).alias("benefit"))


_SEGMENTS = (("https://b.ro/imm/x", "", "PJ"), ("https://b.ro/persoane-fizice/imm-x", "", None), ("https://b.ro/x", "Oferta pentru companii", "PJ"), ("https://b.ro/retail/y", "Firme", "PF"), ("https://b.ro/x", "", None))


@query(f"SELECT c_custkey, {_case('c_custkey', [s for *_, s in _SEGMENTS])} AS segment FROM customer")
def ext14_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, title = (_pick(F.col("c_custkey"), [x[i] for x in _SEGMENTS]) for i in (0, 1))
    return table(spark, sf_dir, "customer").select("c_custkey", campaigns.segment(url, title).alias("segment"))


_ORGANISERS = (("Concurs. Organizatorul „Câștigă cu Mastercard” este Raiffeisen Bank S.A.", "banca"), ("Organizatorul este Mastercard Europe SA", "schema_card"), ("Organizator: Acme SRL", "partener"), ("Fără nume", None), ("Organizatorul campaniei este BCR Social Finance IFN", "grup"))


@query(f"SELECT c_custkey, {_case('c_custkey', [o for _, o in _ORGANISERS])} AS organiser FROM customer")
def ext15_organiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = campaigns.organiser(_pick(F.col("c_custkey"), [t for t, _ in _ORGANISERS]), ["raiffeisen bank", r"\bbcr\b"], ["bcr social finance"])
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("organiser"))


_ACTS = (("În cazul în care Organizatorul va decide, se va încheia un act adițional nr. 1", "false"), ("ACTUL ADIȚIONAL NR. 1 la Regulament", "true"), ("Se prelungește durata până la 31 octombrie", "true"), ("Perioadă nedeterminată", "false"))


@query(f"SELECT c_custkey, {_case('c_custkey', [a for _, a in _ACTS], False)} AS act, c_custkey % 4 = 3 AS open FROM customer")
def ext16_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _pick(F.col("c_custkey"), [t for t, _ in _ACTS])
    return table(spark, sf_dir, "customer").select("c_custkey", campaigns.has_added_act(words).alias("act"), campaigns.is_open_ended(words).alias("open"))


_PRESS = (("Premieră în bankingul românesc", None), ("Câștigătorii au fost anunțați", None), ("O nouă campanie de phishing vizează clienții", None), ("Câștigă 500 lei cu cardul", "castiga"), ("Bonus la economii", "bonus"))


@query(f"SELECT c_custkey, {_case('c_custkey', [w for _, w in _PRESS])} AS word FROM customer")
def d21_press(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", campaigns.press_word(_pick(F.col("c_custkey"), [t for t, _ in _PRESS])).alias("word"))


@query("""WITH m AS (SELECT 'c' || o_custkey AS campaign, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey ELSE 'd' || (o_orderkey % 500) END AS url FROM orders UNION ALL SELECT 'd' || o_orderkey, 'd' || o_orderkey FROM orders WHERE o_orderkey < 1000),
ch AS (SELECT url AS k, max(campaign) AS parent FROM m WHERE url <> campaign GROUP BY 1), al AS (SELECT campaign AS k FROM m GROUP BY 1 HAVING bool_and(url = campaign)), mv AS (SELECT k, parent FROM ch JOIN al USING (k))
SELECT coalesce(parent, campaign) AS campaign, url FROM m LEFT JOIN mv ON campaign = k""")
def d22_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are campaigns of their own and another's document move to the other's; all carry a label, so none is dropped."""
    o, text_ = table(spark, sf_dir, "orders"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    own = o.select(text_("c", F.col("o_custkey")).alias("campaign"), F.when(F.col("o_orderkey") % 3 == 0, text_("c", F.col("o_custkey"))).otherwise(text_("d", F.col("o_orderkey") % 500)).alias("url"))
    alone = o.where("o_orderkey < 1000").select(text_("d", F.col("o_orderkey")).alias("campaign"), text_("d", F.col("o_orderkey")).alias("url"))
    members = own.unionByName(alone).withColumns({"label": F.lit("l"), "hub": F.lit(None).cast("string")})
    return campaigns.unified(members).select("campaign", "url")


_LABELS = (("Com", "too_short"), ("taxa de", "starts_lower,ends_with_connector"), ("Cost 5 lei pe an", "holds_price"), ("Administrare cont", ""))


@query(f"SELECT p_partkey, {_case('p_partkey', [f for _, f in _LABELS])} AS faults FROM part")
def str14_label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.label_faults(_pick(F.col("p_partkey"), [t for t, _ in _LABELS])), ",").alias("faults"))


_RESPONSES = ((200, "text/html", "Access Denied", "BLOCAT"), (503, "text/html", "Just a moment...", "BLOCAT"), (503, "text/html", "maintenance", "REINCEARCA"), (429, "", "x", "BLOCAT"), (404, "", "", "DISPARUT"), (200, "application/pdf", "%PDF-1.7", "OK"), (200, "text/html", '<div id="root"></div>', "JS"), (200, "text/html", "HTTP/1.0 302 Found", "REDIRECT_SERIALIZAT"))


@query(f"SELECT event_id, {_case('event_id', [v for *_, v in _RESPONSES])} AS verdict FROM events")
def str21_response_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*(F.lit(r[0]) for r in _RESPONSES)), (k % len(_RESPONSES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", extract.response_class(status, _pick(k, [r[1] for r in _RESPONSES]), _pick(k, [r[2] for r in _RESPONSES])).alias("verdict"))


@query("SELECT c_custkey, replace(c_name, '#', '#') || ' șțȘȚ' AS comma, 'a <b> & \"c\" ' || c_custkey AS decoded FROM customer")
def str03_str15_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cedilla letters with commas, and coded signs decoded."""
    coded = F.concat(F.lit("a &lt;b&gt; &amp; &quot;c&quot; "), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.cedilla_to_comma(F.concat("c_name", F.lit(" şţŞŢ"))).alias("comma"), text.xml_unescaped(coded).alias("decoded"))


@query("SELECT doc_id, length(regexp_replace(left(text, 60), '[ \\t\\n\\x0B\\f\\r\\x{00A0}]+', '', 'g')) > 0 AND doc_id % 3 <> 0 AS found FROM documents")
def d31_quote_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a quote's beginning in the text? Two thirds are the text's own beginnings, spaced out, the others stand nowhere."""
    quote = F.when(F.col("doc_id") % 3 != 0, F.regexp_replace(F.left("text", F.lit(60)), " ", " \n ")).otherwise("☃ ☃ ☃")
    return table(spark, sf_dir, "documents").select("doc_id", text.quote_found(quote, F.col("text")).alias("found"))


# ---- counts and changes


@query("SELECT o_custkey % 20 AS bank, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 2")
def agg22_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("bank"), F.col("o_orderdate").cast("date").alias("day"))
    return summaries.same_day(rows, "bank", "day", 2)


@query("""WITH l AS (SELECT l_suppkey AS doc, l_orderkey % 10 AS page, 'pagina ' || CASE WHEN l_linenumber < 3 THEN '##' ELSE l_returnflag END AS line FROM lineitem), p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY 1)
SELECT l.doc, line, count(DISTINCT page) AS on_pages FROM l JOIN p ON l.doc = p.doc GROUP BY l.doc, line, pages HAVING count(DISTINCT page) >= greatest(2, floor(pages * 0.4))""")
def agg19_page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on many of a document's pages, digits masked."""
    words = F.concat(F.lit("pagina "), F.when(F.col("l_linenumber") < 3, (F.col("l_orderkey") % 90 + 10).cast("string")).otherwise(F.col("l_returnflag")))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 10).alias("page"), text.masked_digits(words).alias("line"))
    return summaries.page_furniture(lines, "doc", "page", "line")


@query("""SELECT event_type AS origin, 'etag' AS validator, count(*) FILTER (WHERE event_id % 3 = 0 AND value < 1) AS missed, count(*) FILTER (WHERE event_id % 3 <> 0 AND value >= 1) AS needless, count(*) AS n,
  count(*) FILTER (WHERE event_id % 3 = 0 AND value < 1) = 0 AND count(*) FILTER (WHERE event_id % 3 <> 0 AND value >= 1) < 2 AS trusted FROM events GROUP BY 1""")
def stm03_validator_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").select(F.col("event_type").alias("origin"), F.lit("etag").alias("validator"), (F.col("event_id") % 3 == 0).alias("same_validator"), (F.col("value") >= 1).alias("same_content"))
    return incremental.validator_trust(probes)


@query("""WITH a AS (SELECT l_orderkey AS s, l_linenumber AS label, l_partkey, l_suppkey, l_quantity AS v FROM lineitem), k AS (SELECT s, label FROM a GROUP BY 1, 2 HAVING count(*) = 1),
u AS (SELECT a.* FROM a JOIN k USING (s, label)) SELECT s, label::BIGINT AS label, v AS old_value, v + 5 AS new_value FROM u WHERE s % 3 = 0""")
def stm06_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a price list, a third of whose prices rose; lines that occur once under their label."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").cast("long").alias("label"), F.col("l_quantity").alias("v"))
    once = line.groupBy("s", "label").agg(F.min("v").alias("v"), F.count("*").alias("n")).where("n = 1").drop("n")
    old = once.select("s", "label", F.lit("b").alias("band"), "v", (F.col("s") * 10 + F.col("label")).alias("id"))
    new = old.withColumns({"v": F.when(F.col("s") % 3 == 0, F.col("v") + 5).otherwise(F.col("v")), "id": F.col("id") + 10**12})
    found = changes.version_diff(old, new, ["s", "label"], "band", "v", ["s", "label"], "id")
    return found.where("kind = 'price'").select("s", "label", "old_value", "new_value")


# ---- what addresses, documents and places are

_URLS = (
    ("https://b.ro/x?promotion=1", "recomandare", "produs"), ("https://b.ro/Câștigători-iulie", "castigatori", "produs"), ("https://online.b.ro/cont", "onboarding", "produs"), ("https://staging.b.ro/card", "previzualizare", "produs"),
    ("https://b.ro/credite/nevoi-personale", None, "produs"), ("https://b.ro/documente/tarife.pdf", None, "conditii"), ("https://b.ro/harta-bancomat", None, "locator"), ("https://b.ro/blog/x", None, None),
)


@query(f"SELECT c_custkey, {_case('c_custkey', [r for _, r, _ in _URLS])} AS reason, {_case('c_custkey', [r for *_, r in _URLS])} AS role, {_case('c_custkey', ['html'] * 5 + ['pdf', 'html', None])} AS format FROM customer")
def str18_ext22_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _pick(F.col("c_custkey"), [u for u, *_ in _URLS])
    rows = table(spark, sf_dir, "customer").select("c_custkey", discovery.exclusion_reason(url).alias("reason"), discovery.url_role(url, F.lit("")).alias("r"))
    return rows.select("c_custkey", "reason", "r.role", "r.format")


_STATED = (("Dobândă fixă 5,9% pe an", "true"), ("Comision 10.000 lei anual", "true"), ("Dobândă avantajoasă", "false"), ("Reducere 5%", "false"), ("", "false"))


@query(f"SELECT c_custkey, {_case('c_custkey', [b for _, b in _STATED], False)} AS may FROM customer")
def ext23_rate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", discovery.may_state_rate(_pick(F.col("c_custkey"), [t for t, _ in _STATED])).alias("may"))


_LISTS = (("raport_2026.pdf", "Tarife", "raport"), ("tarife.pdf", "Lista de tarife", None), ("doc.pdf", "Informații esențiale pentru investitori", "Informații esențiale"), ("api-website-aisp.pdf", "", "api"), ("rapid.pdf", "", None))


@query(f"SELECT c_custkey, {_case('c_custkey', [w for *_, w in _LISTS])} AS why FROM customer")
def ext24_no_price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, title = (_pick(F.col("c_custkey"), [x[i] for x in _LISTS]) for i in (0, 1))
    return table(spark, sf_dir, "customer").select("c_custkey", discovery.no_price_list(name, title).alias("why"))


_PAGES = (("/ro/persoane-fizice/informatii-utile/comisioane", "produs", 75 + 5 + 10 - 4), ("/tarife-si-comisioane", "conditii", 95 + 25 - 1), ("/business/tarife", "hub", 80 + 15 - 10 - 2), ("/tombola", "produs", 5 - 1), ("/doc/tarife.pdf", "conditii", 0))


@query(f"""WITH s AS (SELECT c_nationkey AS bank, 'https://b.ro' || {_case('c_custkey', [p for p, *_ in _PAGES])} AS url, {_case('c_custkey', [str(n) for *_, n in _PAGES], False)} AS points FROM customer)
SELECT bank, min(url) AS url, max(points) AS points FROM s JOIN (SELECT bank, max(points) AS best FROM s GROUP BY 1) USING (bank) WHERE points = best AND best >= 35 GROUP BY bank""")
def join21_best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bank's best page for price lists."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("bank"), F.concat(F.lit("https://b.ro"), _pick(F.col("c_custkey"), [p for p, *_ in _PAGES])).alias("url"), _pick(F.col("c_custkey"), [r for _, r, _ in _PAGES]).alias("role"))
    return discovery.best_pages(rows, "bank", "url", "role")


_FIRMS = (("Banca Transilvania S.A.", "true"), ("Transilvania Tour SRL", "false"), ("BT Leasing", "true"), ("BTX", "false"))


@query(f"SELECT c_custkey, {_case('c_custkey', [b for _, b in _FIRMS], False)} AS own FROM customer")
def aux12_legal_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", discovery.belongs_to(_pick(F.col("c_custkey"), [n for n, _ in _FIRMS]), ["bt leasing"], ["banca transilvania"]).alias("own"))


_SPOTS = (("Agenție BRD", "BRD", "open", "brd", "sucursala", None), ("Bitcoin ATM BRD", None, "open", "brd", "atm", "cripto"), ("Bancomat", "Banca Comercială Română", "open", "bcr", "atm", None), ("Cafenea", None, "open", None, "sucursala", "banca"), ("BCR", None, "closed", "bcr", "sucursala", "stare_closed"))


@query(f"SELECT c_custkey, {_case('c_custkey', [s[3] for s in _SPOTS])} AS bank, {_case('c_custkey', [s[4] for s in _SPOTS])} AS kind, CASE WHEN c_custkey % 5 = 4 THEN 'stare_closed' WHEN c_custkey % 7 = 0 THEN 'incredere' ELSE {_case('c_custkey', [s[5] for s in _SPOTS])} END AS left_out FROM customer")
def d30_bank_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name, brand, status = (_pick(k, [s[i] for s in _SPOTS]) for i in (0, 1, 2))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), brand.alias("brand"), F.lit("bank").alias("category"), status.alias("status"), F.when(k % 7 == 0, 0.2).otherwise(0.9).alias("confidence"))
    return discovery.bank_places(rows, [("brd", r"\bbrd\b"), ("bcr", r"\bbcr\b|comerciala romana")]).select("c_custkey", "bank", "kind", "left_out")


@query("""WITH d AS (SELECT o_orderkey, o_custkey % 30 AS owner, o_custkey % 4 AS fam, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS day, lpad(o_orderkey::VARCHAR, 10, '0') AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'c' || o_orderkey % 100 ELSE 'u' || o_orderkey END AS h FROM orders),
f AS (SELECT h, min(name) AS first FROM d GROUP BY 1), o AS (SELECT d.*, name = first AS own, coalesce(day > DATE '2000-01-01', false) AS future FROM d JOIN f USING (h)),
n AS (SELECT owner, fam, max({'a': day IS NOT NULL, 'b': coalesce(day, DATE '1900-01-01'), 'c': name}) AS newest FROM o WHERE own AND NOT future GROUP BY 1, 2)
SELECT o_orderkey, own AND (future OR coalesce(newest.c = name, false)) AS kept FROM o LEFT JOIN n USING (owner, fam)""")
def d32_kept_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical documents once; of each family the newest in force and all future ones."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 30).alias("owner"), (F.col("o_custkey") % 4).alias("fam"), F.when(k % 9 != 0, F.col("o_orderdate").cast("date")).alias("day"), F.lpad(k.cast("string"), 10, "0").alias("name"),
        F.when(k % 5 == 0, F.concat(F.lit("c"), (k % 100).cast("string"))).otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("h"),
    )
    found = discovery.kept_versions(rows, "owner", "h", "fam", "day", "name", F.lit("2000-01-01").cast("date"))
    return found.select("o_orderkey", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""WITH l AS (SELECT c_nationkey, c_custkey, 'line ' || left(c_mktsegment, 3) || c_custkey % 40 AS line FROM customer), f AS (SELECT c_nationkey, line, min(c_custkey) AS c_custkey FROM l GROUP BY 1, 2)
SELECT c_nationkey, c_custkey, line FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, line) AS rn FROM f) WHERE rn <= 25""")
def aux15_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit("line "), F.left("c_mktsegment", F.lit(3)), (F.col("c_custkey") % 40).cast("string")).alias("line"))
    return discovery.first_lines(lines, "c_nationkey", "line", "c_custkey")


@query("""SELECT DISTINCT s_suppkey, x.c FROM supplier CROSS JOIN LATERAL (SELECT n_name AS c FROM nation WHERE n_nationkey = s_nationkey UNION SELECT n_name FROM nation WHERE n_nationkey = s_suppkey % 25) x""")
def join12_lateral_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated union: suppliers with the nations they meet by one key or the other."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 25).alias("other"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("c"))
    return discovery.either_match(supplier, nation, [("s_nationkey", "n_nationkey"), ("other", "n_nationkey")], ["s_suppkey", "c"])


_PAGE_RATES = "r AS (SELECT o_custkey AS url, CASE o_orderkey % 3 WHEN 0 THEN 'dae' WHEN 1 THEN 'nominala' ELSE 'marja_ircc' END AS kind, (1 + o_orderkey % 9) / 2.0 AS value, o_orderkey FROM orders)"


def _page_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), _pick(k, ["dae", "nominala", "marja_ircc"]).alias("kind"), ((k % 9 + 1) / 2).alias("value"), F.lit("OK").alias("verdict"), "o_orderkey")


@query(f"WITH {_PAGE_RATES}, p AS (SELECT url, max(value) FILTER (WHERE kind = 'dae') < min(value) FILTER (WHERE kind = 'nominala' AND value > 0) AS odd FROM r GROUP BY 1) SELECT o_orderkey, CASE WHEN odd AND kind = 'dae' THEN 'SUSPECT' ELSE 'OK' END AS verdict FROM r JOIN p USING (url)")
def d13_page_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective rates below the nominal ones of their page are suspect."""
    return normalise.page_invariants(_page_rates(spark, sf_dir)).select("o_orderkey", "verdict")


@query(f"WITH {_PAGE_RATES}, n AS (SELECT DISTINCT url, value AS v FROM r WHERE kind = 'nominala'), m AS (SELECT DISTINCT url, value FROM r WHERE kind = 'marja_ircc') SELECT url, value, EXISTS (SELECT 1 FROM n WHERE n.url = m.url AND abs(v - (m.value + 1.0)) <= 0.1 + 1e-9) AS consistent FROM m")
def d13_consistent_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins that, with the index, make a nominal rate of their page."""
    return normalise.consistent_margins(_page_rates(spark, sf_dir), F.lit(1.0)).select("url", "value", "consistent")


@query("""WITH r AS (SELECT slug AS bank, CASE l_linenumber WHEN 1 THEN NULL ELSE 'p' || l_linenumber % 4 END AS product, CASE WHEN l_orderkey % 3 = 0 THEN 'pj' END AS segment, CASE WHEN l_orderkey % 5 = 0 THEN 'business' ELSE 'retail' END AS category,
  CASE l_orderkey % 4 WHEN 0 THEN 'dae' WHEN 1 THEN 'cashback' ELSE 'nominala' END AS kind, '-' AS way, 1 + l_discount * 100 AS value, CASE WHEN l_partkey % 10 = 0 THEN 'footer' ELSE 't' || l_linenumber || l_orderkey END AS text
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT n_nationkey, lower(n_name) AS slug FROM nation) ON s_nationkey = n_nationkey),
k AS (SELECT * FROM r WHERE product IS NOT NULL), fu AS (SELECT bank, left(text, 70) AS t FROM k GROUP BY 1, 2 HAVING count(DISTINCT product) >= 3),
g AS (SELECT product, coalesce(segment, CASE WHEN category = 'business' THEN '-' ELSE 'pf' END) AS segment, kind, way, bank, value FROM k WHERE kind <> 'cashback' AND NOT EXISTS (SELECT 1 FROM fu WHERE fu.bank = k.bank AND t = left(k.text, 70))),
o AS (SELECT product, segment, kind, way, bank, median(value) AS m, max(value) / min(value) AS w FROM g GROUP BY ALL)
SELECT product, segment, kind, count(*) AS sellers, round(median(m), 4) AS median, max(m) / min(m) <= 8 AND max(w) <= 8 AS trusted FROM o GROUP BY product, segment, kind, way HAVING count(*) >= 3""")
def d24_comparable_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.plans import domain

    supplier = domain._of_bank(spark, sf_dir, table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey").withColumnRenamed("banca", "bank")
    line, k, n = table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "bank", F.when(n != 1, F.concat(F.lit("p"), (n % 4).cast("string"))).alias("product"), F.when(k % 3 == 0, "pj").alias("segment"), F.when(k % 5 == 0, "business").otherwise("retail").alias("category"),
        F.when(k % 4 == 0, "dae").when(k % 4 == 1, "cashback").otherwise("nominala").alias("kind"), F.lit("-").alias("way"), (F.lit(1) + F.col("l_discount") * 100).alias("value"),
        F.when(F.col("l_partkey") % 10 == 0, "footer").otherwise(F.concat(F.lit("t"), n.cast("string"), k.cast("string"))).alias("text"),
    )
    return representative.comparable_rates(rows).select("product", "segment", "kind", "sellers", F.round("median", 4).alias("median"), "trusted")
