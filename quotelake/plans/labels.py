"""Labels and sentences made of whole rows: services under their sections by all concepts, lines with several rates, campaign texts with everything in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.functions import arrays, numbers
from quotelake.functions import vocabulary as V
from quotelake.operators import campaigns, extract, normalise, quality
from quotelake.plans.registry import query, spread, table

#: Services by p_size: label, section, table column, concept. A label takes the part's name with it.
_SERVICES = (
    ("Alertă SMS pentru", None, None, "alerta_sms"), ("Tranzacții la jocuri de noroc", None, None, "tranzactie_gambling"), ("Notificare push", None, None, "notificare_push"), ("Notificare prin e-mail", None, None, "notificare_email"),
    ("Acces lounge", None, None, "acces_lounge"), ("Închiriere casetă", None, None, "caseta_valori"), ("Raportare card pierdut", None, None, "card_pierdut_furat"), ("Mini extras", None, None, "miniextras_atm"),
    ("Reemitere card", None, None, "reemitere_card"), ("Emitere card", None, None, "emitere_card"), ("Livrare card", None, None, "livrare_card"), ("Curierat", None, None, "curierat_posta"), ("Blocare card", None, None, "blocare_card"),
    ("Închidere card", None, None, "inchidere_card"), ("Chirie terminal POS", None, None, "terminal_pos"), ("Administrare credit", None, None, "administrare_credit"), ("Administrare card", None, None, "administrare_card"),
    ("Schimbare PIN", None, None, "schimbare_pin"), ("Cumpărare de bunuri", None, None, "tranzactie_card"), ("Depunere monedă", None, None, "depunere_moneda"), ("Suma neridicată", None, None, "neridicare_numerar"),
    ("Retragere de numerar", None, None, "retragere_numerar"), ("Depunere de numerar", None, None, "depunere_numerar"), ("Deschidere cont", None, None, "deschidere_cont"), ("Închidere cont", None, None, "inchidere_cont"),
    ("Administrare cont", None, None, "administrare_cont"), ("Extras de cont", None, None, "extras_de_cont"), ("Înlocuire token", None, None, "token"), ("Acreditiv", None, None, "documentar"), ("Rambursare anticipată", None, None, "rambursare_anticipata"),
    ("Evaluare imobil", None, None, "evaluare_garantie"), ("Portabilitate", None, None, "portabilitate_cont"), ("Refuz la plată", None, None, "refuz_plata"), ("Împuternicit", None, None, "imputernicire"), ("Debitare directă", None, None, "debitare_directa"),
    ("Speze SWIFT", None, None, "speze_swift"), ("Ordin de plată", None, None, "transfer_credit"), ("Interogare sold", None, None, "interogare_sold"), ("Conversie valutară", None, None, "conversie_valutara"), ("Poprire", None, None, "poprire"),
    ("Bilet la ordin", None, None, "file_cec"), ("Interogare CIP", None, None, "interogare_baze_date"),
    # fragments: a column's, an inner level's, an outer level's concept; a package; a standing order by its section
    ("- principal", "Conturi", "Emitere card", "emitere_card"), ("- în lei", "Carduri > Retragere de numerar", None, "retragere_numerar"), ("- peste", "Retragere de numerar > Diverse", None, "retragere_numerar"),
    ("• emis", "Conturi > Închidere cont", "Diverse", "inchidere_cont"), ("Pachet conținând Emitere card și", None, None, "administrare_cont"), ("Ordin de plată", "Plăți programate > Plată programată", None, "plata_programata"),
    ("Taxă cont de plăți pentru administrare cont", None, None, "administrare_cont"), ("Diverse", None, None, None),
)


def _at(size: str, values: tuple) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), F.col(size).cast("int"))


@query("SELECT p_partkey, ([" + ", ".join("NULL" if c is None else f"'{c}'" for *_, c in _SERVICES) + "])[p_size] AS concept FROM part")
def d01_concept_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of fifty kinds: by their own names, as fragments by their column and their section's levels, as packages, as standing orders."""
    label = F.concat_ws(" ", _at("p_size", tuple(s[0] for s in _SERVICES)), F.when(F.col("p_size").between(43, 46), F.lit(None).cast("string")).otherwise(F.col("p_name")))
    section, column = (_at("p_size", tuple(s[i] for s in _SERVICES)) for i in (1, 2))
    none = F.lit(None).cast("string")
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey").select("p_partkey", normalise.service_concept(label, section, column, none, none).alias("concept"))


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_LIST = ", ".join(_KEYS)


@query(f"""WITH b AS (SELECT {_LIST}, l_quantity::BIGINT AS q, l_linenumber AS n, l_returnflag AS f FROM lineitem)
SELECT {_LIST}, 'dae' AS kind, round(q + n / 10.0, 4) AS value, NULL AS "column" FROM b WHERE f <> 'N'
UNION ALL SELECT {_LIST}, 'nominala', round(q + n / 10.0 + 1, 4), NULL FROM b WHERE f <> 'N'
UNION ALL SELECT {_LIST}, 'marja_ircc', n + 0.25, NULL FROM b WHERE f = 'A'
UNION ALL SELECT {_LIST}, 'nominala', q + 0.5, NULL FROM b WHERE f = 'N'
UNION ALL SELECT {_LIST}, 'nominala', q + 1.5, 2 FROM b WHERE f = 'N'
UNION ALL SELECT {_LIST}, 'nominala', q + 2.5, 3 FROM b WHERE f = 'N' AND n > 3""")
def ext01_ext02_rate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with two or three rates each, of several kinds; table rows whose later cells go on under the first one's kind up to a cell about something else; lines about an advance, without any."""
    q, n, flag = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_returnflag")
    number = lambda whole, part: F.concat(whole.cast("string"), F.lit(","), part.cast("string"), F.lit("%"))
    prose = F.concat(F.lit("Dobândă fixă de "), number(q + 1, n), F.lit(", DAE "), number(q, n), F.when(flag == "A", F.concat(F.lit("; apoi IRCC + "), number(n, F.lit(25)))).otherwise(""))
    row = F.concat(F.lit("Rata dobânzii fixă: dobândă\t"), number(q, F.lit(5)), F.lit("\t"), number(q + 1, F.lit(5)), F.lit("\t"), F.when(n > 3, number(q + 2, F.lit(5))).otherwise("un text care e prea lung ca să fie o celulă cu o cifră"), F.lit("\tobs\tcomision "), number(q + 3, F.lit(5)))
    lines = table(spark, sf_dir, "lineitem").select(*_KEYS, F.when(flag == "N", row).otherwise(prose).alias("line"))
    noise = lines.withColumn("line", F.concat(F.lit("Avans minim "), number(F.col("l_linenumber"), F.lit(5)), F.lit(" din preț")))
    found = extract.extract_rates(lines.unionByName(noise)).where("kind <> 'comision_procent'")
    return found.select(*_KEYS, "kind", F.round("value", 4).alias("value"), "column")


@query("""WITH o AS (SELECT *, (o_orderdate + INTERVAL 300 MONTH)::DATE AS day FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'Primești ' || round(o_totalprice / 1000)::BIGINT || ' lei bonus la deschiderea contului ' || o_custkey || '!' END AS benefit,
  CASE o_orderstatus WHEN 'F' THEN 'banca' WHEN 'O' THEN 'schema_card' ELSE 'partener' END AS organiser, o_orderpriority = '1-URGENT' AS act, o_orderpriority = '5-LOW' AS open,
  CASE WHEN o_orderpriority <> '5-LOW' THEN day END AS start, CASE WHEN o_orderpriority <> '5-LOW' THEN day + 30 END AS "end", CASE WHEN o_orderstatus = 'F' THEN 'PJ' WHEN o_orderstatus = 'O' THEN 'PF' END AS segment FROM o""")
def ext13_ext16_campaign_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each order with everything a campaign's rules say: benefit, organiser, period or none, an added act, whose clients it is for. Each is read from the same text."""
    day, status, priority = F.add_months(F.col("o_orderdate").cast("date"), 300), F.col("o_orderstatus"), F.col("o_orderpriority")
    write = lambda d: F.date_format(d, "dd.MM.yyyy")
    benefit = F.when(status != "P", F.concat(F.lit("Primești "), F.round(F.col("o_totalprice") / 1000).cast("long"), F.lit(" lei bonus la deschiderea contului "), F.col("o_custkey"), F.lit("!"))).otherwise("Condițiile se găsesc la ghișeu.")
    organiser = F.when(status == "F", "Organizatorul campaniei este Raiffeisen Bank S.A.").when(status == "O", "Organizatorul este Mastercard Europe SA").otherwise("Organizator: Acme SRL")
    span = F.when(priority != "5-LOW", F.concat(F.lit("Perioada campaniei: "), write(day), F.lit(" - "), write(F.date_add(day, 30)), F.lit("."))).otherwise("Campania are perioadă nedeterminată.")
    act = F.when(priority == "1-URGENT", "ACTUL ADIȚIONAL NR. 1 la Regulament").otherwise("Regulament")
    words = F.concat_ws(" ", act, F.lit(". Bun venit la campania noastră de toamnă."), benefit, organiser, F.lit(". Capital social 1000 lei."), span)
    title = F.when(status == "F", "Oferta pentru companii").when(status == "O", "Oferta pentru persoane fizice").otherwise("Oferta")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", words.alias("words"), title.alias("title"))

    def read(t: Column) -> Column:
        return F.struct(
            campaigns.organiser_in(t, ["raiffeisen bank"], []).alias("organiser"), campaigns.has_added_act_in(t).alias("act"), campaigns.is_open_ended_in(t).alias("open"), campaigns.period_in(t).alias("p")
        )

    found = spread(rows, "o_orderkey").select("o_orderkey", campaigns.benefit(F.col("words")).alias("benefit"), arrays.let(campaigns.flat(F.col("words")), read).alias("r"), campaigns.segment(F.lit("https://b.ro/x"), F.col("title")).alias("segment"))
    return found.select("o_orderkey", "benefit", "r.organiser", "r.act", "r.open", "r.p.start", "r.p.end", "segment")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN l_quantity * 1000 WHEN 'R' THEN l_quantity * 1000000 ELSE l_quantity END AS n, l_quantity + 0.5 AS share, round(l_extendedprice / 100, 6) AS rate,
  CASE WHEN l_quantity < 12 THEN round(l_quantity + 0.56, 2) END AS implied FROM lineitem""")
def mth06_mth11_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorthand, shares, rates for a hundred units and the index that a total and a margin imply, with the rows' own numbers; an index beyond its bounds is none."""
    q, flag = F.col("l_quantity").cast("long"), F.col("l_returnflag")
    short = F.concat(q, F.when(flag == "A", "K-90K").when(flag == "R", "M").otherwise(""))
    total = F.concat((q + F.col("l_linenumber")).cast("string"), F.lit(".56% (IRCC + "), F.col("l_linenumber"), F.lit("%)"))
    return table(spark, sf_dir, "lineitem").select(
        *_KEYS, numbers.shorthand(short).alias("n"), numbers.comma_share(F.concat(q, F.lit(",5 %"))).alias("share"), numbers.rate_per_unit(F.col("l_extendedprice"), F.lit(100)).alias("rate"), numbers.implied_index(total).alias("implied")
    )


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'BLOCAT' WHEN page_id % 5 = 1 THEN 'DISPARUT' WHEN page_id % 5 = 2 THEN 'REINCEARCA' WHEN page_id % 5 = 3 THEN 'BLOCAT'
  WHEN len(trim(regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<(script)[^>]*>.*?</script>', ' ', 'g'), '(?s)<(style)[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'))) >= 0 THEN 'OK' END AS class FROM pages""")
def str21_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses by status and body: the pages' own HTML, with server errors that say so and blocked ones that come with a good status."""
    k = F.col("page_id") % 5
    status = F.when(k == 0, 403).when(k == 1, 410).when(k == 2, 503).otherwise(200)
    body = F.when(k == 3, F.concat(F.lit("<html>Request rejected, support id "), F.col("page_id"), F.lit("</html>"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", extract.response_class(status, F.lit("text/html"), body).alias("class"))


#: Channels and destinations that a label's words name beside the part's own.
_WORDS = (("la ghișeu", "ghiseu"), ("prin ATM", "atm"), ("prin Internet Banking", "internet_banking"), ("mesaj SWIFT", "swift"), ("pe suport de hârtie", "hartie"))
assert all(c in dict(V.CHANNELS) for _, c in _WORDS)


@query("SELECT p_partkey, CASE p_type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, (_, c) in zip(("ECONOMY", "STANDARD", "PROMO", "LARGE", "MEDIUM"), _WORDS, strict=True)) + " END AS channel FROM part")
def d02_channel_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel that a service's label names, between the part's brand and name."""
    said = F.coalesce(*(F.when(F.col("p_type") == t, w) for t, (w, _) in zip(("ECONOMY", "STANDARD", "PROMO", "LARGE", "MEDIUM"), _WORDS, strict=True)), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", normalise.channel(F.concat_ws(" ", "p_brand", said, "p_name")).alias("channel"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'noua_casa' WHEN p_size < 20 THEN 'credit_auto' WHEN p_size < 30 THEN 'depozit_termen' WHEN p_size < 40 THEN 'card_credit' END AS product,
  CASE WHEN p_size < 10 THEN 'pf' WHEN p_size < 20 OR p_type = 'PROMO' THEN 'pj' WHEN p_type = 'ECONOMY' THEN 'pf' END AS segment FROM part""")
def d04_canonical_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate's product by its own text before its page's title, address and category; its segment by all of them, business pages for legal persons."""
    size, name = F.col("p_size"), F.col("p_name")
    words = F.concat(F.when(size < 10, "Dobândă pentru Noua Casă, persoane fizice").when(size < 20, "Credit pentru mașini, firme").otherwise("Dobândă de 5%"), F.lit(" "), name)
    title = F.concat(F.when(size < 20, "Depozite la termen").when(size < 30, "Depozit la termen").when(size < 40, "Carduri").otherwise("Pagina"), F.lit(" "), name)
    url = F.concat(F.lit("https://b.ro/"), F.when(size.between(30, 39), "carduri-de-credit").otherwise("x"), F.when((F.col("p_type") == "ECONOMY") & (size >= 20), "/persoane-fizice").otherwise(""))
    category = F.when(F.col("p_type") == "PROMO", "business").otherwise("altele")
    return table(spark, sf_dir, "part").select("p_partkey", normalise.canonical_product(words, (title, url), F.when(size >= 10, category).otherwise("altele")).alias("c")).select("p_partkey", "c.*")


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 5000 AS content, 'lista_' || repeat('x', (o_orderkey % 3)::INTEGER) || o_orderkey || '.pdf' AS name, CASE WHEN o_custkey % 20 > 0 THEN o_custkey END AS family, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS day FROM orders),
c AS (SELECT content, max({'n': length(name), 'name': name}).name AS best FROM d GROUP BY 1),
m AS (SELECT d.*, CASE WHEN best <> name THEN best END AS copy_of FROM d JOIN c USING (content)),
s AS (SELECT *, CASE WHEN copy_of IS NOT NULL THEN 'DUBLURA' WHEN day IS NULL THEN 'DATA_NECUNOSCUTA' WHEN day > DATE '1998-01-01' THEN 'VIITOR' ELSE 'IN_VIGOARE' END AS state FROM m),
n AS (SELECT family, max(day) AS newest FROM s WHERE state = 'IN_VIGOARE' AND family IS NOT NULL GROUP BY 1)
SELECT o_orderkey, CASE WHEN state = 'IN_VIGOARE' AND day < newest THEN 'ISTORIC' ELSE state END AS state, copy_of, CASE WHEN state = 'IN_VIGOARE' AND day < newest THEN newest END AS replaced_by FROM s LEFT JOIN n USING (family)""")
def d11_document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents, those to come, those without a date, and the outdated of each family."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("lista_"), F.repeat(F.lit("x"), (key % 3).cast("int")), key, F.lit(".pdf"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (key % 5000).alias("content"), name.alias("name"), F.when(F.col("o_custkey") % 20 > 0, F.col("o_custkey")).alias("family"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("day"))
    return quality.document_states(rows, "content", "name", "family", "day", F.lit("1998-01-01").cast("date")).select("o_orderkey", "state", "copy_of", "replaced_by")
