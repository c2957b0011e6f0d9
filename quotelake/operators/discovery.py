"""What an address, a document or a place is: roles, exclusions, scores, the best page of a bank, versions kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.functions import rules, text
from quotelake.functions import vocabulary as V

# Addresses that are never asked for.
REFERRAL, WINNERS = r"(?i)[?&]promotion=|mgmp|referral(?:[/?#&]|$)", r"castigatori|winners"
ONBOARDING, PREVIEW = r"^(online|banking|cloud\.email)\.", r"^review\.|(^|[.-])staging([.-]|$)"
# Words of addresses that hold no product, of locators, and of documents.
NOISE = (
    "blog", "news", "/stiri", "presa", "comunicat", "cariere", "csr", "cookie", "gdpr", "confidential", "protectia-datelor", "politica-de", "despre-noi", "investitori", "arhiva", "login", "autentificare",
    "fraud", "securitate", "reclamat", "sitemap", "rss", "/tag/", "/author/", "search", "?s=", "/press", "noutati", "mailto:", "tel:", "javascript:",
)
USELESS_FILE = r"\.(jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|mp4|css|js)($|\?)"
LOCATOR = r"retea|unitati|agentii|sucursal|locati|harta|\batm\b|bancomat|branch|locator|find-us|puncte-de-lucru"
DOCUMENT_URL, DOCUMENT_TEXT = r"\.pdf($|\?)|/dam/|/download|/documente?/", r"(?i)\bpdf\b|descarc|download|lista de tarife|formular"
# Terms of lines that may state a rate.
RATE_TERMS = (
    "dae", "dobând", "dobanda", "ircc", "robor", "euribor", "marj", "comision", "taxa", "taxă", "tarif", "rata", "rată", "valoare total", "cost total", "avans", "perioada", "scadent", "cashback",
    "fee", "interest", "apy", "apr", "p.a.", "per annum", "charge", "commission", "withdrawal", "exchange rate", "discount", "per month", "monthly", "annual",
)
RATE_NUMBER = r"(?i)(?<![\d.,])\d{1,3}(?:[,.]\d+)?\s*%|\d[\d.\s]{2,}(?:,\d+)?\s*(?:lei|RON|EUR|euro|USD)\b"
# Documents that are no price list, by name and by title.
NO_PRICE_LIST = (
    r"raport|cerinte[-_ ]transparenta|reg(ulament)?[-_ ]?575|situati\w*[-_ ]financiar|info[-_ ]?economic|psd2|strategi|asigurar|\bKID\b|informatii[-_ ]esentiale|prospect|audit|guvernanta|remunerar|pilon|pillar"
    r"|(?<![a-z])api(?![a-z])|aisp|pisp|technical|transparen[tț]a[-_ ]si[-_ ]publicare|ranking|execution[-_ ]venue|indici[-_ ]referinta|(?<![a-z])f?iw-?8|(?<![a-z])f?iw-?9(?![0-9])|w-?8ben"
)
NO_PRICE_TITLE = (
    r"informa[țt]ii\s+esen[țt]iale|document\s+de\s+informare\s+privind\s+produsul\s+de\s+asigurare|IPID|prospect|situa[țt]ii(le)?\s+financiare|raport(ul)?\s+anual|cerin[țt]e\s+de\s+transparen"
)
# Points of a page's path (the largest counts) and role, and from which sum on a page is chosen.
PATH_POINTS = (
    (r"lista[-_]?de[-_]?preturi", 100), (r"tarife[-_]?si[-_]?comisioane", 95), (r"^/comisioane/?$", 90), (r"tarife", 80), (r"comisio", 75), (r"taxe", 70), (r"documente[-_]?contractuale", 65), (r"documente", 60),
    (r"fees|pricing", 55), (r"informatii[-_]?utile", 40), (r"dobanzi", 30),
)
ROLE_POINTS = (("conditii", 25), ("hub", 15), ("produs", 5))
PATH_PF, PATH_PJ, LEAST_POINTS = r"persoane[-_]?fizice|/pf|_pf", r"business|companii|juridice|/pj|_pj", 35
LEGAL_FORMS = ("sa", "s", "a", "srl", "ead", "nv", "n", "v", "uab", "plc", "ltd")
CRYPTO, MACHINE, LEAST_CONFIDENCE = r"(?i)bitcoin|crypto|bitomat|shitcoins", r"(?i)\bATM\b|bancomat", 0.5


def exclusion_reason(url: Column) -> Column:
    """Why an address isn't asked for: a referral, a list of winners, onboarding or a preview server; null if it may be."""
    host, whole = text.url_host(url), text.fold(text.decoded(url, 1))
    onboarding = host.rlike(ONBOARDING) | text.url_path(whole).contains("/aplica-online") | (host.startswith("george.") & text.url_path(whole).contains("/register"))
    return F.when(url.rlike(REFERRAL), "recomandare").when(whole.rlike(WINNERS), "castigatori").when(onboarding, "onboarding").when(host.rlike(PREVIEW), "previzualizare")


def url_role(url: Column, words: Column) -> Column:
    """(role, format) of an address with its link's words: locator, conditii (documents), produs, or null for noise."""
    low = F.lower(url)
    noise = reduce(lambda a, b: a | b, (low.contains(w) for w in NOISE)) | low.rlike(USELESS_FILE)
    document = low.rlike(DOCUMENT_URL) | F.coalesce(words, F.lit("")).rlike(DOCUMENT_TEXT)
    role = F.when(noise, F.lit(None).cast("string")).when(text.url_path(low).rlike(LOCATOR), "locator").when(document, "conditii").otherwise("produs")
    return F.struct(role.alias("role"), F.when(role == "conditii", F.when(low.contains(".pdf"), "pdf")).when(role.isNotNull(), "html").alias("format"))


def may_state_rate(line: Column, most: int = 300) -> Column:
    """A line that isn't long, holds a term of rates, and a percentage or an amount."""
    low = F.lower(F.trim(line))
    return F.coalesce((F.length(low) > 0) & (F.length(low) <= most) & reduce(lambda a, b: a | b, (low.contains(t) for t in RATE_TERMS)) & line.rlike(RATE_NUMBER), F.lit(False))


def no_price_list(name: Column, title: Column) -> Column:
    """What shows that a document is no price list: the words in its name, else in its title; null for one that may be."""
    by_name = F.nullif(F.regexp_extract(text.decoded(name, 1), f"(?i)({NO_PRICE_LIST})", 1), F.lit(""))
    return F.coalesce(by_name, F.nullif(F.regexp_extract(F.left(title, F.lit(250)), f"(?i)({NO_PRICE_TITLE})", 1), F.lit("")))


def page_points(url: Column, role: Column) -> Column:
    """How well an address fits the page where price lists are published; a PDF never does."""
    path = text.fold(text.url_path(text.decoded(F.regexp_replace(url, "[?#].*$", ""), 1)))
    by_role = F.lit(0)
    for name, points in ROLE_POINTS:
        by_role = F.when(role == name, points).otherwise(by_role)
    person = F.when(path.rlike(PATH_PF), 10).when(path.rlike(PATH_PJ), -10).otherwise(0)
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    return F.when(path.endswith(".pdf"), 0).otherwise(rules.score(path, PATH_POINTS, "max") + by_role + person - depth)


def best_pages(sources: DataFrame, owner: str, url: str, role: str, least: int = LEAST_POINTS) -> DataFrame:
    """(owner, url, points): each owner's best page, if it has ``least`` points; of equals the first address."""
    scored = sources.withColumn("points", page_points(F.col(url), F.col(role))).where(F.col("points") >= least)
    return scored.groupBy(owner).agg(F.min(F.struct((-F.col("points")).alias("p"), F.col(url).alias("u"))).alias("b")).select(owner, F.col("b.u").alias(url), (-F.col("b.p")).alias("points"))


def plain_name(name: Column) -> Column:
    """Letters and digits only, folded, words apart by one blank."""
    return F.trim(F.regexp_replace(text.fold(name), "[^a-z0-9]+", " "))


def without_legal_form(name: Column) -> Column:
    """A plain name without the legal form at its end."""
    return F.regexp_replace(name, r"( (" + "|".join(LEGAL_FORMS) + r"))+$", "")


def belongs_to(name: Column, contains: Sequence[str], whole: Sequence[str]) -> Column:
    """Is an advertiser a bank's, by its legal name as whole words or by its full name without the legal form?"""
    plain = plain_name(name)
    worded = reduce(lambda a, b: a | b, (plain.rlike(rf"(?<![a-z0-9]){p}(?![a-z0-9])") for p in contains), F.lit(False))
    return F.coalesce(worded | without_legal_form(plain).isin(*whole), F.lit(False))


def relevant_links(links: DataFrame, words: Sequence[str]) -> DataFrame:
    """Links whose text or address holds one of the words."""
    hay = text.fold(F.concat_ws(" ", "text", "url"))
    return links.where(reduce(lambda a, b: a | b, (hay.contains(w) for w in words)))


def bank_places(places: DataFrame, banks: Sequence[tuple[str, str]]) -> DataFrame:
    """Places (name, brand, category, status, confidence) with bank, kind and why they are left out: closed, little confidence, a crypto machine, no bank.
    The brand decides before the name, by ordered (bank, pattern)."""
    both = F.concat_ws(" ", "name", "brand")
    bank = F.coalesce(rules.first_match(text.fold(F.col("brand")), banks), rules.first_match(text.fold(F.col("name")), banks))
    why = (
        F.when(F.col("status").isNotNull() & (F.col("status") != "open"), F.concat(F.lit("stare_"), "status")).when(F.coalesce("confidence", F.lit(0.0)) < LEAST_CONFIDENCE, "incredere")
        .when(both.rlike(CRYPTO), "cripto").when(bank.isNull(), "banca")
    )
    kind = F.when((F.col("category") == "atms") | F.coalesce("name", F.lit("")).rlike(MACHINE), "atm").otherwise("sucursala")
    return places.withColumns({"bank": bank, "kind": kind, "left_out": why})


def kept_versions(documents: DataFrame, owner: str, content: str, family: str, day: str, name: str, as_of: Column) -> DataFrame:
    """Adds kept: of documents with one content the first by name stays; of a family its newest version in force stays, and every future one beside it.
    Grouped minima and maxima joined back; documents without a date are the oldest."""
    one = documents.groupBy(content).agg(F.min(name).alias("__first"))
    rows = documents.join(one.withColumnRenamed(content, "__content"), F.col(content) == F.col("__content")).withColumn("__own", F.col(name) == F.col("__first"))
    age = F.struct(F.col(day).isNotNull().alias("dated"), F.col(day).alias("day"), F.col(name).alias("name"))
    future = F.coalesce(F.col(day) > as_of, F.lit(False))
    newest = rows.where(F.col("__own") & ~future).groupBy(F.col(owner).alias("__o"), F.col(family).alias("__f")).agg(F.max(age).alias("__newest"))
    joined = rows.join(newest, F.col(owner).eqNullSafe(F.col("__o")) & F.col(family).eqNullSafe(F.col("__f")), "left")
    return joined.withColumn("kept", F.col("__own") & (future | (F.col("__newest.name") == F.col(name)))).select(*documents.columns, "kept")


def first_lines(lines: DataFrame, owner: str, line: str, at: str, key: int = 80, most: int = 25) -> DataFrame:
    """Each owner's first lines, one for each beginning of ``key`` characters."""
    once = lines.groupBy(owner, F.left(line, F.lit(key)).alias("__key")).agg(F.min(F.struct(F.col(at), F.col(line))).alias("__l")).select(owner, F.col(f"__l.{at}").alias(at), F.col(f"__l.{line}").alias(line))
    return once.withColumn("__rn", F.row_number().over(Window.partitionBy(owner).orderBy(at, line))).where(F.col("__rn") <= most).drop("__rn")


def either_match(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """Different rows of ``keep`` whose left and right meet by any of the (left, right) keys: a union of equality joins, each row once."""
    return reduce(lambda a, b: a.unionByName(b), (left.join(right, F.col(a) == F.col(b)).select(*keep) for a, b in keys)).distinct()


def campaign_kind(url: Column) -> Column:
    """``regulament`` or ``campanie`` by an address' path, decoded and in lower case; null for others. A cheap test on the whole address goes first, words with borders last."""
    flat = F.replace(F.replace(F.lower(url), F.lit("%2520"), F.lit(" ")), F.lit("%20"), F.lit(" "))
    path = F.regexp_replace(flat, "^[a-z]+://[^/]*", "")
    rules = text.like_any(path, "%regulament%") & ~text.like_any(path, *V.RULES_EXCEPT)
    named = text.like_any(path, *V.CAMPAIGN_PATHS) | reduce(lambda a, b: a | b, (path.rlike(p) for p in V.CAMPAIGN_WORDS))
    return F.when(text.like_any(flat, *V.CAMPAIGN_FILTER), F.when(rules, "regulament").when(named, "campanie"))


def campaign_observations(observations: DataFrame, sources: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Observations (id_source, field and others) whose source (id, url) belongs to a campaign, with its kind and the reason of the first exception (no, pattern, fields, reason) that
    matches the address and names the field: a campaign's page may quote a standing price. The exceptions are a short rule table, one array."""
    rule = F.struct("no", "pattern", "fields", "reason")
    table = exceptions.agg(F.sort_array(F.collect_list(rule)).alias("__rules"))
    own = sources.select(F.col("id").alias("id_source"), "url", campaign_kind(F.col("url")).alias("kind")).where("kind is not null")
    rows = observations.join(own, "id_source").crossJoin(F.broadcast(table))
    hit = F.get(F.filter("__rules", lambda r: F.coalesce(F.rlike(F.lower("url"), r["pattern"]), F.lit(False)) & F.array_contains(r["fields"], F.col("field"))), F.lit(0))
    return rows.withColumn("exception", hit["reason"]).drop("__rules", "url")
