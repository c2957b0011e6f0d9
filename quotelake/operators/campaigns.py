"""Campaigns out of text: periods, benefits, segments, organisers, roles of links, press titles. Column expressions over folded text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import arrays, text

# Months as they stand in campaign texts (words that are also other words are left out).
MONTHS = {
    "ianuarie": 1, "ian": 1, "februarie": 2, "feb": 2, "martie": 3, "aprilie": 4, "apr": 4, "mai": 5, "iunie": 6, "iun": 6, "iulie": 7, "iul": 7,
    "august": 8, "aug": 8, "septembrie": 9, "sept": 9, "octombrie": 10, "oct": 10, "noiembrie": 11, "nov": 11, "decembrie": 12, "dec": 12,
}
# Words near which a date is a campaign's, and words after which it is an example's.
ANCHOR = r"perioad|desfasoar|deruleaz|valabil|durata|intre|intervalul|incepand|campani|promoti|oferta|editia|concurs|tombol|participa"
EXAMPLE = r"exemplu|reprezentativ"
UNTIL, SINCE = r"pana (?:la|in|pe) (?:data de )?", r"incepand (?:cu|din) (?:data de )?"
# Additional acts and extensions; conditions under which they are only possible; open-ended programmes.
ADDED_ACT = (
    r"\bact(?:ul)? aditional(?:ul)? (?:nr\.?|numarul|no\.?) ?\d|\bactul aditional la regulament|^ ?act aditional|\bse prelunge(?:ste|sc)\b"
    r"|\bprelungirea (?:campaniei|perioadei|duratei|programului)|\baddendum\b"
)
CONDITION = r"in cazul in care|va decide|poate decide|isi rezerva|\bdaca\b"
OPEN_ENDED = r"perioad[ae] nedeterminat|durat[ae] nedeterminat|pana la (?:noi dispozitii|incetarea|modificarea)"
# What names a benefit and an amount, and what never is one.
BENEFIT = (
    r"cashback|bonus|premi(?:u|ul|i|ile|aza)\b|castig|reducer|discount|gratuit|gratis|fara\s+comision|zero\s+comision|0\s*comision|comision\s+0|fara\s+dobanda|dobanda\s+0"
    r"|dobanda\s+(?:promotional|preferential|redus|fixa|de\s+\d)|voucher|cadou|puncte|rambursa|scutir|primesti|beneficiez|oferim|0\s*%"
)
AMOUNT = r"\d[\d.,]*\s*(?:lei|ron|eur|euro|usd|%)|\d+\s*rate|gratuit|fara\s+comision|fara\s+dobanda|zero\s+comision"
NO_BENEFIT = (
    r"capital\s+social|sediul|registrul|cod\s+unic|cui\b|impozit|disponibil\w*\s+(?:\w+\s+){0,6}gratuit|gratuit\w*\s+oricarui|informatii\s+gratuit|exemplu\w*\s+reprezentativ|\bdae\b"
    r"|caracter\s+personal|copie\s+a\s+datelor"
)
# Segments in addresses and titles.
LEGAL = r"companii|/imm|imm-|business|persoane-juridice|juridice|/pj\b|/pj[-/]|[-_]pj\b|corporate|/sme\b|antreprenor|/firme|microintreprinder|pfa\b"
NATURAL = r"persoane-fizice|/pf\b|/pf[-/]|[-_]pf\b|individuals|/retail/|fizice"
# Organisers.
ORGANISER = r"organizat(?:a|or(?:ul|ii|ul\s+campaniei)?|ori(?:i)?)\b|organizata\s+de"
SCHEME = r"mastercard|\bvisa\b"
LEGAL_FORM = r"\b(?:s\.?\s?a\.?|s\.?r\.?l\.?|ifn|ltd|gmbh|n\.v\.|ead|plc)(?![a-z])"
# Roles of links.
CAMPAIGN_URL = r"campani|campaign|campain|promoti|\bpromo\b|concurs|oferta-special|oferte-special|castig[ai]\b|premii\b|premiaz|bonus-\d|rate-fara-dobanda|tombol|regulament|landing-pages/lcp-|/lp/"
CAMPAIGN_TEXT = (
    r"campani|promoti|\bpromo\b|concurs|tombol|castig[ai]\b|castigi\b|premii\b|premiaz|cashback|\bbonus\b|voucher|reducere|discount|rate\s+fara\s+dobanda|fara\s+comision"
    r"|dobanda\s+promotional|oferta\s+special|cadou|\bgratuit"
)
RULES_DOCUMENT = r"regulament|act[-_ ]?aditional|addendum|termeni[-_ ]si[-_ ]conditii[-_ ]campani"
ACT_DOCUMENT = r"act[-_ ]?aditional|addendum|prelungire|\baa\d"
ARCHIVE = r"incheiat|finalizat|arhiv|ended|closed|expirat"
LIST_PAGE = r"(?:^|/)(?:campanii|campaigns?|promotii|promotions|oferte|ofertele)(?:-[a-z0-9]+){0,4}(?:\.html)?/?$"
USELESS_FILE = r"\.(jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|mp4|css|js)$"
# Press titles about a campaign.
PRESS = (
    r"\bcampani[ae]\b(?!\s+de\s+(?:phishing|frauda|informare|constientizare))|\bpromoti|\bconcurs|\btombol|\bcastig[ai]\b|\bcastigi\b|\bpremii(?:le)?\b|\bpremiaz|\bcashback"
    r"|\bbonus\b|\bvoucher|\breducer|rate\s+fara\s+dobanda|dobanda\s+promotional|oferta\s+special|\bgratuit"
)

_MONTH = "(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\b\.?"
_FULL, _NAMED, _SHORT = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\d)", rf"\d{{1,2}} {_MONTH}(?: \d{{4}}(?!\d))?", r"\d{2}\.\d{2}(?![\d]|[.,/]\d)"
_HOUR = r"(?:,? ?ora \d{1,2}[:.]\d{2}(?:[:.]\d{2})?(?: ?[ap]m)?(?:,? ?ora romaniei)?| ?\(inclusiv\))?"
_BETWEEN = r" ?(?:-|pana (?:la|in|pe)|si(?: pana (?:la|in))?|la) ?(?:data de ?)?(?:ora \d{1,2}[:.]\d{2} ?)?"
_RANGE = rf"(?=\d)(?<![\d.,/])((?:{_FULL}|{_NAMED}|{_SHORT}|\d{{1,2}}(?= ?(?:-|si) ?\d{{1,2}}(?: [a-z]|\.\d))){_HOUR}{_BETWEEN}(?:{_FULL}|{_NAMED}|{_SHORT}))"


def flat(words: Column) -> Column:
    """Folded text on one line, dashes alike."""
    return F.translate(text.fold(text.collapse(words)), "–—‑", "---")


def _end(piece: Column) -> Column:
    """(day, month, year) of a piece of a range; what it doesn't say is null."""
    g = lambda p, i: F.nullif(F.regexp_extract(piece, p, i), F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    number, named = r"^(\d{1,2})[./-](\d{1,2})(?:[./-](\d{4}))?", rf"^(\d{{1,2}}) ({'|'.join(sorted(MONTHS, key=len, reverse=True))})\b\.?(?: (\d{{4}}))?"
    month = F.coalesce(g(number, 2).try_cast("int"), names[g(named, 2)])
    year = F.coalesce(g(number, 3), g(named, 3)).try_cast("int")
    return F.struct(F.regexp_extract(piece, r"^(\d{1,2})", 1).try_cast("int").alias("day"), month.alias("month"), year.alias("year"))


def _date(year: Column, month: Column, day: Column) -> Column:
    made = F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "y-M-d")
    return F.when(year.between(2000, 2100) & month.isNotNull() & day.isNotNull(), made)


def period(words: Column, year: Column | None = None, label: bool = False) -> Column:
    """A campaign's period as a struct (start, end, anchored, year_deduced, one_day), null without a clear one.

    Ranges come first, those near an anchor word before others: a missing year or month is the other end's, and ``year`` (from the address) stands in
    for one that neither has. Then a single end ("until", not of an example), with a start ("from") before it. ``label``: the short text of a link,
    which needs no anchor, and where one complete date is the campaign's day.
    """
    return arrays.let(flat(words), lambda t: period_in(t, year, label))


def period_in(t: Column, year: Column | None = None, label: bool = False) -> Column:
    """``period`` of a text that is ``flat`` already."""
    implied = F.lit(None).cast("int") if year is None else year

    def ranged(place: Column) -> Column:
        split = rf"^({_FULL}|{_NAMED}|{_SHORT}|\d{{1,2}}){_HOUR}{_BETWEEN}({_FULL}|{_NAMED}|{_SHORT})$"
        ends = F.struct(_end(F.regexp_extract(place["found"], split, 1)).alias("a"), _end(F.regexp_extract(place["found"], split, 2)).alias("b"))
        return arrays.let(ends, lambda e: dated(place["at"], e["a"], e["b"]))

    def dated(at: Column, a: Column, b: Column) -> Column:
        end_year = F.coalesce(b["year"], implied)
        start_month = F.coalesce(a["month"], b["month"])
        earlier = (start_month < b["month"]) | ((start_month == b["month"]) & (a["day"] <= b["day"]))
        start_year = F.coalesce(a["year"], F.when(earlier, end_year).otherwise(end_year - 1))
        near = F.substring(t, F.greatest(at - 120, F.lit(1)), F.least(at, F.lit(120)) + 20).rlike(ANCHOR) | F.lit(label)
        return F.struct((~near).alias("loose"), at.alias("at"), _date(start_year, start_month, a["day"]).alias("start"), _date(end_year, b["month"], b["day"]).alias("end"), b["year"].isNull().alias("deduced"))

    every = F.filter(F.transform(text.located(t, _RANGE, 1), ranged), lambda x: x["start"].isNotNull() & x["end"].isNotNull() & (x["start"] <= x["end"]))
    single = rf"({_FULL}|\d{{1,2}} {_MONTH} \d{{4}})"
    value = lambda piece: arrays.let(_end(piece), lambda e: _date(e["year"], e["month"], e["day"]))

    def ending(at: Column) -> Column:
        before = F.substring(t, F.greatest(at - 120, F.lit(1)), F.least(at - 1, F.lit(120)))
        return F.when((at > 0) & before.rlike(ANCHOR) & ~before.rlike(EXAMPLE), value(F.regexp_extract(t, rf"{UNTIL}{single}", 1)))

    until = arrays.let(F.regexp_instr(t, F.lit(rf"{UNTIL}{single}")), ending)
    since = value(F.regexp_extract(t, rf"{SINCE}{single}.{{0,300}}?{UNTIL}{single}", 1))
    days = F.regexp_extract_all(t, F.lit(single), F.lit(1))
    day = F.when(F.size(days) == 1, value(F.get(days, F.lit(0)))) if label else F.lit(None).cast("date")
    make = lambda start, end, anchored, deduced, one: F.struct(start.alias("start"), end.alias("end"), anchored.alias("anchored"), deduced.alias("year_deduced"), one.alias("one_day"))
    no, yes = F.lit(False), F.lit(True)

    def alone(d: Column) -> Column:
        span = make(F.when(d["since"] <= d["until"], d["since"]), d["until"], yes, no, no)
        return F.when(d["until"].isNotNull(), span).when(d["day"].isNotNull(), make(d["day"], d["day"], yes, no, yes))

    return arrays.let(
        F.get(F.array_sort(every), F.lit(0)),
        lambda first: F.when(first.isNotNull(), make(first["start"], first["end"], ~first["loose"], first["deduced"], no))
        .otherwise(arrays.let(F.struct(until.alias("until"), since.alias("since"), day.alias("day")), alone)),
    )


def year_in_url(url: Column) -> Column:
    """The last year among an address' folders."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text.url_path(url), F.lit(r"/(20\d{2})(?=/)"), F.lit(1))), -1).try_cast("int")


def period_in_url(url: Column) -> Column:
    """The period in a document's file name; its year may stand in the folders."""
    name = F.regexp_replace(F.regexp_replace(text.file_name(text.decoded(url)), r"(?i)\.(pdf|html?)$", ""), "_", " ")
    return period(name, year_in_url(url), label=True)


def date_in_url(url: Column) -> Column:
    """The day in an address: ``/2026/09/25/`` or digits in its file name."""
    path = text.url_path(url)
    g = lambda source, p: _date(F.regexp_extract(source, p, 1).try_cast("int"), F.regexp_extract(source, p, 2).try_cast("int"), F.regexp_extract(source, p, 3).try_cast("int"))
    return F.coalesce(g(path, r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)"), g(text.file_name(url), r"(?<!\d)(20\d{2})[-_.]?(\d{2})[-_.]?(\d{2})(?!\d)"))


def benefit(words: Column, *heads: Column, most: int = 300) -> Column:
    """The first sentence that names a benefit and an amount, of the page's heads (description, title, label) and then of its text."""
    sentences = F.filter(F.split(text.collapse(words), r"(?<=[.!?])\s+|\s+[•·▪✓✔]\S*\s+|\s+\*\s+"), lambda s: F.length(s).between(12, 600))
    every = F.concat(F.array_compact(F.array(*heads)), F.coalesce(sentences, F.array().cast("array<string>"))) if heads else sentences
    good = lambda s: arrays.let(text.fold(s), lambda f: f.rlike(AMOUNT) & f.rlike(BENEFIT) & ~f.rlike(NO_BENEFIT))
    return F.left(F.get(F.filter(every, good), F.lit(0)), F.lit(most))


def segment(url: Column, title: Column) -> Column:
    """PF or PJ by the address' path, else by the title; exactly one of them must show."""
    chain = F.lit(None).cast("string")
    for source in (text.fold(F.coalesce(title, F.lit(""))), F.lower(text.url_path(text.decoded(url)))):
        legal, natural = source.rlike(LEGAL), source.rlike(NATURAL)
        chain = F.when(legal & ~natural, "PJ").when(natural & ~legal, "PF").otherwise(chain)
    return chain


def organiser(words: Column, banks: Sequence[str] = (), groups: Sequence[str] = ()) -> Column:
    """banca, grup, schema_card or partener by the first entity after the first mention of an organiser (patterns over folded text); null without one. Names in
    quotation marks don't count, and what follows the first legal form neither; at one place the longer name wins."""
    return organiser_in(flat(words), banks, groups)


def organiser_in(t: Column, banks: Sequence[str] = (), groups: Sequence[str] = ()) -> Column:
    """``organiser`` of a text that is ``flat`` already."""
    t = F.left(t, F.lit(4000))
    after = F.regexp_replace(F.regexp_extract(t, rf"(?:{ORGANISER})(.{{0,300}})", 1), "[„\"“«][^„\"“”«»]{0,200}[”\"“»]", " ")
    named = [(kind, p) for kind, patterns in (("grup", groups), ("banca", banks), ("schema_card", (SCHEME,))) for p in patterns]

    def first_named(near: Column) -> Column:
        found = F.array(*(F.struct(F.regexp_instr(near, F.lit(p)).alias("at"), (-F.length(F.regexp_substr(near, F.lit(p)))).alias("n"), F.lit(kind).alias("kind")) for kind, p in named))
        return F.get(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), F.lit(0))["kind"]

    def of(window: Column) -> Column:
        formed = F.nullif(F.regexp_extract(window, rf"^(.*?{LEGAL_FORM})", 1), F.lit(""))
        return arrays.let(formed, lambda f: F.coalesce(arrays.let(F.coalesce(f, window), first_named), F.when(f.isNotNull(), "partener")))

    return arrays.let(after, of)


def has_added_act(words: Column) -> Column:
    """Is there an additional act or an extension, not only the possibility of one?"""
    return has_added_act_in(flat(words))


def has_added_act_in(t: Column) -> Column:
    """``has_added_act`` of a text that is ``flat`` already."""
    return F.coalesce(t.rlike(rf"(?=(?:{ADDED_ACT}))(?<!(?:{CONDITION}).{{0,80}})"), F.lit(False))


def is_open_ended(words: Column) -> Column:
    return is_open_ended_in(flat(words))


def is_open_ended_in(t: Column) -> Column:
    """``is_open_ended`` of a text that is ``flat`` already."""
    return F.coalesce(t.rlike(OPEN_ENDED), F.lit(False))


def press_word(title: Column) -> Column:
    """The word by which a press title is about a campaign; null if it isn't."""
    return F.nullif(F.regexp_extract(text.fold(title), f"({PRESS})", 1), F.lit(""))


def candidates(links: DataFrame, hosts: Sequence[str], strict: bool = False) -> DataFrame:
    """Of a page's links (page_url, url, text) those to campaigns, with their role: regulament, act_aditional, landing, or lista for list pages.

    Addresses must be on one of the ``hosts``. On a hub (not ``strict``) pages below it count whatever their words; documents count by their words only.
    """
    path, words = F.lower(text.url_path(text.decoded(F.regexp_replace("url", "[?#].*$", "")))), text.fold(F.coalesce("text", F.lit("")))
    document = path.rlike(r"\.pdf$")
    prefix = F.concat(F.regexp_replace(F.regexp_replace(F.lower(text.url_path(F.regexp_replace("page_url", "[?#].*$", ""))), r"\.html?$", ""), "/+$", ""), F.lit("/"))
    below = F.lit(False) if strict else (F.length(prefix) > 1) & path.startswith(prefix)
    worded = path.rlike(CAMPAIGN_URL) | words.rlike(CAMPAIGN_TEXT)
    listed = ~document & path.rlike(LIST_PAGE) & ~path.rlike(ARCHIVE)
    taken = F.when(document, F.concat_ws(" ", path, words).rlike(RULES_DOCUMENT) | worded).otherwise(listed | below | worded)
    role = F.when(listed, "lista").when(~document, "landing").when(F.concat_ws(" ", path, words).rlike(ACT_DOCUMENT), "act_aditional").otherwise("regulament")
    site = F.regexp_replace(text.url_host(F.col("url")), r"^www\.", "")
    rows = links.where(site.isin(*hosts) & ~path.rlike(USELESS_FILE) & (text.canonical_url(F.col("url")) != text.canonical_url(F.col("page_url"))) & taken)
    return rows.withColumn("role", role)


def unified(members: DataFrame) -> DataFrame:
    """Members of campaigns (campaign, url, label, hub): a document that is a campaign of its own and another's document stays with the other only; what a hub
    or label says of it moves there."""
    child = members.where("url <> campaign").groupBy(F.col("url").alias("__key")).agg(F.max("campaign").alias("__parent"))
    alone = members.groupBy(F.col("campaign").alias("__key")).agg(F.bool_and(F.col("url") == F.col("campaign")).alias("__alone")).where("__alone").select("__key")
    moved = child.join(alone, "__key").where("__parent <> __key")
    rows = members.join(moved, F.col("campaign") == F.col("__key"), "left")
    stays = F.col("__parent").isNull() | F.col("hub").isNotNull() | F.col("label").isNotNull()
    return rows.where(stays).select(F.coalesce("__parent", "campaign").alias("campaign"), *(c for c in members.columns if c != "campaign"))


def press_items(links: DataFrame, prefix: str | None = None, least: int = 15) -> DataFrame:
    """(page_url, url, title, published) of a press list's links (page_url, url, text): the longest text of each address is its title, the day in the address
    its date. With a ``prefix`` of paths shorter titles count too."""
    path = text.url_path(F.regexp_replace("url", "[?#].*$", ""))
    words = text.collapse(F.col("text"))
    fits = (path.startswith(prefix) & (F.length(words) >= 8)) if prefix else (F.length(words) >= least) & ~F.col("url").rlike(r"[?&]page=|/page/\d|\.pdf([?#]|$)") & (F.regexp_replace(path, "/+$", "") != "")
    rows = links.where(fits & (F.col("url") != F.col("page_url"))).select("page_url", text.canonical_url(F.regexp_replace("url", "#.*$", "")).alias("url"), words.alias("title"))
    best = rows.groupBy("page_url", "url").agg(F.max_by("title", F.struct(F.length("title"), F.col("title"))).alias("title"))
    return best.withColumns({"title": F.left("title", F.lit(300)), "published": date_in_url(F.col("url"))})
