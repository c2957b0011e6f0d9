"""Text and URL functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions import rules

# Latin letters with marks and what they turn into, length for length.
MARKED = "àáâãäåāăąçćčďèéêëēĕęěìíîïīĭįñńňòóôõöōŏőŕřśşšșţťțùúûüūŭůűýÿźżž"
PLAIN_ = "aaaaaaaaacccdeeeeeeeeiiiiiiinnnoooooooorrsssstttuuuuuuuuyyzzz"
# Parameters that only track.
TRACKING = ("gclid", "dclid", "gbraid", "wbraid", "fbclid", "msclkid", "_hsenc", "_hsmi")
TRACKING_PREFIXES = ("utm_", "gad_", "sfmc_", "mc_")
# Month names as they stand in file names (Romanian and English).
MONTHS = (
    "ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie",
    "january", "february", "march", "april", "may", "june", "july", "september", "october", "november", "december",
)
# What a short name leaves out.
SHORT_NAME_ENDS = r" — .*| N\.V\..*| S\.A\..*| EAD .*"
SPACE = r"[\s ]+"


def fold(text: Column) -> Column:
    """Lower case without marks; letter for letter, so offsets stay."""
    return F.translate(F.lower(text), MARKED, PLAIN_)


def cedilla_to_comma(text: Column) -> Column:
    return F.translate(text, "şţŞŢ", "șțȘȚ")


def collapse(text: Column) -> Column:
    """White space, no-break spaces included, as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def part(text: Column, separator: str, n: int) -> Column:
    """The n-th part (from 1) of a delimited text; empty where there is none."""
    return F.split_part(text, F.lit(separator), F.lit(n))


def has_item(text: Column, item: str, separator: str = "[|]") -> Column:
    """Is the item one of a delimited text's? Null text has none."""
    return F.array_contains(F.split(F.coalesce(text, F.lit("")), separator), item)


def items(text: Column, separator: str = "[|]") -> Column:
    """Trimmed, non-empty items of a delimited text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def decoded(url: Column, times: int = 2) -> Column:
    """Percent-decoded; a plus sign stays, and what can't be decoded stays as it was."""
    for _ in range(times):
        url = F.coalesce(F.try_url_decode(F.regexp_replace(url, r"\+", "%2B")), url)
    return url


def url_path(url: Column) -> Column:
    return F.regexp_replace(url, "^[a-z]+://[^/]*", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1))


def canonical_url(url: Column) -> Column:
    """Lower-case host, no tracking parameters (the others keep their order and the fragment stays), no slash at the end."""
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"[?](.*)$", 1)
    base = F.regexp_replace(bare, r"[?].*$", "")
    host = F.regexp_extract(base, "^([a-zA-Z]+://[^/]*)", 1)
    tracked = "^(?i)(" + "|".join([*(f"{t}(=|$)" for t in TRACKING), *TRACKING_PREFIXES]) + ")"
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracked)), "&")
    path = F.regexp_replace(F.substr(base, F.length(host) + F.lit(1)), "/+$", "")
    return F.concat(F.lower(host), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), fragment)


def file_name(url: Column) -> Column:
    """The last segment of the path, without query and fragment."""
    return F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")


def family_key(name: Column) -> Column:
    """What the versions of one document share: the name without hashes, dates, months, years and version marks, joined by ``_``."""
    text = fold(stem(file_name(name)))
    text = F.regexp_replace(text, "^[0-9a-f]{8,}[_-]", "")
    text = F.regexp_replace(text, "[^a-z0-9]+", "_")
    text = F.regexp_replace(text, "(?<![a-z])(" + "|".join(MONTHS) + ")(?![a-z])", "_")
    text = F.regexp_replace(text, "(?<![a-z])(vers(iune|iunea|ion)?|v)_?[0-9]*(?![a-z])", "_")
    text = F.regexp_replace(text, "(?<![0-9])[0-9]{1,2}_[0-9]{1,2}_(20)?[0-9]{2}(?![0-9])|(?<![0-9])(20[0-9]{2})[0-9_]*|(?<![0-9])[0-9]{6,8}(?![0-9])", "_")
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")


def anchor(url: Column, page: Column, quote: Column, limit: int = 60) -> Column:
    """A link to the evidence: the page (if it is known) and a search in a PDF, else a text fragment
    (of more than eight characters); the quote is cut at its last blank within ``limit``."""
    text = collapse(quote)
    cut = F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(F.substring(text, 1, limit), r"\s+\S*$", ""))
    coded = F.regexp_replace(F.url_encode(cut), r"\+", "%20")
    known = F.coalesce(coded, F.lit("")) != ""
    pdf = F.lower(url).rlike(r"\.pdf([?#]|$)")
    in_pdf = F.when(page.isNotNull(), F.concat(F.lit("#page="), page.cast("string"), F.when(known, F.concat(F.lit("&search="), coded)).otherwise(""))).otherwise("")
    in_page = F.when(known & (F.length(cut) > 8), F.concat(F.lit("#:~:text="), coded)).otherwise("")
    return F.when(url.isNotNull(), F.concat(F.regexp_replace(url, "#.*$", ""), F.when(pdf, in_pdf).otherwise(in_page)))


def fingerprint(text: Column, digits: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(digits))


def pseudonym(name: Column, salt: str, digits: int = 32) -> Column:
    """A salted pseudonym; null names stay null."""
    return F.when(name.isNotNull(), fingerprint(F.concat(F.lit(f"{salt}|"), name), digits))


def signature(text: Column, stop: tuple[str, ...] = (), cut: int = 6, most: int = 4) -> Column:
    """Sorted word beginnings without stop words, the first few joined: texts that say the same thing share it."""
    words = F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)
    return F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, cut)))), 1, most), " ")


def label_faults(label: Column, connectors: tuple[str, ...] = ("de", "si", "la", "cu", "in", "pe", "of", "and", "the", "for")) -> Column:
    """Why a label may be a fragment: an array of reasons, empty for a good one."""
    return rules.reasons(
        ("too_short", F.length(F.trim(label)) < 4),
        ("too_long", F.length(label) > 100),
        ("starts_lower", label.rlike("^[a-zăâîșț]")),
        ("ends_with_connector", F.lower(label).rlike(r"(^|\s)(" + "|".join(connectors) + r")\s*$")),
        ("holds_price", label.rlike(r"(?i)\d\s*(%|lei|ron|eur|usd)")),
    )


def xml_unescaped(text: Column) -> Column:
    for coded, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def masked_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "#")


def count_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of a text's words, whole runs of letters and digits of any alphabet, are among these."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.isin(*words)))


def language_share(text: Column, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """Share of the first language's stop words among both languages'; null if there are none."""
    a, b = count_of(text, first), count_of(text, second)
    return F.try_divide(a.cast("double"), (a + b).cast("double"))


def is_translation(text: Column, first: tuple[str, ...], second: tuple[str, ...], share: float = 0.85, least: int = 5) -> Column:
    """Are at least ``least`` words of the first language there, and at least that share?"""
    return F.coalesce((count_of(text, first) >= least) & (language_share(text, first, second) >= share), F.lit(False))


def quote_found(quote: Column, page: Column, length: int = 25) -> Column:
    """Does the page hold the quote's beginning? White space and case don't count; an empty quote isn't found."""
    start = F.substring(F.lower(without_space(quote)), 1, length)
    return F.coalesce((start != "") & F.contains(F.lower(without_space(page)), start), F.lit(False))


def like_any(text: Column, *patterns: str) -> Column:
    """LIKE ANY: does one of the patterns match? A null text matches none."""
    return F.coalesce(reduce(lambda a, b: a | b, (text.like(p) for p in patterns)), F.lit(False))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in order, as structs (found, at): what the match or its group holds and where it stands, from 1.

    One pass finds the matches; each is then looked up behind the one before it, which is much cheaper than a pattern that also takes in the text between.
    """
    none = F.array().cast("array<struct<found:string,at:int>>")

    def step(state: Column, found: Column) -> Column:
        at = F.call_function("locate", found, text, state["next"]).cast("int")
        return F.struct((at + F.length(found)).cast("int").alias("next"), F.array_append(state["out"], F.struct(found.alias("found"), at.alias("at"))).alias("out"))

    start = F.struct(F.lit(1).alias("next"), none.alias("out"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), start, step, lambda state: state["out"])


def short_name(name: Column) -> Column:
    """A bank's name as it heads a column: without its group and legal form."""
    return F.regexp_replace(name, SHORT_NAME_ENDS, "")


def field_label(field: Column, labels: dict[str, str], ends: dict[str, str]) -> Column:
    """A field's label; a field that ends in ``_min`` or ``_max`` has its base's label and the end's; any other is its name with blanks."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    last = F.create_map(*(F.lit(x) for pair in ends.items() for x in pair))
    base, end = F.regexp_extract(field, "^(.+)_(min|max)$", 1), F.regexp_extract(field, "^(.+)_(min|max)$", 2)
    return F.coalesce(known[field], F.concat(known[base], F.lit(" · "), last[end]), F.replace(field, F.lit("_"), F.lit(" ")))
