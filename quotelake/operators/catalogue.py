"""Prices out of a catalogue's sentences: what a small grammar reads, and every other figure with the reason why it wasn't read.

A text is cut into segments, which put together are the text: values, figures left unread, and what stands between. One pass over the figures in order decides each by
the words around it and by whether an interest clause is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import arrays, text
from quotelake.functions import vocabulary as V

_SEGMENT = "struct<kind:string,fragment:string,concept:string,value:double,term:string,detail:string,reason:string>"
#: The pattern's groups that are used.
_GROUPS = ((1, "fee"), (3, "first"), (4, "pair"), (5, "term"), (6, "no_end"), (8, "free"))
#: Stands between groups; no text that is read holds it.
_MARK = "\x01"


def _figures() -> str:
    """All figures in one pattern."""
    n, times = V.CATALOGUE_NUMBER, V.CATALOGUE_TIMES
    fee = rf"\b{V.SUBSCRIPTION}(?:\s+\p{{L}}+)?\s+({n})\s*lei\s*/\s*lun[ăa]\b"
    rate = rf"~?({n})\s*%(\s*/\s*~?(?:{n})\s*%)?(?:\s*p\.\s?a\.)?(?:\s+(?:la\s+)?(\d+(?:\s*[-–]\s*\d+)?\s+luni)\b|\s+(nelimitat))?"
    span = rf"(~?(?:{n})\s*%?\s*[–-]\s*~?(?:{n})\s*%)"
    amount = rf"~?(?:{n})(?:{times}(?:\s*[–-]\s*~?(?:{n})(?:{times})?)?(?:\s*{V.CATALOGUE_MONEY})?|\s*[–-]\s*~?(?:{n}){times}(?:\s*{V.CATALOGUE_MONEY})?|(?:\s*[–-]\s*~?(?:{n}))?\s*{V.CATALOGUE_MONEY})"
    return rf"(?:{fee}|{span}|{rate}|(?<![\d.,])({amount})|({V.CATALOGUE_FREE}))"


def single_term(*words: Column) -> Column:
    """``7 luni`` if the texts name one term only."""
    terms = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(w, F.lit("")), F.lit(r"\b(\d+)\s+luni\b"), F.lit(1)) for w in words))))
    return F.when(F.size(terms) == 1, F.concat(terms[0], F.lit(" luni")))


def unread_reason(before: Column, after: Column, fragment: Column) -> Column:
    """Why a figure isn't read, by the 45 characters before and the 25 after it."""
    before, after = F.lower(before), F.lower(after)
    said = F.lit(None).cast("string")
    for where, pattern, reason in reversed(V.UNREAD):
        hit = {"before": before, "after": after, "figure": fragment}[where].rlike(V.I + pattern)
        said = F.when(hit, F.lit(reason)).otherwise(said)
    return F.coalesce(said, F.lit(V.UNREAD_OTHERWISE))


def catalogue_segments(words: Column, name: Column, category: Column) -> Column:
    """The text as an array of segments (kind ``value``, ``unread`` or ``text``; fragment; concept, value, term, detail of values; reason of the unread)."""
    whole = F.coalesce(words, F.lit(""))
    pattern = _figures()
    rates = F.when(category == "DEPOZITE", "depozite").when(category.startswith("CREDIT_"), "credite")
    none = F.lit(None).cast("string")

    def segment(kind: str, fragment: Column, concept: Column = none, value: Column | None = None, term: Column = none, detail: Column = none, reason: Column = none) -> Column:
        number = F.lit(None).cast("double") if value is None else value
        return F.struct(F.lit(kind).alias("kind"), fragment.alias("fragment"), concept.alias("concept"), number.alias("value"), term.alias("term"), detail.alias("detail"), reason.alias("reason")).cast(_SEGMENT)

    def number(s: Column) -> Column:
        return F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")

    def parsed(state: Column, place: Column) -> Column:
        """A figure taken apart, and the text since the last one."""
        gap = F.substring(whole, state["at"] + 1, place["at"] - 1 - state["at"])
        # all groups by one match
        marked = F.regexp_replace(place["found"], rf"{V.I}^{pattern}$", "".join(f"{_MARK}${k}" for k, _ in _GROUPS))
        group = lambda parts, i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        return arrays.let(F.split(marked, _MARK), lambda p: F.struct(place["found"].alias("figure"), gap.alias("gap"), *(group(p, i).alias(n) for i, (_, n) in enumerate(_GROUPS, 1))))

    def step(state: Column, place: Column) -> Column:
        return arrays.let(parsed(state, place), lambda m: read_piece(state, m))

    def read_piece(state: Column, m: Column) -> Column:
        gap, figure = m["gap"], m["figure"]
        word = F.regexp_extract(gap, rf"{V.I}(?s)^.*({V.INTEREST})", 1)
        link = F.when(word != "", F.regexp_extract(gap, rf"{V.I}(?s)^.*{V.INTEREST}(.*)$", 1)).otherwise(gap)
        ended = link.rlike(V.CLAUSE_END)
        opens = (word != "") & ~ended & (F.length(link) <= V.FIRST_LINK)
        goes_on = (word == "") & state["open"].isNotNull() & ~ended & (F.length(link) <= V.NEXT_LINK)
        concept = F.when(word == "DAE", "dae").when(word != "", "nominala").otherwise(state["open"])
        is_rate = (m["first"] != "") & (opens | goes_on) & rates.isNotNull()
        term = F.when(m["term"] != "", F.regexp_replace(m["term"], r"\s*[-–]\s*", "-")).when(m["no_end"] != "", m["no_end"]).otherwise(single_term(words, name))
        detail = F.nullif(F.concat_ws("; ", F.when(figure.startswith("~"), V.ABOUT), F.when(opens & link.contains("de la"), V.AT_LEAST)), F.lit(""))
        at = state["at"] + F.length(gap)
        before, after = F.substring(whole, F.greatest(at - 44, F.lit(1)), F.least(at, F.lit(45))), F.substring(whole, at + F.length(figure) + 1, F.lit(25))
        account = category.isin(*V.ACCOUNTS)
        read = (
            F.when((m["fee"] != "") & account, segment("value", figure, F.lit("administrare_cont"), number(m["fee"]), F.lit("lunar")))
            .when(m["fee"] != "", segment("unread", figure, reason=F.concat(F.lit(V.UNREAD_FEE), F.coalesce(category, F.lit("")))))
            .when(is_rate & (m["pair"] != ""), segment("unread", figure, reason=F.lit(V.UNREAD_PAIR)))
            .when(is_rate, segment("value", figure, concept, number(m["first"]), term, detail))
            .when(m["free"] != "", segment("unread", figure, reason=F.lit(V.UNREAD_FREE)))
            .otherwise(segment("unread", figure, reason=unread_reason(before, after, figure)))
        )
        found = F.concat(state["found"], F.when(gap != "", F.array(segment("text", gap))).otherwise(F.array().cast(f"array<{_SEGMENT}>")), F.array(read))
        return F.struct(F.when(is_rate, concept).alias("open"), (state["at"] + F.length(gap) + F.length(figure)).alias("at"), found.alias("found"))

    start = F.struct(none.alias("open"), F.lit(0).alias("at"), F.array().cast(f"array<{_SEGMENT}>").alias("found"))
    done = F.aggregate(text.located(whole, V.I + pattern), start, step)

    def finished(d: Column) -> Column:
        rest = F.substring(whole, d["at"] + 1, F.length(whole))
        return F.when(rest != "", F.array_append(d["found"], segment("text", rest))).otherwise(d["found"])

    return arrays.let(done, finished)


def catalogue_values(products: DataFrame, words: str = "words", name: str = "name", category: str = "category") -> DataFrame:
    """A row for each segment of each product's text: the product's columns, ``piece`` (from 0), and the segment's fields. Rows of kind ``value`` are the prices, those of kind
    ``unread`` the figures left with their reasons; all fragments in order of ``piece`` are the text. A null or empty text has no row."""
    cut = catalogue_segments(F.col(words), F.col(name), F.col(category))
    return products.select("*", F.posexplode(cut).alias("piece", "__s")).select(*products.columns, "piece", "__s.*")
