"""Typed rows out of text lines: rates, fees, thresholds and points. All by column expressions; patterns are data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import arrays, numbers, rules, text
from quotelake.functions import vocabulary as V

_RATE = "struct<kind:string,value:double,instalments:int,column:int>"


def _rate(kind: Column, value: Column, instalments: Column | None = None, column: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(kind.alias("kind"), value.alias("value"), (none if instalments is None else instalments).alias("instalments"), (none if column is None else column).alias("column")).cast(_RATE)


def _signs_of(pattern: str) -> int:
    """What a line must hold, in small letters, for a pattern of ``RATES`` to match, a bit for each: those of ``RATE_WORDS`` and ``RATE_MARKS`` that stand in the pattern, and
    what follows a percentage if it begins with one."""
    there = [w in pattern.lower() for w in V.RATE_WORDS] + [written in pattern for written in V.RATE_MARKS] + [pattern.startswith(rf"({V.NUMBER})\s*%")]
    return sum(1 << k for k, t in enumerate(there) if t)


def _signs_in(text: Column) -> Column:
    """The signs of a text in small letters."""
    tests = [*(F.contains(text, F.lit(w)) for w in (*V.RATE_WORDS, *V.RATE_MARKS.values())), text.rlike(V.AFTER_PERCENT)]
    return reduce(lambda x, y: x.bitwiseOR(y), (F.when(test, F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(tests)))


def _percent(number: Column) -> Column:
    """``numbers.decimal_number`` of a percentage for what ``NUMBER`` matches: no blanks, one mark at most."""
    value = F.translate(number, ",", ".").try_cast("double")
    thousands = (F.length(number) == 7) & number.rlike(r"^\d{3}[.,]") & (value > 100)
    return F.when(thousands, F.translate(number, ".,", "").try_cast("double")).otherwise(value)


def _matches(text: Column, pattern: str, group: int, odd: Column | None = None) -> Column:
    """All matches. A text in small letters needs no pattern without regard to case, which is slower; one that ``odd`` tells of isn't."""
    whole = F.regexp_extract_all(text, F.lit(V.I + pattern), F.lit(group))
    return whole if odd is None else F.when(odd, whole).otherwise(F.regexp_extract_all(text, F.lit(pattern.lower()), F.lit(group)))


def _row_kind(head: Column, odd: Column | None = None, may: Sequence[Column] | None = None) -> Column:
    """The kind of the first pattern of ``RATES`` that matches across the border of a row's first two cells; only patterns that ``may``, as far as it tells."""
    across = [F.contains(F.array_join(_matches(head, pattern, 0, odd), ""), F.lit("\t")) for _, pattern in V.RATES]
    return F.coalesce(*(F.when(test if may is None else may[k] & test, F.lit(kind)) for k, ((kind, _), test) in enumerate(zip(V.RATES, across, strict=True))))


def _head(line: Column) -> Column:
    """A line's first two cells, if it has more; else null."""
    return arrays.let(F.substring_index(line, "\t", 2), lambda head: F.when(F.length(head) < F.length(line), head))


def _with_columns(line: Column, found: Column, kind: Column | None = None) -> Column:
    """Adds the values of a table row's further cells, under the kind of the rate whose wording begins in the label cell and ends in the first value cell."""
    kind = _row_kind(_head(line)) if kind is None else kind
    any_percent = rf"(?<![\d.,])({V.NUMBER})\s*%"
    state = F.struct(F.lit(True).alias("on"), F.array().cast("array<array<struct<v:double,i:int>>>").alias("out"))

    def step(acc: Column, cell: Column) -> Column:
        percents = F.contains(cell["c"], F.lit("%"))
        rest = F.trim(F.when(percents, F.regexp_replace(cell["c"], any_percent, " ")).otherwise(cell["c"]))
        goes_on = acc["on"] & arrays.let(rest, lambda r: (F.length(r) <= 28) & ((r == "") | ~r.rlike(V.I + V.NEW_LABEL)))
        values = F.transform(F.regexp_extract_all(cell["c"], F.lit(any_percent), F.lit(1)), lambda v: F.struct(_percent(v).alias("v"), cell["i"].alias("i")))
        more = F.when(percents, F.array_append(acc["out"], values)).otherwise(acc["out"])
        return F.when(goes_on, F.struct(F.lit(True).alias("on"), more.alias("out"))).otherwise(F.struct(F.lit(False).alias("on"), acc["out"].alias("out")))

    numbered = F.filter(F.transform(F.split(line, "\t"), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["i"] >= 2)
    more = F.aggregate(numbered, state, step, lambda acc: F.flatten(acc["out"]))

    def add(k: Column) -> Column:
        near = lambda acc, x: F.exists(acc, lambda y: F.abs(y["value"] - x["v"]) < 0.001)
        return F.when(k.isNull(), found).otherwise(F.aggregate(more, found, lambda acc, x: F.when(x["v"].isNull() | near(acc, x), acc).otherwise(F.array_append(acc, _rate(k, x["v"], column=x["i"])))))

    return F.when(F.size(found) > 0, arrays.let(kind, add)).otherwise(found)


def rates_in(lines: DataFrame, line: str = "line") -> tuple[DataFrame, Column]:
    """``lines`` with the steps' columns, and over these each line's rates: an array of structs (kind, value, instalments, column), in the order of the patterns; null if there are none.

    A line about something else (an advance, a tax, a discount ...) has none. Instalments without interest are one rate of 0. A value that an
    earlier pattern took isn't taken again. In a table row, values in the cells after the first value go on under its kind, up to a cell that
    is long or begins another measure.

    A pattern is tried only where the words and marks stand that it can't do without, which is much cheaper to see, and in small letters. Each step is a column, so that Spark
    compiles it; only what was found is gone through in lambdas. The rates are no column: Spark would infer a filter from exploding one and write all steps into it again.
    """
    c = lambda name: F.col(f"__{name}")
    own = [F.col(f"`{x}`") for x in lines.columns]

    def tried(words: Sequence[str], patterns: Sequence[str]) -> Column:
        there = c("odd") | F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c("text"), w))
        return F.when(there, c("text").rlike(V.I + "|".join(f"(?:{p})" for p in patterns))).otherwise(False)

    odd = reduce(or_, (F.contains(F.col(line), F.lit(x)) for x in V.ODD_LETTERS))
    read = lines.select(*own, odd.alias("__odd"), F.when(odd, F.col(line)).otherwise(F.lower(F.col(line))).alias("__text"))
    read = read.select(*own, "__odd", "__text", tried(V.NO_RATES_WORDS, V.NO_RATES).alias("__excluded"), tried(V.INSTALMENTS_WORDS, V.INSTALMENTS).alias("__promo"))
    all_signs = (1 << len(V.RATE_WORDS) + len(V.RATE_MARKS) + 1) - 1
    signs = F.when(c("excluded") | c("promo") | c("text").isNull(), 0).when(c("odd"), all_signs).otherwise(_signs_in(c("text")))
    read = read.select(*own, "__odd", F.when(~c("excluded"), c("text")).alias("__text"), (c("promo") & ~c("excluded")).alias("__promo"), signs.alias("__signs"))

    may = [c("signs").bitwiseAND(F.lit(need)) == need for need in (_signs_of(pattern) for _, pattern in V.RATES)]
    none = F.array().cast(f"array<{_RATE}>")

    def of_kind(kind: str, pattern: str, test: Column) -> Column:
        if kind.endswith("_valoare") and pattern.endswith(r"\)"):
            # brackets after a margin and an index hold the total
            test = test & ~c("text").rlike(V.I + V.TOTAL_IN_BRACKETS)
        return F.when(test, F.transform(_matches(c("text"), pattern, 1, c("odd")), lambda v: _rate(F.lit(kind), _percent(v)))).otherwise(none)

    every = F.flatten(F.array(*(of_kind(kind, pattern, test) for (kind, pattern), test in zip(V.RATES, may, strict=True))))
    read = read.select(*own, "__odd", "__text", "__promo", "__signs", F.when(c("signs") > 0, every).alias("__every"), F.when(F.contains(c("text"), F.lit("\t")), _head(c("text"))).alias("__head"))

    again = lambda acc, x: F.exists(acc, lambda y: F.abs(y["value"] - x["value"]) <= 0.001)
    once = F.aggregate(c("every"), none, lambda acc, x: F.when(x["value"].isNull() | again(acc, x), acc).otherwise(F.array_append(acc, x)))
    kind = F.when(c("head").isNotNull() & (F.size(c("every")) > 0), _row_kind(c("head"), c("odd"), may))
    read = read.select(*own, "__text", "__promo", F.when(F.size(c("every")) > 0, once).alias("__once"), kind.alias("__kind"))
    count = F.coalesce(*(F.regexp_extract(c("text"), V.I + p, 1).try_cast("int") for p in V.INSTALMENTS))
    free = F.array(_rate(F.lit("rate_fara_dobanda"), F.lit(0.0), count))
    return read, F.when(c("promo"), free).when(c("kind").isNull(), c("once")).otherwise(_with_columns(c("text"), c("once"), c("kind")))


def extract_rates(lines: DataFrame, line: str = "line") -> DataFrame:
    """A row for each rate: the line's columns, kind, value, instalments, column, currency, period, low and high of a stated interval, plausible."""
    n = V.NUMBER
    between = rf"{V.I}(?:de\s+la|[îi]ntre)\s+({n})\s*%\s*(?:[-–—]|[șs]i|la|p[âa]n[ăa]\s+la)\s*({n})\s*%"
    own = [F.col(f"`{x}`") for x in lines.columns]
    read, rates = rates_in(lines, line)
    found = read.select(*own, F.explode(rates).alias("__r")).select(*own, "__r.*")
    limit = F.create_map(*(F.lit(x) for k, (a, b) in V.INTERVALS.items() for x in (k, f"{a},{b}")))
    ends = F.split(limit[F.col("kind")], ",")
    currency = F.upper(F.regexp_extract(F.col(line), V.I + V.CURRENCY, 1))
    period = F.regexp_extract(F.col(line), V.I + V.PERIOD, 1)
    return found.withColumns(
        {
            "currency": F.when(currency == "EURO", "EUR").when(currency != "", currency),
            "period": F.when(period != "", period),
            "low": numbers.decimal_number(F.regexp_extract(F.col(line), between, 1), True),
            "high": numbers.decimal_number(F.regexp_extract(F.col(line), between, 2), True),
            "plausible": F.col("value").between(ends[0].cast("double"), ends[1].cast("double")),
        }
    )


def fee_frequency(found: Column) -> Column:
    """How often a fee is due, by what ``FREQUENCY`` found: the usual name, or ``pe`` and the words."""
    said = F.lower(F.coalesce(*(F.nullif(text.collapse(F.regexp_extract(found, V.I + V.FREQUENCY, k)), F.lit("")) for k in (1, 2, 3))))
    usual = F.create_map(*(F.lit(x) for pair in V.FREQUENCIES.items() for x in pair))
    return F.when(found != "", F.coalesce(usual[said], F.concat(F.lit("pe "), said)))


def is_free(line: Column) -> Column:
    """Does a line without figures say that nothing is due?"""
    included = (line.rlike(V.I + V.FREE) | line.rlike(V.I + V.FREE_INCLUDED) | line.rlike(V.FREE_INCLUDED_LOWER)) & ~line.rlike(r"\d") & ~line.rlike(V.I + V.INCLUDED_HEADING)
    return line.rlike(V.I + V.ZERO_IN_WORDS) | included


def extract_fees(lines: DataFrame, line: str = "line") -> DataFrame:
    """A row for each fee of each line: the line's columns, kind, value, currency, role, frequency, band.

    The line's first band (``peste 1.000 lei``, ``0 - 49.999 lei``) is cut out; its sums are no fees. A percentage is comision_procent, a sum comision_suma; a currency may
    stand before its sum at the line's start or after min or max. The role is the last such word among the ROLE_REACH characters before the figure, so each figure has its
    own. A line without figures that says so is gratuit. Each step is a column, so that Spark compiles it; inside lambdas it would be interpreted for every line.
    """
    percent, amount = r"(?<![\d.,])(\d{1,3}(?:[.,]\d+)?)\s*%", rf"(?<!\d)(?<!\d[.,])({V.MONEY})\s*({V.MONEY_WORD})"
    inverse = rf"(?:^|\b(?:min|max|minim|maxim|minimum|maximum)\b\.?)\s*({V.MONEY_WORD})\s+({V.MONEY})"
    # a figure begins with a digit, with min or max, or the line
    scan = rf"{V.I}(?=[\dm]|^)(?:{percent}|{amount}(?!\p{{L}})|{inverse}(?![\d.,])(?!\s*{V.MONEY_WORD}(?!\p{{L}})))"
    currencies = F.create_map(*(F.lit(x) for pair in V.CURRENCIES.items() for x in pair))
    c = lambda name: F.col(f"__{name}")

    joined = F.col(line)
    for name in V.SPACED_CURRENCIES:  # "0 L E I"
        joined = F.regexp_replace(joined, r"(?<!\p{L})" + r"\s+".join(name) + r"(?!\p{L})", name)
    spaced = F.col(line).rlike("[" + "".join(w[0] for w in V.SPACED_CURRENCIES) + r"]\s+[" + "".join(w[1] for w in V.SPACED_CURRENCIES) + "]")
    after = lambda n: F.substring(c("whole"), F.length(c("before")) + 1 + n, F.length(c("whole")))
    banded = (
        lines.withColumn("__whole", F.when(spaced, joined).otherwise(F.col(line)))
        .withColumn("__before", F.regexp_extract(c("whole"), rf"{V.I}(?s)^.*?(?={V.BAND})", 0))
        .withColumn("__cut", F.regexp_extract(after(F.lit(0)), rf"{V.I}^{V.BAND}", 0))
        .withColumn("__rest", F.when(c("cut") != "", F.concat(c("before"), F.lit(" "), after(F.length(c("cut"))))).otherwise(c("whole")))
        .withColumn("__often", F.regexp_extract(c("rest"), V.I + V.FREQUENCY, 0))
    )
    # a figure holds one number and, unless it is a percentage, one currency on either side of it; the empty figure is a fee of nothing
    valued = F.transform(text.located(c("rest"), scan), lambda f: F.struct(f["found"].alias("found"), f["at"].alias("at"), numbers.decimal_number(f["found"], f["found"].endswith("%")).alias("value")))
    nothing = F.array(F.struct(F.lit("").alias("found"), F.lit(0).alias("at"), F.lit(0.0).alias("value")))
    own = [F.col(f"`{x}`") for x in lines.columns]
    band = F.when(c("cut") != "", text.collapse(c("cut")))
    placed = banded.select(*own, "__rest", fee_frequency(c("often")).alias("__frequency"), band.alias("__band"), F.filter(valued, lambda f: f["value"].isNotNull()).alias("__all"))
    each = placed.select("*", F.explode(F.when(F.size(c("all")) > 0, c("all")).when(is_free(c("rest")), nothing)).alias("__f"))
    figure, percentage = c("f")["found"], c("f")["found"].endswith("%")
    seen = F.substring(c("rest"), F.greatest(c("at") - V.ROLE_REACH, F.lit(1)), F.least(c("at") - 1, F.lit(V.ROLE_REACH)))
    said = F.lower(F.try_element_at(F.regexp_extract_all(seen, F.lit(V.I + V.ROLE), F.lit(1)), F.lit(-1)))
    fees = each.withColumn("__at", c("f")["at"] + F.regexp_instr(figure, F.lit(r"\d")) - 1).withColumn("__said", said)
    return fees.select(
        *own,
        F.when(figure == "", "gratuit").when(percentage, "comision_procent").otherwise("comision_suma").alias("kind"),
        c("f")["value"].alias("value"),
        F.when(~percentage, currencies[F.lower(F.regexp_extract(figure, V.I + V.MONEY_WORD, 0))]).alias("currency"),
        F.when(c("said").startswith("min") | c("said").contains("pu"), "min").when(c("said").isNotNull(), "max").alias("role"),
        c("frequency").alias("frequency"),
        c("band").alias("band"),
    )


def only_figure(words: Column) -> Column:
    """Is a cell little more than its figure and currency?"""
    rest = F.regexp_replace(F.regexp_replace(words, r"[\d.,%]+", " "), rf"{V.I}\b{V.MONEY_WORD}\b", " ")
    return F.length(F.regexp_replace(rest, r"[^A-Za-zĂÂÎȘȚăâîșț]", "")) < V.ONLY_FIGURE


def condition_role(words: Column, label: Column, value: Column) -> Column:
    """``conditie`` if the figure is a demand on the client or a limit, not the price; else null.

    The signs stand on both sides of the figure and in the label above: a limit's label with nothing but a figure (zero too); otherwise, for figures that aren't zero, a
    repayment's label, a demand, a reduction, a limit's own figure, a comparison that doesn't bound the fee, a bracket opened in the label and closed here, a
    figure that repeats the label's band. Nulls are empty texts.
    """
    words, label = F.coalesce(words, F.lit("")), F.coalesce(label, F.lit(""))
    has = lambda c, pattern: c.rlike(V.I + pattern)
    numbers_in = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d.,]*\d|\d"), F.lit(0)), lambda x: numbers.decimal_number(x))
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    tail = F.regexp_extract(label, r"(?s)\(([^(]*)$", 1)
    closes = (count(words, ")") > count(words, "(")) & (count(label, "(") > count(label, ")")) & has(tail, V.BAND_IN_BRACKETS) & ~has(tail, V.FEE_LIMIT_IN_BRACKETS)
    bands = F.flatten(F.transform(F.regexp_extract_all(label, F.lit(V.I + V.BAND), F.lit(0)), numbers_in))
    within = F.transform(F.regexp_extract_all(words, F.lit(V.I + V.WITHIN_LIMIT), F.lit(1)), lambda x: numbers.decimal_number(x))
    limit = has(label, V.LIMIT_LABEL) & (words != "") & (only_figure(words) | has(words, V.LIMIT_WORD))
    condition = (
        has(label, V.REPAYMENT_LABEL)
        | has(words, V.CLIENT_CONDITION)
        | has(words, V.REDUCTION)
        | (has(words, V.BY_PERCENT) & has(label, V.REDUCED))
        | F.coalesce(F.exists(within, lambda x: x == value), F.lit(False))
        | (has(words, V.COMPARISON) & ~has(words, V.FEE_LIMIT))
        | closes
        | (only_figure(words) & F.coalesce(F.exists(bands, lambda x: x == value), F.lit(False)))
    )
    return F.when(limit | (F.coalesce(value, F.lit(0.0)) != 0) & condition, "conditie")


def figure_category(words: Column) -> Column:
    """What a figure is: an interest rate, a limit, an exchange rate, a state fee, else a fee."""
    return rules.first_match(
        words,
        [("taxa_stat", V.I + r"tax[ăa]\s+(?:de\s+)?(?:stat|timbru|judiciar)|arhiv[ăa]\s+electronic"), ("dobanda", V.I + r"dob[âa]nd|\bDAE\b|IRCC|ROBOR|EURIBOR"), ("limita", V.I + r"limit[ăa]|plafon|sum[ăa]\s+(?:minim|maxim)"), ("curs", V.I + r"curs\s+(?:de\s+schimb|valutar)|\bcurs\b")],
        F.lit("comision"),
    )


def figure_kind(section: Column, service: Column, words: Column, cell: Column, column: Column) -> Column:
    """What a figure of a tariff document is: ``taxa_stat``, ``dobanda``, ``limita``, ``curs``, else ``comision``; by its section, service, line, own cell and table column.

    The column decides before anything else, interest before limits, limits before exchange rates. A limit that is only said counts where the cell is little more than a figure, so that a price that
    stands beside it stays a price; a price told relative to a ceiling stays one too. Nulls are empty texts.
    """
    section, service, words, cell, column = (F.coalesce(c, F.lit("")) for c in (section, service, words, cell, column))
    whole = F.concat_ws(" ", section, service, words)
    has = lambda c, pattern: c.rlike(V.I + pattern)
    bare = (cell != "") & only_figure(cell)
    interest = (
        has(whole, V.INTEREST_WORDS) | has(service, V.INTEREST_LABEL) | (has(words, V.PERCENT_A_YEAR) & has(service, V.OVERDRAWN)) | has(cell, V.INDEX_PLUS)
        | (has(column, V.INDEX) & has(service, V.INDEX_LABEL) & has(cell, V.ONLY_PERCENT))
    )
    beside = has(F.concat_ws(" ", section, service), V.BESIDE_CEILING) & ~has(cell, V.CEILING) & bare
    limit = (
        has(whole, V.LIMIT_WORDS) | has(section, V.LIMIT_SECTION) | has(cell, V.CREDIT_SUM) | (has(whole, V.CEILING) & ~beside)
        | ((has(whole, V.LIMIT_SAID) | has(service, V.LIMIT_ROW)) & bare)
    )
    return F.when(has(column, V.STATE_BUDGET), "taxa_stat").when(interest, "dobanda").when(limit, "limita").when(has(whole, V.EXCHANGE_RATE), "curs").otherwise("comision")


def figure_in_text(value: Column, words: Column) -> Column:
    """Does the value stand in the text, in any of the forms it can be written in? The proof that an extracted figure was read, not made up."""
    plain = F.regexp_replace(F.format_number(value, 4), "0+$", "")
    dotted = F.regexp_replace(F.regexp_replace(plain, ",", ""), r"[.]$", "")
    forms = F.array(dotted, F.translate(dotted, ".", ","), F.regexp_replace(F.translate(F.format_number(value, 2), ",.", ".,"), ",00$", ""), F.translate(F.format_number(value, 2), ",.", ".,"))
    squeezed = text.without_space(words)
    return F.coalesce(F.exists(forms, lambda f: F.contains(squeezed, f)), F.lit(False))


def place_kind(words: Column) -> Column:
    """A branch or a machine; branches are asked first, since many name their machine too."""
    low = F.lower(F.coalesce(words, F.lit("")))
    return F.when(low.rlike(V.BRANCH), "branch").when(low.rlike(V.MACHINE), "atm").otherwise("branch")


def extract_points(pages: DataFrame, html: str = "html", within: Sequence[str] | None = None) -> DataFrame:
    """Branches and machines of each page: from embedded JSON with coordinates under their usual names, and from elements with data-lat; within the country, and once
    for each kind and place among the rows that ``within`` (default: all other columns) tells apart. ``network`` says whose it is."""
    body = F.col(html)
    objects = F.concat(*(F.regexp_extract_all(body, F.lit(rf'(?s)(\{{[^{{}}]*"{k}"\s*:[^{{}}]*\}})'), F.lit(1)) for k in ("lat", "latitude")))
    tags = F.regexp_extract_all(body, F.lit(r"(?is)(<[a-z][^>]*\bdata-lat\s*=[^>]*>[^<]*)"), F.lit(1))
    key = lambda *names: F.coalesce(*(F.nullif(F.get_json_object("__o", f"$.{k}"), F.lit("")) for k in names))
    attribute = lambda *names: F.coalesce(*(F.nullif(F.regexp_extract("__o", rf"(?i)\b{k}\s*=\s*[\"']?([^\"'\s>]*)", 1), F.lit("")) for k in names))
    inner = text.collapse(F.regexp_extract("__o", r"(?s)>([^<]*)$", 1))
    json_words = F.concat_ws(" ", key("type"), key("tip"), key("kind"), key("category"), key("name"))
    tag_words = F.concat_ws(" ", F.regexp_extract("__o", r"(?i)\bclass\s*=\s*[\"']([^\"']*)", 1), inner)
    json = F.col("__o").startswith("{")
    rows = pages.select("*", F.explode(F.concat(objects, tags)).alias("__o")).withColumns(
        {
            "lat": F.round(F.when(json, key("lat", "latitude")).otherwise(attribute("data-lat")).try_cast("double"), 6),
            "lon": F.round(F.when(json, key("lng", "lon", "long", "longitude")).otherwise(attribute("data-lng", "data-lon")).try_cast("double"), 6),
            "name": F.when(json, key("name", "nume", "title", "denumire")).otherwise(F.nullif(F.left(inner, F.lit(120)), F.lit(""))),
            "kind": place_kind(F.when(json, json_words).otherwise(tag_words)),
        }
    )
    south, north, west, east = V.ROMANIA
    found = rows.withColumn("network", F.when(F.lower(F.coalesce("name", F.lit(""))).rlike(V.PARTNER), "partener").otherwise("proprie"))
    own = [c for c in pages.columns if c != html] if within is None else list(within)
    found = found.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).drop("__o")
    rest = [c for c in found.columns if c not in (*own, "kind", "lat", "lon", html)]
    best = found.groupBy(*own, "kind", "lat", "lon").agg(F.min(F.struct(F.col("name").isNull().alias("__none"), *rest)).alias("__b"))
    return best.select(*own, "kind", "lat", "lon", *(f"__b.{c}" for c in rest))


def sitemap_entries(files: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """(loc, lastmod, is_index) of sitemap files given as text (see ``readers.unpacked`` for packed ones), after the columns to ``keep``."""
    entries = F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), F.lit(1))
    piece = lambda tag: F.trim(text.xml_unescaped(F.regexp_extract("__e", rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)))
    rows = files.select(*keep, F.col(body).contains("<sitemapindex").alias("is_index"), F.explode(entries).alias("__e"))
    return rows.select(*keep, piece("loc").alias("loc"), F.nullif(piece("lastmod"), F.lit("")).alias("lastmod"), "is_index")


def robots_verdict(urls: DataFrame, rules_: DataFrame, agent: str) -> DataFrame:
    """urls (host, path) with allowed and crawl_delay by rules (host, agent, kind allow/disallow/delay, value): the agent's own group, else ``*``; the longest
    match wins, allow of equals; ``*`` and a final ``$`` are patterns; nothing matching allows."""
    own = rules_.where(F.lower("agent") == agent.lower()).select("host").distinct()
    mine = rules_.where(F.lower("agent") == agent.lower()).unionByName(rules_.where("agent = '*'").join(own, "host", "left_anti"))
    quoted = F.regexp_replace("value", r"([.+?^{}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\$$", "\0"), r"\$", r"\\\$"), r"\*", ".*"))
    pattern = F.regexp_replace(pattern, "\0", r"\$")
    paths = mine.where("kind in ('allow', 'disallow') and value <> ''").select(F.col("host").alias("__h"), pattern.alias("__p"), F.length("value").alias("__n"), (F.col("kind") == "allow").alias("__ok"))
    delays = mine.where("kind = 'delay'").groupBy("host").agg(F.max(F.col("value").try_cast("double")).alias("crawl_delay"))
    hit = urls.join(paths, (F.col("host") == F.col("__h")) & F.expr("path rlike __p"), "left")
    best = hit.groupBy("host", "path").agg(F.max_by("__ok", F.struct(F.coalesce("__n", F.lit(-1)), F.coalesce("__ok", F.lit(False)))).alias("__ok"))
    return best.join(delays, "host", "left").select("host", "path", F.coalesce("__ok", F.lit(True)).alias("allowed"), "crawl_delay")


def response_class(status: Column, content_type: Column, body: Column) -> Column:
    """What a response is: blocked, gone, to be tried again, a redirect written into the body, an empty script shell, or fine. A page that blocks is nearly
    empty: the word captcha in a full page, such as a contact form, says nothing; with a server error it does."""
    raw = F.coalesce(body, F.lit(""))
    low = F.lower(raw)
    visible = F.length(text.collapse(F.regexp_replace(F.regexp_replace(low, r"(?s)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]*>", " ")))
    blocks = F.left(raw, F.lit(5000)).rlike("(?i)" + V.BLOCKED)
    html = F.coalesce(content_type, F.lit("")).contains("html")
    shell = raw.rlike("(?i)" + V.SCRIPT_SHELL) | (F.size(F.split(low, "<script")) > 16)
    return (
        F.when(status.isin(401, 403, 407, 429, 451), "BLOCAT")
        .when(status.isin(404, 410), "DISPARUT")
        .when(status.between(500, 599) & blocks, "BLOCAT")
        .when(status.isNull() | (status >= 500), "REINCEARCA")
        .when(raw.startswith("HTTP/"), "REDIRECT_SERIALIZAT")
        .when(raw.startswith("%PDF"), "OK")
        .when(blocks & (visible < V.BLOCKED_TEXT), "BLOCAT")
        .when(html & (visible < V.LEAST_TEXT) & shell, "JS")
        .otherwise("OK")
    )
