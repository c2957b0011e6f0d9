"""Dates, terms and periods out of text. Every state is told against a given day, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions import arrays, text

# Term buckets in months.
TERMS = (("1-3", 1, 3), ("4-6", 4, 6), ("7-12", 7, 12), (">12", 13, None))
_MONTH_NO = {m: i % 12 + 1 for i, m in enumerate("ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie".split())}


def term_months(text: Column) -> Column:
    """``90 zile``, ``12 luni``, ``2 ani`` or ``un an`` in months (days over 30, at least 1); null if it is no term."""
    low = F.lower(text)
    n = lambda unit: F.regexp_extract(low, rf"(\d+)\s*(?:de\s+)?(?:{unit})", 1).try_cast("int")
    days, months, years = n("zile|zi"), n("luni|luna|lună"), n("ani|an")
    return (
        F.when(months.isNotNull(), months)
        .when(days.isNotNull(), F.greatest(F.lit(1), F.round(days.cast("decimal(10,2)") / 30).cast("int")))
        .when(years.isNotNull(), years * 12)
        .when(low.rlike(r"\bun an\b"), F.lit(12))
    )


def term_bucket(months: Column) -> Column:
    """The bucket of a term: up to 3 months (0 included), 4 to 6, 7 to 12, more, or unknown."""
    return F.when(months.isNull(), "unknown").when(months <= 3, "1-3").when(months <= 6, "4-6").when(months <= 12, "7-12").otherwise(">12")


def term_filter(months: Column, bucket: str) -> Column:
    if bucket == "unknown":
        return months.isNull()
    _, low, high = next(t for t in TERMS if t[0] == bucket)
    return months >= low if high is None else months.between(low, high)


def quarter_interval(label: Column) -> tuple[Column, Column]:
    """(first, last) day on which a quarter's index applies: the quarter two after that of ``2026T1``."""
    year, quarter = F.regexp_extract(label, r"^(\d{4})[TQ]([1-4])$", 1).try_cast("int"), F.regexp_extract(label, r"^(\d{4})[TQ]([1-4])$", 2).try_cast("int")
    first = F.when(quarter.isNotNull(), F.add_months(F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1)), 6))
    return first, F.last_day(F.add_months(first, 2))


def dotted_date(text: Column) -> Column:
    """``dd.mm.yyyy`` as a date; null if it is none."""
    return F.try_to_date(text, "d.M.yyyy")


def state_on(day: Column, as_of: Column) -> Column:
    return F.when(day.isNull(), "DATA_NECUNOSCUTA").when(day > as_of, "VIITOR").otherwise("IN_VIGOARE")


def iso_duration(text: Column) -> Column:
    """``PT1H2M3S`` in seconds; null if it is none."""
    n = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0))
    return F.when(text.rlike(r"^P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$") & text.rlike(r"\d"), n("D") * 86400 + n("H") * 3600 + n("M") * 60 + n("S"))


def clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss, or m:ss below an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(seconds.isNull(), F.lit(None)).when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))


def months_before(day: Column, n: int) -> Column:
    return F.add_months(day, -n)


# Short month names, and the anchors of a document's date in order of authority.
_SHORT_NO = {"ian": 1, "feb": 2, "mar": 3, "apr": 4, "iun": 6, "iul": 7, "aug": 8, "sept": 9, "sep": 9, "oct": 10, "noi": 11, "nov": 11, "dec": 12}
ANCHORS = (
    ("vigoare", r"in\s*vigoare(?:\s*(?:incepand\s*cu|de\s*la|din|la))?(?:\s*data\s*de)?"),
    ("valabil", r"valabil\w*(?:\s*(?:incepand\s*cu|de\s*la|din|pentru))?(?:\s*data\s*de)?"),
    ("aplicabil", r"aplicabil\w*(?:\s*(?:incepand\s*cu|de\s*la|din))?(?:\s*data\s*de)?"),
    ("incepand", r"incepand\s*cu(?:\s*data\s*de)?"),
    ("camp_data", r"\bdata\s*:"),
    ("versiune", r"(?:versiun\w*|editi\w*)(?:\s*din)?"),
    ("la_data_de", r"la\s*data\s*de"),
    ("actualizat", r"(?:actualizat\w*|ultima\s*actualizare)(?:\s*la)?"),
)
HEADER, WINDOW, FIRST_YEAR, YEARS_AHEAD = 1200, 40, 2015, 2


def _month_number(name: Column) -> Column:
    known = {**_MONTH_NO, **_SHORT_NO}
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[name]


def first_date(text_: Column, last_year: Column) -> Column:
    """The first plausible date among the forms, one after the other, as a struct (date, precision): day.month.year, year-month-day, day month-name year,
    then month-name year and short month-name year, which know the month only."""
    names, short = "|".join(_MONTH_NO), "|".join(sorted(_SHORT_NO, key=len, reverse=True))
    mark = r"\s*[.\-/]\s*"
    forms = [
        (rf"(\d{{1,2}}){mark}(\d{{1,2}}){mark}(\d{{4}})", (3, 2, 1), "day"), (rf"(\d{{4}}){mark}(\d{{1,2}}){mark}(\d{{1,2}})", (1, 2, 3), "day"),
        (rf"(\d{{1,2}})\s*[.,]?\s*({names})\s*(\d{{4}})", (3, 2, 1), "day"), (rf"({names})\s*(\d{{4}})", (2, 1, None), "month"), (rf"\b({short})\.?\s*(\d{{4}})", (2, 1, None), "month"),
    ]

    def made(pattern: str, places: tuple, precision: str) -> Column:
        def read(found: Column) -> Column:
            g = lambda i: F.regexp_extract(found, pattern, i)
            month = arrays.let(g(places[1]), lambda m: F.coalesce(m.try_cast("int"), _month_number(m)))
            return F.struct(g(places[0]).try_cast("int").alias("year"), month.alias("month"), (F.lit(1) if places[2] is None else g(places[2]).try_cast("int")).alias("day"))

        def whole(d: Column) -> Column:
            date = F.try_to_date(F.concat_ws("-", d["year"].cast("string"), d["month"].cast("string"), d["day"].cast("string")), "y-M-d")
            good = d["month"].isNotNull() & d["year"].between(F.lit(FIRST_YEAR), last_year)
            return arrays.let(F.when(good, date), lambda day: F.when(day.isNotNull(), F.struct(day.alias("date"), F.lit(precision).alias("precision"))))

        # the match alone is taken apart
        return arrays.let(F.regexp_extract(text_, pattern, 0), lambda found: F.when(found != "", arrays.let(read(found), whole)))

    return F.coalesce(*(made(*form) for form in forms))


def date_in_text(text_: Column, as_of: Column) -> Column:
    """A document's date by anchors in its header: struct (date, precision, anchor), null without one.

    Anchors are tried in order of authority; after each place where one stands, a plausible date within 40 characters counts, unless the words there say "until".
    """
    flat = F.left(text.fold(F.regexp_replace(text_, r"\s+", " ")), F.lit(HEADER))
    last_year = F.year(as_of) + YEARS_AHEAD

    def by(name: str, pattern: str) -> Column:
        zones = F.filter(F.regexp_extract_all(flat, F.lit(f"{pattern}(?=(.{{0,{WINDOW}}}))"), F.lit(1)), lambda z: ~z.rlike(r"^\s*pana\s*(?:la|in)\b"))
        found = F.get(F.filter(F.transform(zones, lambda z: first_date(z, last_year)), lambda d: d.isNotNull()), F.lit(0))
        return F.when(found.isNotNull(), F.struct(found["date"].alias("date"), found["precision"].alias("precision"), F.lit(name).alias("anchor")))

    return F.coalesce(*(by(name, pattern) for name, pattern in ANCHORS))


def date_in_name(name: Column, last_year: int = 2100) -> Column:
    """(date, precision) in a file name as a struct: as it stands, then with dashes and underscores as blanks, then glued digits; null without one. A prefix
    of eight hexadecimal digits isn't part of the name, and a year alone is no date."""
    base = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1), r"(?i)\.pdf$", ""), "^[0-9a-f]{8}_", "")
    low, limit = text.fold(base), F.lit(last_year)
    spaced = text.fold(F.regexp_replace(base, "[-_]+", " "))
    g = lambda p, i: F.regexp_extract(base, p, i)
    glued = [(r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)", (1, 2, 3)), (r"(?<!\d)(\d{2})(\d{2})(20\d{2})(?!\d)", (3, 2, 1))]
    joined = F.coalesce(*(first_date(F.concat_ws("-", g(p, i[0]), g(p, i[1]), g(p, i[2])), limit) for p, i in glued))
    return F.coalesce(first_date(low, limit), first_date(spaced, limit), joined)


def header_date(value: Column) -> Column:
    """The day of an HTTP date (``Wed, 16 Sep 2026 10:00:00 GMT``); null if it is none."""
    return F.try_to_date(F.regexp_extract(value, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), "d MMM yyyy")


def agrees_with_name(modified: Column, named: Column, precision: Column, days: int = 14) -> Column:
    """Is a file's modification within ``days`` of the day in its name, or in its month where only that is known?"""
    return F.when(precision == "month", F.trunc(modified, "month") == F.trunc(named, "month")).otherwise(F.abs(F.datediff(modified, named)) <= days)


def text_beats_name(text_date: Column, name_date: Column) -> Column:
    """A document's date (struct date, source, disagreement): the text's if it has one; a month or more apart is a disagreement."""
    apart = F.coalesce(F.trunc(text_date, "month") != F.trunc(name_date, "month"), F.lit(False))
    source = F.when(text_date.isNotNull(), "text").when(name_date.isNotNull(), "name")
    return F.struct(F.coalesce(text_date, name_date).alias("date"), source.alias("source"), apart.alias("disagreement"))


def validity_period(text: Column) -> Column:
    """(start, end) of ``01.07 - 30.09.2026`` (a missing year is the end's) or ``valabil de la 01.07.2026`` (open end), as a struct; null otherwise."""
    rng = r"(\d{1,2})\.(\d{1,2})(?:\.(\d{4}))?\s*[-–]\s*(\d{1,2})\.(\d{1,2})\.(\d{4})"
    since = r"(?i)(?:de la|din|incepand cu|începând cu)\s+(\d{1,2}\.\d{1,2}\.\d{4})"
    g = lambda i: F.regexp_extract(text, rng, i)
    end = dotted_date(F.concat_ws(".", g(4), g(5), g(6)))
    start = dotted_date(F.concat_ws(".", g(1), g(2), F.when(g(3) != "", g(3)).otherwise(g(6))))
    opened = dotted_date(F.regexp_extract(text, since, 1))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end"))).when(opened.isNotNull(), F.struct(opened.alias("start"), F.lit(None).cast("date").alias("end")))


def windows_back(as_of: Column, days: int, width: int = 30) -> Column:
    """Array of structs (first, last): windows of at most ``width`` days that cover the ``days`` before the day, newest first, meeting at their ends."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-days // width) - 1))), lambda k: F.date_sub(as_of, (k * width).cast("int")))
    return F.transform(ends, lambda e: F.struct(F.greatest(F.date_sub(e, width), F.date_sub(as_of, days)).alias("first"), e.alias("last")))


def within_months(day: Column, as_of: Column, months: float) -> Column:
    """Is the day within so many months of 30.44 days before the other?"""
    return day >= F.date_sub(as_of, F.ceil(F.lit(months * 30.44)).cast("int"))
