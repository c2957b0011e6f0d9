"""Numbers out of text, ratios and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions import arrays

# Confidence words and the caps of doubtful states.
CONFIDENCE = (("ridicata", 0.9), ("medie", 0.6), ("scazuta", 0.3))
CAPS = (("DATA_NECUNOSCUTA", 0.7), ("SURSA_VECHE", 0.5), ("SUSPECT", 0.5))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.when(b != 0, a / b)


def percent_change(new: Column, old: Column, digits: int = 1) -> Column:
    return F.when(old != 0, F.round(F.lit(100.0) * (new - old) / old, digits))


def decimal_number(text: Column, as_percent: bool | Column = False) -> Column:
    """``1.234,56``, ``5,84``, ``20,000`` or ``2.5`` as a double. Three digits after one mark are thousands, unless it is a percentage, where
    they are decimals as long as the value stays at 100 or below. No number gives null."""
    raw = F.regexp_extract(F.regexp_replace(text, r"[\s ]", ""), r"-?\d[\d.,]*\d|-?\d", 0)
    plain = lambda s: s.try_cast("double")

    def value(raw: Column) -> Column:
        point, comma = F.contains(raw, F.lit(".")), F.contains(raw, F.lit(","))
        last_comma = ~F.contains(F.substring_index(raw, ",", -1), F.lit("."))
        both_value = F.when(last_comma, plain(F.translate(raw, ",.", "."))).otherwise(plain(F.translate(raw, ",", "")))
        many = raw.rlike(r"([.,]\d{3}){2,}$")
        three = raw.rlike(r"^-?\d{1,3}[.,]\d{3}$")
        dotted = plain(F.translate(raw, ",", "."))
        joined = plain(F.translate(raw, ".,", ""))
        single = F.when(three, F.when(F.lit(as_percent) & (dotted <= 100), dotted).otherwise(joined)).otherwise(dotted)
        return F.when(raw == "", F.lit(None).cast("double")).when(point & comma, both_value).when(~point & ~comma, plain(raw)).when(many, joined).otherwise(single)

    return arrays.let(raw, value)


def percent(text: Column) -> Column:
    """The text's first percentage of at most three whole digits, as written; null if there is none."""
    found = F.regexp_extract(text, r"(?<![\d.,])(\d{1,3}(?:[.,]\d{1,4})?)\s*%", 1)
    return F.when(found != "", found)


def confidence(word: Column, state: Column) -> Column:
    """A confidence from its word or number (0.5 if it is neither), no higher than the state allows."""
    base = F.coalesce(word.try_cast("double"), F.lit(None).cast("double"))
    for name, value in CONFIDENCE:
        base = F.when(F.lower(word) == name, F.lit(value)).otherwise(base)
    base = F.coalesce(base, F.lit(0.5))
    for name, cap in CAPS:
        base = F.when(state == name, F.least(base, F.lit(cap))).otherwise(base)
    return F.round(base, 3)


def shorthand(text: Column) -> Column:
    """``1K-5K`` and ``2.5M`` to the number they begin with, thousands and millions worked out."""
    digits = F.regexp_extract(text, r"([\d.]+)\s*([KkMm]?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"([\d.]+)\s*([KkMm]?)", 2))
    return digits * F.when(unit == "K", 1_000.0).when(unit == "M", 1_000_000.0).otherwise(1.0)


def comma_share(text: Column) -> Column:
    """``12,5%`` to 12.5."""
    return F.translate(F.regexp_replace(text, r"[%\s]", ""), ",", ".").try_cast("double")


def rate_per_unit(value: Column, multiplier: Column) -> Column:
    """A published exchange rate for one unit."""
    return F.round(value / F.coalesce(multiplier, F.lit(1)), 6)


def implied_index(text: Column) -> Column:
    """Total less margin for ``9.06% (INDEX + 3.5%)`` and ``3% + INDEX (8.68%)``, kept within 0.5 to 12; null otherwise."""
    n = r"(\d+(?:[.,]\d+)?)\s*%"
    index = r"(?:IRCC|ROBOR|EURIBOR)"
    value = lambda p, g: F.translate(F.regexp_extract(text, p, g), ",", ".").try_cast("double")
    ahead, behind = rf"(?i){n}\s*\(\s*{index}\s*\+\s*{n}\s*\)", rf"(?i){n}\s*\+\s*{index}\s*\(\s*{n}\s*\)"
    found = F.coalesce(value(ahead, 1) - value(ahead, 2), value(behind, 2) - value(behind, 1))
    return F.when(found.between(0.5, 12), F.round(found, 2))
