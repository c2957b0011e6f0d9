"""Arrays, JSON and choices among sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def platform_shares(text: Column) -> Column:
    """``MAPS:0-1000:;YOUTUBE:400000-450000:`` as array of structs (name, low, high); an open end is null."""
    bits = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.contains(x, F.lit(":")))
    low = lambda x: F.regexp_extract(x, r":(\d+)-", 1).try_cast("long")
    high = lambda x: F.regexp_extract(x, r"-(\d+)", 1).try_cast("long")
    return F.transform(bits, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("name"), low(x).alias("low"), high(x).alias("high")))


def main_platform(text: Column, small: int = 1000) -> Column:
    """The platform(s) with the largest lower bound, joined by ``+`` in their order; ``sub_1000`` if none has one, ``fara_date`` without any."""
    parts = platform_shares(text)
    top = F.array_max(F.transform(parts, lambda x: F.coalesce(x["low"], F.lit(0))))
    best = F.transform(F.filter(parts, lambda x: F.coalesce(x["low"], F.lit(0)) == top), lambda x: x["name"])
    return F.when(F.size(parts) == 0, "fara_date").when(top <= 0, F.lit(f"sub_{small}")).otherwise(F.array_join(best, "+"))


def joined_distinct(values: Column, separator: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), separator)


def json_key(text: Column, *keys: str) -> Column:
    """The first of alternative top-level keys that a JSON text has, as text."""
    return F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in keys))


def json_objects(text: Column, with_key: str) -> Column:
    """The flat JSON objects in a text that hold a key, as array of texts."""
    return F.regexp_extract_all(text, F.lit(rf'(\{{[^{{}}]*"{with_key}"\s*:[^{{}}]*\}})'), F.lit(1))


def row_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def first_known(*choices: tuple[str, Column]) -> Column:
    """Struct (value, source) of the first choice that isn't null or empty."""
    chain = None
    for name, value in choices:
        known = value.isNotNull() & (value.cast("string") != "")
        pick = F.struct(value.cast("string").alias("value"), F.lit(name).alias("source"))
        chain = F.when(known, pick) if chain is None else chain.when(known, pick)
    return chain


def evidence_level(link: Column, page: Column) -> Column:
    return F.when(F.coalesce(link, F.lit("")) != "", "link").when(page.isNotNull(), "page").otherwise("none")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
