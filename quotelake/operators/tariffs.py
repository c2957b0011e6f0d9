"""A tariff document's lines to priced rows: where each stands, what it charges, what the figure is and which service it prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import vocabulary as V
from quotelake.operators import extract, normalise, sections


def service_label(line: Column) -> Column:
    """A row's own words: the line without its index, its band and its figures."""
    rest = F.regexp_replace(sections.split_index(line)[1], V.I + V.BAND, " ")
    rest = F.regexp_replace(rest, rf"{V.I}(?:(?:{V.ROLE})\s*)?(?<![\d.,])(?:\d{{1,3}}(?:[.,]\d+)?\s*%|(?:{V.MONEY})\s*{V.MONEY_WORD}(?!\p{{L}}))", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(rest, r"\s+", " ")), r"^[:;,]\s*|\s*[:;,]$", "")


def tariff_rows(lines: DataFrame, document: str = "document", at: str = "at", kind: str = "kind", line: str = "line") -> DataFrame:
    """(document, at, section, service, fee, value, currency, role, frequency, band, category, concept): a row for each figure of each priced line.

    The section is the path of open titles (``sections.section_paths``), the figures are ``extract.extract_fees``'; a figure that is a demand or a limit has the role ``conditie`` whatever
    words stand before it, the category says what it is about, and the concept comes from the service's own words, a fragment's from its section. Lines of other kinds
    than ``row`` only open and close sections. Columns of ``lines`` besides the four aren't kept.
    """
    placed = sections.section_paths(lines.select(document, at, kind, line), document, at, kind, line).where(F.col(kind) == "row")
    fees = extract.extract_fees(placed.select(document, at, "section", F.col(line).alias("__line")).withColumn("service", service_label(F.col("__line"))), "__line")
    cell = F.concat_ws(" ", F.format_number("value", 2), "currency")
    none = F.lit(None).cast("string")
    return fees.select(
        document, at, "section", "service", F.col("kind").alias("fee"), "value", "currency",
        F.coalesce(extract.condition_role(F.col("__line"), F.col("service"), F.col("value")), F.col("role")).alias("role"), "frequency", "band",
        extract.figure_kind(F.col("section"), F.col("service"), F.col("__line"), cell, none).alias("category"),
        normalise.service_concept(F.col("service"), F.col("section"), none, none, none).alias("concept"),
    )
