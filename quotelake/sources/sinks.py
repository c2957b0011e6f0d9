"""Writes that can be run twice. Operators make the new table; these put it where the old one was."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces the partitions that ``df`` holds and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_fingerprints(known: DataFrame, new: DataFrame, path: str) -> None:
    """Appends (source, hash) pairs that aren't known yet."""
    new.dropDuplicates(["source", "hash"]).join(known.select("source", "hash"), ["source", "hash"], "left_anti").write.mode("append").parquet(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A bounded report as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def as_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
