"""Sources. Paths go to Spark's readers alone, so any file system works; schemas are declared, never inferred."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, columns: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """A Parquet table; columns and predicate reach the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def raw_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as (path, content, length, modificationTime, hash)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).withColumn("hash", F.sha2("content", 256))


def stored_name(url: Column) -> Column:
    """The name under which a page's bytes are kept: readable host and path, and a hash of the whole address."""
    readable = F.left(F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z]+://(www[.])?", ""), "[^a-z0-9]+", "_"), F.lit(80))
    return F.concat(F.regexp_replace(readable, "^_|_$", ""), F.lit("_"), F.left(F.sha2(url, 256), F.lit(16)))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_by_key(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """A JSON object keyed by id: one row for each key."""
    text = spark.read.text(path, wholetext=True)
    kind = T.MapType(T.StringType(), T.StructType.fromDDL(value_schema))
    return text.select(F.explode(F.from_json("value", kind)).alias(key, "v")).select(key, "v.*")


def journal(spark: SparkSession, path: str, schema: str, mark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON lines; only lines that hold ``mark`` are parsed, if it is given."""
    lines = spark.read.text(path)
    lines = lines.where(F.col("value").contains(mark)) if mark else lines
    kind = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    parsed = lines.select("value", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt_record"), parsed.where(bad).select("value")


def csv(spark: SparkSession, path: str, schema: str, verbatim: bool = False) -> DataFrame:
    """CSV with a header, quoted cells of any length over several lines; empty cells are null. ``verbatim`` keeps white space, no-break spaces too."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("nullValue", "").option("emptyValue", "")
    return reader.option("ignoreLeadingWhiteSpace", not verbatim).option("ignoreTrailingWhiteSpace", not verbatim).csv(path)


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a package (path, hash) that miss or differ from the manifest (name, sha256), and names without a file: empty for a sound package."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("hash").alias("have"))
    both = manifest.join(have, "name", "full_outer")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.lower("sha256") != F.col("have"), "differs")
    return both.withColumn("state", state).where("state is not null").select("name", "state")


def require_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files, or an error that names what is wrong (the first twenty)."""
    wrong = check_manifest(files, manifest).orderBy("name").limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['name']}: {r['state']}" for r in wrong))
    return files


def exchange_rates(spark: SparkSession, path: str) -> DataFrame:
    """(day, currency, rate) for one unit of each currency, from an XML feed of day cubes with multipliers."""
    kind = "_date date, Rate array<struct<_VALUE: double, _currency: string, _multiplier: int>>"
    cubes = spark.read.format("xml").option("rowTag", "Cube").schema(kind).load(path)
    return cubes.select(F.col("_date").alias("day"), F.explode("Rate").alias("r")).select("day", F.col("r._currency").alias("currency"), F.round(F.col("r._VALUE") / F.coalesce("r._multiplier", F.lit(1)), 6).alias("rate"))


def newest_snapshot(df: DataFrame, day_in_path: str = r"(\d{4}-\d{2}-\d{2})", path: Column | None = None) -> DataFrame:
    """Rows of the newest of several dated files, by the date in their path, with ``snapshot``."""
    dated = df.withColumn("snapshot", F.try_to_date(F.regexp_extract(F.input_file_name() if path is None else path, day_in_path, 1)))
    last = dated.agg(F.max("snapshot").alias("__last"))
    return dated.join(F.broadcast(last), F.col("snapshot") == F.col("__last"), "left_semi")


def nested_places(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Places of a nested, partitioned Parquet table within a box: only the leaves named here are read, and the box reaches the scan."""
    south, north, west, east = box
    inside = (F.col("bbox.ymin") >= south) & (F.col("bbox.ymax") <= north) & (F.col("bbox.xmin") >= west) & (F.col("bbox.xmax") <= east)
    return spark.read.parquet(path).where(inside).select(
        "id", F.col("names.primary").alias("name"), F.col("bbox.ymin").alias("lat"), F.col("bbox.xmin").alias("lon"), "confidence", F.get(F.col("addresses"), F.lit(0))["freeform"].alias("address"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["dataset"]))), ",").alias("datasets"),
    )


def embedded_json(html: Column, element_id: str) -> Column:
    """The JSON in a page's script element of that id, as text."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*id="{element_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def newest_complete(files: DataFrame, needed: dict[str, str], folder: str = r"^(.*)/[^/]*$", day: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Of listed files (path) those of the newest dated folder that holds all that is needed: ``needed`` names patterns of file names. A row for each name: its last file by path."""
    named = files.select(F.regexp_extract("path", folder, 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), "path")
    kinds = F.create_map(*(F.lit(x) for pair in needed.items() for x in pair))
    rows = named.select("folder", "file", "path", F.explode(kinds).alias("name", "pattern")).where(F.expr("file rlike pattern"))
    last = rows.groupBy("folder", "name").agg(F.max("path").alias("path"))
    whole = last.groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") == len(needed))
    newest = whole.agg(F.max_by("folder", F.struct(F.try_to_date(F.regexp_extract("folder", day, 1)), F.col("folder"))).alias("folder"))
    return last.join(F.broadcast(newest), "folder").select("name", "path")


def region_stats(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    """(creative_id, region, first_shown, last_shown, low, high, regions, surfaces) of a foreign table with an array of structs for each region, which hold an array of surfaces.

    Only the leaves named here are read. ``regions`` counts the creative's regions; ``surfaces`` lists ``name:low-high`` by name.
    """
    shown = F.col("r.surface_serving_stats.surface_serving_stats")
    bound = lambda s, end: F.coalesce(s[f"times_shown_{end}_bound"].cast("string"), F.lit(""))
    surfaces = F.array_join(F.array_sort(F.transform(shown, lambda s: F.concat(s["surface"], F.lit(":"), bound(s, "lower"), F.lit("-"), bound(s, "upper")))), ";")
    rows = spark.read.parquet(path).select("creative_id", F.size("region_stats").alias("regions"), F.explode("region_stats").alias("r"))
    rows = rows if region is None else rows.where(F.col("r.region_code") == region)
    return rows.select(
        "creative_id", F.col("r.region_code").alias("region"), F.col("r.first_shown").cast("date").alias("first_shown"), F.col("r.last_shown").cast("date").alias("last_shown"),
        F.col("r.times_shown_lower_bound").alias("low"), F.col("r.times_shown_upper_bound").alias("high"), "regions", surfaces.alias("surfaces"),
    )


@F.pandas_udf(T.BinaryType())
def gzipped(bodies: pd.Series) -> pd.Series:
    """Bytes packed by gzip; null stays null."""
    return bodies.map(lambda b: None if b is None else gzip.compress(b, mtime=0))


@F.pandas_udf(T.StringType())
def unpacked(bodies: pd.Series) -> pd.Series:
    """Bytes as text, unpacked first if they begin as gzip does; damaged ones are null, what is no UTF-8 is replaced."""

    def read(body: bytes | None) -> str | None:
        if body is None:
            return None
        try:
            return (gzip.decompress(body) if body[:2] == b"\x1f\x8b" else bytes(body)).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None

    return bodies.map(read)
