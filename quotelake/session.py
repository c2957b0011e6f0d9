"""A session with the settings the operators are meant for. Any session works; these are defaults, not requirements."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "quotelake", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=DEFAULTS | more).getOrCreate()
