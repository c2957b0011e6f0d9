"""Cutting lineage: iterative operators write each round to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that ``spark.checkpoint.dir`` names, or in the context's own; where there is none, ``df`` as it is."""
    spark = df.sparkSession
    named, current = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if named and not current.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint() if named or current.isDefined() else df


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that all executors must see: below ``spark.checkpoint.dir`` or the context's checkpoint folder; in local mode without either, a temporary one."""
    named, current = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    base = named or (current.get() if current.isDefined() else None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quotelake-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
