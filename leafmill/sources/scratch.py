"""The folder that driver and executors share, and results that are held there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found and not hasattr(context, "_leafmill_scratch"):
        context._leafmill_scratch = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return (found or context._leafmill_scratch).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/leafmill/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder: what reads it, or is run again, doesn't compute it again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
