"""A session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "veritrail", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; anything else is the cluster's choice."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (wanted | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share. Only where
    none is set and everything runs on this machine (tests), a new local one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="veritrail-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder and cuts its lineage: for small tables that a
    plan uses several times, such as a walk's frontier."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
