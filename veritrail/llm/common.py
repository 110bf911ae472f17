"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir``,
    or, only where the session names none and everything runs on this machine (tests), a new local one."""
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


def dropped(spark: SparkSession, folder: str | None) -> None:
    """Removes a folder that nothing will read again."""
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder and cuts its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as held out (0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


def share(doc_id: str = "doc_id") -> Column:
    """A uniform number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)


def slices(batches, rows: int = 256):
    """Arrow batches in short slices, so that a worker holds few decoded texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
