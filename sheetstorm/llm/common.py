"""Shared helpers: the durable working folder, lineage cuts and row identity."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that setting is empty and the session is local, as in tests, a temporary folder is chosen;
    on a cluster it would be the driver's own disk, so that an empty setting is an error there.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="sheetstorm-")
        sc.setCheckpointDir(where)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/sheetstorm/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch(), by whatever store holds it, once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so that later steps survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: smaller than what durable keeps, and forgettable."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def text_or_empty(df: DataFrame, column: str) -> Column:
    """Null counts as the empty text; other types count as their text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_text_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Ids as text on their way into pandas, which would make floats of whole numbers beside nulls."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("doc_id",)})


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column `times` says, numbered from 1 in `copy`."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))


def give_back_memory() -> None:
    """Hands what a task has freed back to the system: Python workers live on, and an executor counts all of theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in this block go when it is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
