"""Cutting lineage: tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process that its end, or release, deletes.
_held: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session takes a temporary folder, and a cluster is an error:
    the driver's own disk is no place that executors see."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="sheetstorm-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder, deleted by release or with the end of the process."""
    path = f"{shared_folder(spark)}/sheetstorm/{name}-{uuid.uuid4().hex}"
    _held[path] = spark
    return path


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder: later steps survive lost executors, and know its size."""
    path = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*paths: str) -> None:
    """Deletes these folders, or all that kept has written so far, once nothing reads them any more."""
    for path in paths or list(_held):
        spark = _held.pop(path, None)
        if spark is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


@atexit.register
def _at_end() -> None:
    with contextlib.suppress(Exception):  # the session may have taken the gateway with it
        release()
