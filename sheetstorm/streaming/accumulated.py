"""Summaries of a stream that outlive it: each micro-batch is stored once under its number, whatever restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.storage import fresh_path, release
from ..operators.summary import binned, merge_bins, place_bins, with_places

#: After so many batches what is stored is merged into one table, so that reading it stays cheap.
MERGED_EVERY = 32


def accumulate(samples: DataFrame, keys: list[str], folder: str, *, merged_every: int = MERGED_EVERY, available_now: bool = True, **trigger) -> StreamingQuery:
    """Starts a query that keeps the bin tables of a stream of samples (keys, iteration, value) in a folder; read it with accumulated().

    Batch n writes what it adds under its number and overwrites what an earlier attempt at n has left, and the
    bins of a key are placed by the first batch that has it: replaying a batch after a failure changes nothing.
    The folder holds the checkpoint too, so that a query that is started again goes on after the last batch.
    """
    spark = samples.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        path = fresh_path(spark, "batch")
        batch.write.parquet(path)
        own = spark.read.schema(batch.schema).parquet(path)
        known = _read(spark, f"{folder}/places", f"batch < {number}")
        fresh = own if known is None else own.join(known.select(*keys).distinct(), keys, "left_anti")
        _write(place_bins(fresh, keys).where("scale is not null"), f"{folder}/places/batch={number}")
        places = _read(spark, f"{folder}/places", f"batch <= {number}")
        _write(binned(with_places(own, places, keys), keys), f"{folder}/bins/batch={number}")
        if (number + 1) % merged_every == 0:
            _write(accumulated(spark, folder, keys, upto=number), f"{folder}/merged/upto={number}")
        release(path)

    writer = samples.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(**trigger)).start()


def accumulated(spark: SparkSession, folder: str, keys: list[str], *, upto: int | None = None) -> DataFrame:
    """The bin table of all batches so far (or up to one), as if they had been one."""
    last = _last_merged(spark, folder, upto)
    recent = f"batch > {last if last is not None else -1}" + (f" and batch <= {upto}" if upto is not None else "")
    tables = [_read(spark, f"{folder}/bins", recent), _read(spark, f"{folder}/merged", f"upto = {last}") if last is not None else None]
    both = [t.drop("batch", "upto") for t in tables if t is not None]
    if not both:
        raise ValueError(f"no batch has been stored in {folder}")
    return merge_bins(both[0].unionByName(both[1]) if len(both) > 1 else both[0], keys)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, path: str, condition: str) -> DataFrame | None:
    fs, where = _file_system(spark, path)
    return spark.read.parquet(path).where(F.expr(condition)) if fs.exists(where) else None


def _last_merged(spark: SparkSession, folder: str, upto: int | None) -> int | None:
    """The last merged table that was written to its end."""
    fs, where = _file_system(spark, f"{folder}/merged")
    if not fs.exists(where):
        return None
    whole = [x.getPath() for x in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    numbers = [int(p.getName().partition("=")[2]) for p in whole]
    return max((n for n in numbers if upto is None or n < upto), default=None)
