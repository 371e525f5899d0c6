"""Series from tables: a date column gives the period, an aggregate the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_of


def series_from(df: DataFrame, time: str, value: Column, granularity: str, *, name: str | Column = "series") -> DataFrame:
    """series, period, value: one row per period that has rows; value is an aggregate, name a label or a column to group by."""
    label = F.lit(name) if isinstance(name, str) else name
    return df.groupBy(label.alias("series"), period_of(F.col(time), granularity).alias("period")).agg(value.cast("double").alias("value"))


def complete_periods(series: DataFrame) -> DataFrame:
    """A row for each period between a series' first and last; the missing ones have a null value."""
    span = series.groupBy("series").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    every = span.select("series", F.explode(F.sequence("a", "b")).alias("period"))
    return every.join(series, ["series", "period"], "left")
