"""Lookups of a table's rows in other tables: equal and nearest keys, and series by period.

Lookup tables are joined; Catalyst broadcasts those it knows to be small and shuffles on the key else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.calendar import convert
from ..plans.periods import GRANULARITIES
from .storage import kept

#: Steps that every row is held against at most, in a nested loop.
BROADCAST_ROWS = 512


def exact_lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, value: str, to: str) -> DataFrame:
    """The value at the first table row (by `position`) with an equal key; NaN where there is none. NaN equals no key."""
    if dict(table.dtypes)[table_key] in ("double", "float"):
        table = table.where(~F.isnan(table_key))
    first = table.groupBy(F.col(table_key).alias("__key")).agg(F.min_by(F.col(value).cast("double"), "position").alias("__value"))
    found = rows.join(first, F.col(key) == F.col("__key"), "left")
    return found.withColumn(to, F.coalesce("__value", ieee.nan())).drop("__key", "__value")


def nearest_lookup(
    rows: DataFrame, table: DataFrame, key: str, table_key: str, value: str, to: str, *, descending: bool = False, by: tuple[str, ...] = (), broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The value at the last table row (by `position`) whose key is at most the row's key (or at least, if descending), among those that share the columns `by`.

    Of the table rows up to a key the one with the greatest position counts, sorted table or not. A table of
    up to broadcast_rows rows becomes steps that are broadcast and joined by their interval. A larger one, or
    one that is looked up by columns, is sorted together with the rows, range by range: a running maximum does
    the join, and what lies in earlier ranges reaches a range as one row. Ranges part a series that holds many
    rows, and the rows of one key. A null in `by` equals nothing; such rows get NaN.
    """
    sign = -1 if descending else 1
    steps = table.select(*by, (F.col(table_key).cast("double") * sign).alias("__key"), F.struct("position", F.col(value).cast("double").alias("value")).alias("__step")).where("__key is not null and not isnan(__key)")
    keyed = rows.withColumn("__row_key", F.col(key).cast("double") * sign)
    if by or table.limit(broadcast_rows + 1).count() > broadcast_rows:
        return _nearest_by_sorting(keyed, steps, to, by)
    best = steps.groupBy("__key").agg(F.max("__step").alias("__step"))
    order = Window.orderBy("__key")  # over at most broadcast_rows rows
    grid = best.withColumn("__until", F.lead("__key").over(order)).withColumn("__step", F.max("__step").over(order))
    inside = (F.col("__row_key") >= F.col("__key")) & (F.col("__until").isNull() | (F.col("__row_key") < F.col("__until"))) & ~F.isnan("__row_key")
    return keyed.join(F.broadcast(grid), inside, "left").withColumn(to, F.coalesce("__step.value", ieee.nan())).drop("__key", "__until", "__step", "__row_key")


def _nearest_by_sorting(keyed: DataFrame, steps: DataFrame, to: str, by: tuple[str, ...] = ()) -> DataFrame:
    columns = [c for c in keyed.columns if c != "__row_key"]
    own = [f"__by{i}" for i in range(len(by))]
    usable = F.col("__row_key").isNotNull() & ~F.isnan("__row_key")
    for c in by:
        usable = usable & F.col(c).isNotNull()
    kinds = [(F.col(c).alias(o)) for c, o in zip(by, own, strict=True)]
    # Rows of one key are dealt out by a hash after the table's rows, which come first: so that no range holds all of a hot key.
    asked = keyed.where(usable).select(*kinds, F.col("__row_key").alias("__key"), F.struct(*columns).alias("__row"), F.abs(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in columns[:4]))).alias("__salt"))
    given = steps.select(*kinds, "__key", "__step", F.lit(-1).cast("long").alias("__salt"))
    both = given.unionByName(asked, allowMissingColumns=True).repartitionByRange(*own, F.col("__key"), F.col("__salt"))
    dealt = kept(both.withColumn("__part", F.spark_partition_id()))
    running = Window.partitionBy("__part", *own).orderBy("__key", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("__part", *own).agg(F.max("__step").alias("__last"))
    before = Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # Ranges are in order: only the first group of a range goes on from an earlier one, so that there are as many rows as ranges.
    earlier = parts.select("__part", *own, F.max("__last").over(before).alias("__earlier")).where("__earlier is not null")
    found = dealt.withColumn("__found", F.max("__step").over(running)).where(F.col("__row").isNotNull()).join(F.broadcast(earlier), ["__part", *own], "left")
    best = found.select("__row.*", F.coalesce(F.greatest("__found", "__earlier")["value"], ieee.nan()).alias(to))
    return best.unionByName(keyed.where(~F.coalesce(usable, F.lit(False))).select(*columns, ieee.nan().alias(to)))


def at_position(values: list[float | None], position: Column) -> Column:
    """INDEX of a written list: position is floored and counts from 1; an empty entry is 0, another position NaN."""
    whole = ieee.floor(position.cast("double"))
    array = F.array(*(F.lit(float(v or 0)) for v in values))
    return F.when((whole >= 1) & (whole <= len(values)), F.get(array, (whole - 1).cast("int"))).otherwise(ieee.nan())


def fill_series(series: DataFrame, kind: str) -> DataFrame:
    """series, period, value (null: an empty entry): flow gives 0, level the last value before (NaN at first), rate NaN.

    Of repeated periods the first row (by `row`, if there is such a column) counts.
    """
    order = [F.col("row")] if "row" in series.columns else [F.lit(1)]
    w = Window.partitionBy("series", "period").orderBy(*order)
    once = series.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("series", "period", F.col("value").cast("double").alias("value"))
    if kind == "flow":
        return once.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if kind == "level":
        before = Window.partitionBy("series").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
        return once.withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(before), ieee.nan()))
    return once.withColumn("value", F.coalesce("value", ieee.nan()))


def coarser_series(series: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    """A filled series per period of a coarser granularity: sum of a flow, last of a level, average of a rate."""
    how = {"flow": F.sum("value"), "level": F.max_by("value", "__from"), "rate": F.avg("value")}[kind]
    return series.select("series", F.col("period").alias("__from"), convert(F.col("period"), source, target).alias("period"), "value").groupBy("series", "period").agg(how.alias("value"))


def series_lookup(rows: DataFrame, series: DataFrame, *, kind: str, source: str, asked: str, time: str, key: str = "series", to: str = "value") -> DataFrame:
    """Adds the series' value at each row's period (column `time`, of granularity `asked`); NaN where it has none.

    series has series, period, value. Coarser: coarser_series. Finer: a flow is spread evenly over its
    period, a rate holds, a level runs in a straight line to the next period's value (or holds, if that is
    missing or not finite).
    """
    filled = fill_series(series, kind)
    if GRANULARITIES.index(asked) >= GRANULARITIES.index(source):
        table = filled if asked == source else coarser_series(filled, kind, source, asked)
        table = table.select(F.col("series").alias("__series"), F.col("period").alias("__period"), F.col("value").alias("__value"))
        found = rows.join(table, (F.col(key) == F.col("__series")) & (F.col(time) == F.col("__period")), "left")
        return found.withColumn(to, F.coalesce("__value", ieee.nan())).drop("__series", "__period", "__value")
    start = convert(F.col("period"), source, asked)
    length = convert(F.col("period") + 1, source, asked) - start
    w = Window.partitionBy("series").orderBy("period")
    after = F.when(F.lead("period").over(w) == F.col("period") + 1, F.lead("value").over(w))
    table = filled.select(
        F.col("series").alias("__series"), F.col("period").alias("__period"), F.col("value").alias("__value"), start.alias("__start"), length.alias("__length"), after.alias("__after")
    )
    found = rows.withColumn("__inside", convert(F.col(time), asked, source)).join(table, (F.col(key) == F.col("__series")) & (F.col("__inside") == F.col("__period")), "left")
    value = {
        "flow": F.col("__value") / F.col("__length"),
        "rate": F.col("__value"),
        "level": F.when(ieee.is_finite(F.col("__after")), F.col("__value") + (F.col(time) - F.col("__start")) / F.col("__length") * (F.col("__after") - F.col("__value"))).otherwise(F.col("__value")),
    }[kind]
    return found.withColumn(to, F.coalesce(value, ieee.nan())).drop("__inside", "__series", "__period", "__value", "__start", "__length", "__after")


def period_range(rows: DataFrame, first: str, last: str, to: str = "period") -> DataFrame:
    """One row per period from first to last, both included."""
    return rows.withColumn(to, F.explode(F.sequence(F.col(first), F.col(last))))


def running_totals(series: DataFrame) -> DataFrame:
    """series, period, upto, before, odd_upto, odd_before for every period from a series' first to its last.

    upto and before are sums of the finite values up to a period and before it; odd counts those that are not
    finite. An empty entry, or a period without a row, is 0. The index of every range sum: see range_totals.
    """
    span = series.groupBy("series").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    every = span.select("series", F.explode(F.sequence("a", "b")).alias("period"))
    filled = every.join(fill_series(series, "flow"), ["series", "period"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    order = Window.partitionBy("series").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    finite = ieee.is_finite(F.col("value"))
    sound, odd = F.when(finite, F.col("value")).otherwise(0.0), (~finite).cast("long")
    with_sums = filled.withColumns({"upto": F.sum(sound).over(order), "odd_upto": F.sum(odd).over(order)})
    return with_sums.withColumns({"before": F.col("upto") - sound, "odd_before": F.col("odd_upto") - odd}).drop("value")


def range_totals(rows: DataFrame, series: DataFrame, first: str, last: str, *, key: str = "series", to: str = "total", periods: str = "periods") -> DataFrame:
    """The sum of a flow over the periods from first to last, both included, and how many of them the series has.

    Two lookups in running_totals, one at each end, however long the range: no row becomes one per period. A
    range outside its series sums to 0 over 0 periods; one that holds a value that is not finite is NaN.
    """
    totals = kept(running_totals(series))
    spans = totals.groupBy(F.col("series").alias("__series")).agg(F.min("period").alias("__lowest"), F.max("period").alias("__highest"))
    a, b = F.greatest(F.col(first), F.col("__lowest")), F.least(F.col(last), F.col("__highest"))
    asked = rows.join(spans, F.col(key) == F.col("__series"), "left").withColumns({"__a": a, "__b": b}).drop("__series")
    at = lambda name, *columns: totals.select(F.col("series").alias(f"__s_{name}"), F.col("period").alias(f"__p_{name}"), *(F.col(x).alias(f"__{x}") for x in columns))
    low, high = at("a", "before", "odd_before"), at("b", "upto", "odd_upto")
    both = asked.join(low, (F.col(key) == F.col("__s_a")) & (F.col("__a") == F.col("__p_a")), "left").join(high, (F.col(key) == F.col("__s_b")) & (F.col("__b") == F.col("__p_b")), "left")
    # The greatest and the least of a null and a number are the number: so both ends and the series must be there.
    inside = F.coalesce((F.col("__a") <= F.col("__b")) & F.col(first).isNotNull() & F.col(last).isNotNull() & F.col("__lowest").isNotNull(), F.lit(False))
    total = F.when(inside & (F.col("__odd_upto") > F.col("__odd_before")), ieee.nan()).when(inside, F.col("__upto") - F.col("__before")).otherwise(0.0)
    found = both.withColumns({to: total, periods: F.when(inside, F.col("__b") - F.col("__a") + 1).otherwise(0).cast("long")})
    return found.drop(*(f"__{c}" for c in ("a", "b", "lowest", "highest", "s_a", "p_a", "s_b", "p_b", "before", "odd_before", "upto", "odd_upto")))


def repeated_periods(series: DataFrame) -> DataFrame:
    """Periods that more than one row has, with those rows in order."""
    return series.groupBy("series", "period").agg(F.sort_array(F.collect_list("row")).alias("rows")).where(F.size("rows") > 1)


def out_of_order(series: DataFrame) -> DataFrame:
    """Rows whose period is below that of the row before."""
    w = Window.partitionBy("series").orderBy("row")
    return series.withColumn("before", F.lag("period").over(w)).where(F.col("before") > F.col("period"))


def sorted_series(series: DataFrame) -> DataFrame:
    """Rows with a period in ascending order, then those without in their order, numbered anew by `place`."""
    w = Window.partitionBy("series").orderBy(F.col("period").isNull(), "period", "row")
    return series.withColumn("place", F.row_number().over(w))


def next_period(series: DataFrame, row: int) -> DataFrame:
    """For each series, the period after the latest above a row."""
    return series.where(F.col("row") < row).groupBy("series").agg((F.max("period") + 1).alias("period"))
