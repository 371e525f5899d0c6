"""Summaries of samples that merge exactly, log-linear histograms, quantiles and display windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from .storage import kept

#: Fixed values of the histogram: bins of the body, growth of the bins outside it and how many there are each side.
LINEAR, RATIO = 512, 1.02
LOG = math.ceil(math.log(1e15) / math.log(RATIO))
#: Outputs that are aggregated side by side at most.
WIDE = 12
#: The rows, by iteration, whose median and quartiles place the bins.
FIRST_BATCH = 8192
#: The window shows the samples between this quantile and its mirror, with so much padding, or all if that is most.
TAIL, PADDING, NEARLY_ALL, BARS = 0.005, 0.25, 2 / 3, 64


def long_samples(samples: DataFrame, outputs: list[str], keys: list[str] | None = None) -> DataFrame:
    """iteration, cell, value (and keys): one row per sample."""
    pairs = F.explode(F.array(*(F.struct(F.lit(o).alias("cell"), F.col(f"`{o}`").cast("double").alias("value")) for o in outputs))).alias("x")
    return samples.select(*(keys or []), "iteration", pairs).select(*(keys or []), "iteration", "x.cell", "x.value")


def summary_of(value: Column, order: Column) -> list[Column]:
    finite = F.when(ieee.is_finite(value), value)
    return [
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.avg(finite), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(finite) * F.count(finite), F.lit(0.0)).alias("m2"),
        F.count_if(F.isnan(value)).alias("nans"),
        F.count_if(F.abs(value) == ieee.INF).alias("infinities"),
        F.min_by(value, order).alias("first"),
    ]


def with_sd(summary: DataFrame) -> DataFrame:
    """The sample deviation: n counts all samples, m2 the finite ones."""
    return summary.withColumn("sd", F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1))).otherwise(0.0))


def summarize(samples: DataFrame, outputs: list[str], keys: list[str] | None = None) -> DataFrame:
    """cell, count, mean, m2, nans, infinities, first, sd per output (and keys), in one aggregation.

    Up to WIDE outputs are aggregated side by side. More would make buffers too wide for generated code:
    then every row becomes one for each output, which are summed up before they are shuffled.
    """
    keys = keys or []
    if len(outputs) > WIDE:
        pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.col(f"`{o}`").cast("double").alias("value")) for i, o in enumerate(outputs)))).alias("x")
        rows = samples.select(*keys, "iteration", pairs).select(*keys, "iteration", "x.place", "x.value")
        found = rows.groupBy(*keys, "place").agg(*summary_of(F.col("value"), F.col("iteration")))
        return with_sd(found.select(*keys, F.get(F.array(*map(F.lit, outputs)), F.col("place")).alias("cell"), "count", "mean", "m2", "nans", "infinities", "first"))
    aggregates = [F.struct(F.lit(o).alias("cell"), *summary_of(F.col(f"`{o}`"), F.col("iteration"))).alias(f"__{i}") for i, o in enumerate(outputs)]
    grouped = samples.groupBy(*keys).agg(*aggregates) if keys else samples.agg(*aggregates)
    rows = grouped.select(*keys, F.explode(F.array(*(F.col(f"__{i}") for i in range(len(outputs))))).alias("x"))
    return with_sd(rows.select(*keys, "x.*"))


def merge_summaries(summaries: DataFrame, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Summaries of parts to those of the whole, as if all samples had been summarized at once; `more` are other aggregates.

    The parts' means are taken from the mean of all before they are squared, so that large values with a
    small deviation keep it.
    """
    finite = F.col("count") - F.col("nans") - F.col("infinities")
    every = Window.partitionBy(*keys)
    total, weighted = F.sum(finite).over(every), F.sum(finite * F.col("mean")).over(every)
    near = summaries.withColumn("__finite", finite).withColumn("__mean", F.when(total > 0, weighted / total).otherwise(0.0))
    apart = F.col("mean") - F.col("__mean")
    mean = F.when(F.sum("__finite") > 0, F.first("__mean") + F.sum(F.col("__finite") * apart) / F.sum("__finite")).otherwise(0.0)
    merged = near.groupBy(*keys).agg(
        F.sum("count").alias("count"), mean.alias("mean"), F.sum(F.col("m2") + F.col("__finite") * apart * apart).alias("m2"), F.sum("nans").alias("nans"), F.sum("infinities").alias("infinities"), *(c.alias(name) for name, c in (more or {}).items())
    )
    return with_sd(merged)


def with_kind(summary: DataFrame) -> DataFrame:
    """kind and code: NaN anywhere is #NUM!, else an infinity #DIV/0!; else a number if nothing varies, or uncertain."""
    code = F.when(F.col("nans") > 0, "#NUM!").when(F.col("infinities") > 0, "#DIV/0!")
    return summary.withColumn("code", code).withColumn("kind", F.when(code.isNotNull(), "error").when(F.col("m2") == 0, "number").otherwise("uncertain"))


def place_bins(samples: DataFrame, keys: list[str]) -> DataFrame:
    """centre and scale per key: median and interquartile range of the finite values among the key's first FIRST_BATCH rows by iteration.

    The median is the element at floor(n / 2) of the sorted values. Where the quartiles are equal, half the
    range serves, and of a single value a small part of it. Null where none of those rows is finite.
    """
    # No filter on the values: it would be pushed below the stages that compute them, and repeat them in one expression.
    finite = F.when(ieee.is_finite(F.col("value")), F.col("value"))
    first = Window.partitionBy(*keys).orderBy("iteration", "value")
    opening = samples.select(*keys, "iteration", "value").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= FIRST_BATCH)
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("value"))
    ranked = opening.select(*keys, finite.alias("value")).withColumn("place", F.row_number().over(w) - 1)
    ranked = ranked.withColumn("n", F.count("value").over(Window.partitionBy(*keys)))
    at = lambda p: F.max(F.when(F.col("place") == F.least(F.col("n") - 1, F.floor(p * F.col("n"))), F.col("value")))
    found = ranked.groupBy(*keys).agg(at(0.25).alias("q1"), at(0.5).alias("centre"), at(0.75).alias("q3"), F.min("value").alias("low"), F.max("value").alias("high"))
    return found.select(*keys, "centre", _scale("q1", "centre", "q3", "low", "high").alias("scale"))


def _scale(q1: str, centre: str, q3: str, low: str, high: str) -> Column:
    spread, width = F.col(q3) - F.col(q1), F.col(high) - F.col(low)
    return F.when(spread > 0, spread).when(width > 0, width / 2).otherwise(F.greatest(F.abs(centre) * 1e-9, F.lit(1e-12)))


def place_late(samples: DataFrame, keys: list[str]) -> DataFrame:
    """centre and scale of keys whose first rows hold nothing finite: their first finite value, and half the range of all of them."""
    finite = F.when(ieee.is_finite(F.col("value")), F.col("value"))
    found = samples.groupBy(*keys).agg(F.min_by(finite, F.when(finite.isNotNull(), F.col("iteration"))).alias("centre"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    return found.select(*keys, "centre", _scale("centre", "centre", "centre", "low", "high").alias("scale"))


def with_places(samples: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """samples with the centre and scale of their key, null keys too; every sample stays."""
    renamed = places.select(*(F.col(f"`{k}`").alias(f"__{k}") for k in keys), "centre", "scale")
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys))
    return samples.join(renamed, same, "left").drop(*(f"__{k}" for k in keys))


def bin_table(samples: DataFrame, keys: list[str], places: DataFrame | None = None) -> DataFrame:
    """The histogram of long samples (iteration, value) as a stored table: keys, centre, scale, bin, n and the moments of each bin.

    n, mean and m2 are those of the finite samples of a bin; samples that are not finite have a row with a null
    bin, where nans and infinities count them. A key has at most 4,003 rows. Tables on the same places merge
    (merge_bins), and everything that is shown rests on them: no sample is looked at again. The samples are
    read twice, for the places and for the bins; rows of a hot key combine where they are read.
    """
    own = places is None
    places = kept(place_bins(samples, keys)) if own else places
    table = kept(binned(with_places(samples, places, keys), keys))
    if own and not table.where("scale is null and count > nans + infinities").isEmpty():
        late = place_late(with_places(samples, places, keys).where("scale is null"), keys)
        places = kept(places.where("scale is not null").unionByName(late))
        table = kept(binned(with_places(samples, places, keys), keys))
    return table


def binned(placed: DataFrame, keys: list[str], moments_only: bool = False) -> DataFrame:
    """The bin table of samples that have their centre and scale; without bins, a row per key holds the moments of all of them."""
    value = F.col("value")
    finite = F.when(ieee.is_finite(value), value)
    bins = F.lit(None).cast("int") if moments_only else F.when(ieee.is_finite(value), bin_of(value, F.col("centre"), F.col("scale")))
    return placed.groupBy(*keys, "centre", "scale", bins.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.count(finite).cast("double").alias("n"), F.coalesce(F.avg(finite), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(finite) * F.count(finite), F.lit(0.0)).alias("m2"),
        F.count_if(F.isnan(value)).alias("nans"), F.count_if(F.abs(value) == ieee.INF).alias("infinities"), F.min("iteration").alias("first_iteration"), F.min_by("value", "iteration").alias("first"),
    )


def merge_bins(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Bin tables of parts, on the same places, to that of the whole."""
    by = [*keys, "centre", "scale", "bin"]
    mean = F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")), F.lit(0.0))
    # Means of one bin lie within its width, so that the squares of their differences keep their digits when taken from one of them.
    base = F.first("mean").over(Window.partitionBy(*by).orderBy("first_iteration"))
    near = tables.withColumn("__d", F.col("mean") - base)
    spread = F.sum(F.col("m2") + F.col("n") * F.col("__d") * F.col("__d")) - F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("__d")) * F.sum(F.col("n") * F.col("__d")), F.sum("n")), F.lit(0.0))
    return near.groupBy(*by).agg(
        F.sum("count").alias("count"), F.sum("n").alias("n"), mean.alias("mean"), F.greatest(spread, F.lit(0.0)).alias("m2"), F.sum("nans").alias("nans"), F.sum("infinities").alias("infinities"),
        F.min("first_iteration").alias("first_iteration"), F.min_by("first", "first_iteration").alias("first"),
    )


def summaries_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, count, mean, m2, nans, infinities, first, sd of a bin table."""
    firsts = table.withColumn("__first", F.min(F.struct("first_iteration", "first")).over(Window.partitionBy(*keys)))
    merged = merge_summaries(firsts, keys, {"first": F.first("__first.first")})
    return merged.select(*keys, "count", "mean", "m2", "nans", "infinities", "first", "sd")


def bins_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, low, high, n of a bin table: its bins with their edges."""
    low, high = edges_of(F.col("bin"), F.col("centre"), F.col("scale"))
    return table.where("bin is not null and n > 0").select(*keys, "bin", low.alias("low"), high.alias("high"), "n")


def bin_of(value: Column, centre: Column, scale: Column) -> Column:
    d = value - centre
    body = LOG + F.least(F.lit(LINEAR - 1), F.greatest(F.lit(0), F.floor((d + scale) / (2 * scale) * LINEAR)))
    k = F.least(F.lit(LOG - 1), F.floor(F.ln(F.abs(d) / scale) / math.log(RATIO)))
    return F.when(F.abs(d) < scale, body).when(d > 0, LOG + LINEAR + k).otherwise(LOG - 1 - k).cast("int")


def edges_of(bin_: Column, centre: Column, scale: Column) -> tuple[Column, Column]:
    width = 2 * scale / LINEAR
    above, below = bin_ - (LOG + LINEAR), LOG - 1 - bin_
    ratio = F.lit(RATIO)

    def edge(upper: int) -> Column:
        body = centre - scale + (bin_ - LOG + upper) * width
        return F.when((bin_ >= LOG) & (bin_ < LOG + LINEAR), body).when(bin_ >= LOG + LINEAR, centre + scale * F.pow(ratio, above + upper)).otherwise(centre - scale * F.pow(ratio, below + 1 - upper))

    return edge(0), edge(1)


def histogram(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, low, high, n of long samples (iteration, value): every finite sample in its bin, at most 4,002 bins a key.

    The bins are made and stored at once (bin_table). A key without any finite value has none.
    """
    return bins_of(bin_table(samples, keys), keys)


def quantiles(bins: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, share, value: in the first bin where the running count reaches share of all, linear inside it."""
    w = Window.partitionBy(*keys).orderBy("low")
    running = bins.withColumn("below", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    asked = running.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    target = F.col("share") * F.col("total")
    value = F.col("low") + F.greatest(F.lit(0.0), target - F.col("below")) / F.col("n") * (F.col("high") - F.col("low"))
    reached = asked.where((F.col("n") > 0) & (F.col("below") + F.col("n") >= target))
    return reached.groupBy(*keys, "share").agg(F.min_by(value, "low").alias("value"))


def rebin(bins: DataFrame, ranges: DataFrame, keys: list[str], bars: int = BARS) -> DataFrame:
    """Spreads each bin over the bars of ranges (keys, lo, hi) that it overlaps, in proportion: keys, bar, n."""
    width = (F.col("hi") - F.col("lo")) / bars
    start, end = F.greatest("low", "lo"), F.least("high", "hi")
    inside = bins.join(ranges, keys).withColumn("start", start).withColumn("end", end).where(F.col("end") > F.col("start"))
    bar_at = lambda x: F.least(F.lit(bars - 1), F.floor((x - F.col("lo")) / width)).cast("int")
    spread = inside.withColumn("bar", F.explode(F.sequence(bar_at(F.col("start")), bar_at(F.col("end")))))
    overlap = F.least(F.col("end"), F.col("lo") + (F.col("bar") + 1) * width) - F.greatest(F.col("start"), F.col("lo") + F.col("bar") * width)
    part = F.col("n") * F.greatest(overlap, F.lit(0.0)) / (F.col("high") - F.col("low"))
    return spread.groupBy(*keys, "bar").agg(F.sum(part).alias("n"))


def with_windows(bins: DataFrame, keys: list[str]) -> DataFrame:
    """bins with lo, hi, below, above of their key: the range to show, and the shares of samples outside it. One pass over a key's bins."""
    every = Window.partitionBy(*keys)
    running = bins.withColumn("__upto", F.sum("n").over(every.orderBy("low"))).withColumn("__total", F.sum("n").over(every))

    def quantile(p: float) -> Column:
        target = p * F.col("__total")
        value = F.col("low") + F.greatest(F.lit(0.0), target - (F.col("__upto") - F.col("n"))) / F.col("n") * (F.col("high") - F.col("low"))
        return F.min(F.when((F.col("n") > 0) & (F.col("__upto") >= target), F.struct("low", value.alias("value")))).over(every)["value"]

    found = running.withColumns({"__q1": quantile(TAIL), "__q2": quantile(1 - TAIL), "__from": F.min("low").over(every), "__to": F.max("high").over(every)})
    pad = (F.col("__q2") - F.col("__q1")) * PADDING
    found = found.withColumns({"lo": F.greatest("__from", F.col("__q1") - pad), "hi": F.least("__to", F.col("__q2") + pad)})
    span = F.col("__to") - F.col("__from")
    everything = ~(F.col("hi") > F.col("lo")) | (F.col("hi") - F.col("lo") >= span * NEARLY_ALL)
    margin = F.when(span > 0, span * 0.05).otherwise(F.greatest(F.abs("__from"), F.lit(1.0)) * 1e-6)
    found = found.withColumns({"lo": F.when(everything, F.col("__from") - margin).otherwise(F.col("lo")), "hi": F.when(everything, F.col("__to") + margin).otherwise(F.col("hi"))})
    width = F.col("high") - F.col("low")
    below = F.when(F.col("low") < F.col("lo"), F.col("n") * (F.least("high", "lo") - F.col("low")) / width).otherwise(0.0)
    above = F.when(F.col("high") > F.col("hi"), F.col("n") * (F.col("high") - F.greatest("low", "hi")) / width).otherwise(0.0)
    shares = {"below": F.sum(below).over(every) / F.col("__total"), "above": F.sum(above).over(every) / F.col("__total")}
    return found.withColumns(shares).drop("__upto", "__total", "__q1", "__q2", "__from", "__to")


def windows(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi, below, above: a row per key."""
    return with_windows(bins, keys).groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("lo", "hi", "below", "above")))


def on_bars(bins: DataFrame, by: list[str], bars: int = BARS) -> DataFrame:
    """by, lo, hi, bar, n: each bin (low, high, n) spread over the bars of its row's range lo to hi that it overlaps, in proportion."""
    width = (F.col("hi") - F.col("lo")) / bars
    start, end = F.greatest("low", "lo"), F.least("high", "hi")
    bar_at = lambda x: F.least(F.lit(bars - 1), F.floor((x - F.col("lo")) / width)).cast("int")
    spread = bins.where(end > start).withColumn("bar", F.explode(F.sequence(bar_at(start), bar_at(end))))
    overlap = F.least(F.col("end_"), F.col("lo") + (F.col("bar") + 1) * width) - F.greatest(F.col("start_"), F.col("lo") + F.col("bar") * width)
    part = F.col("n") * F.greatest(overlap, F.lit(0.0)) / (F.col("high") - F.col("low"))
    return spread.withColumns({"start_": start, "end_": end}).groupBy(*by, "lo", "hi", "bar").agg(F.sum(part).alias("n"))


def rebin(bins: DataFrame, ranges: DataFrame, keys: list[str], bars: int = BARS) -> DataFrame:
    """Spreads each bin over the bars of ranges (keys, lo, hi) that it overlaps, in proportion: keys, bar, n."""
    return on_bars(bins.join(ranges, keys), keys, bars).select(*keys, "bar", "n")


def display(bins: DataFrame, keys: list[str], bars: int = BARS) -> DataFrame:
    """keys, lo, hi, below, above, bar, n, height (the tallest bar is 1)."""
    shown = on_bars(with_windows(bins, keys), [*keys, "below", "above"], bars)
    return shown.withColumn("height", F.col("n") / F.max("n").over(Window.partitionBy(*keys))).select(*keys, "lo", "hi", "below", "above", "bar", "n", "height")


def growing_bins(samples: DataFrame, keys: list[str], most: int = 128) -> DataFrame:
    """keys, width, bin, n, low, high: histograms of parts of the samples (value), each on the narrowest grid that holds its part.

    A grid goes through zero, and its width is the least power of two that needs at most `most` bins. Parts are
    Arrow batches, so that the samples are read once and no range is looked for first; parts merge in merge_growing.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[np.isfinite(frame["value"])]
            for key, own in frame.groupby(keys, dropna=False, sort=False):
                values = own["value"].to_numpy()
                low, high = values.min(), values.max()
                width = _narrowest(low, high, most)
                bins, n = np.unique(np.floor(values / width), return_counts=True)
                named = {k: pd.Series([None if pd.isna(x) else x] * len(bins), dtype=object) for k, x in zip(keys, key, strict=True)}
                yield pd.DataFrame(named | {"width": width, "bin": bins.astype(np.int64), "n": n, "low": low, "high": high})

    given = samples.select(*keys, F.coalesce(F.col("value").cast("double"), F.lit(ieee.NAN)).alias("value"))
    kinds = "".join(f"`{k}` {given.schema[k].dataType.simpleString()}, " for k in keys)
    return given.mapInPandas(count, f"{kinds}width double, bin long, n long, low double, high double")


def _narrowest(low: float, high: float, most: int) -> float:
    fits = lambda e: np.floor(high / 2.0**e) - np.floor(low / 2.0**e) < most
    e = math.ceil(math.log2(max((high - low) / most, 2.0**-60)))
    return 2.0 ** (e - 1 if fits(e - 1) else e if fits(e) else e + 1)


def merge_growing(parts: DataFrame, keys: list[str], most: int = 128) -> DataFrame:
    """Histograms of parts (growing_bins, or a merged one) to that of the whole, in the same form.

    The whole's grid is at least as wide as any part's, and a power of two: a part's bins halve exactly until
    they are that wide, whatever the order in which parts meet. Only bins travel, at most `most` of a part.
    """
    every = Window.partitionBy(*keys)
    both = parts.withColumns({"__low": F.min("low").over(every), "__high": F.max("high").over(every)})
    fits = lambda e: F.floor(F.col("__high") / F.pow(F.lit(2.0), e)) - F.floor(F.col("__low") / F.pow(F.lit(2.0), e)) < most
    guess = F.ceil(F.log2(F.greatest((F.col("__high") - F.col("__low")) / most, F.lit(2.0**-60)))).cast("double")
    width = F.pow(F.lit(2.0), F.when(fits(guess - 1), guess - 1).when(fits(guess), guess).otherwise(guess + 1))
    wide = both.withColumn("__width", width)
    place = F.floor(F.col("bin") * (F.col("width") / F.col("__width")))
    return wide.groupBy(*keys, F.col("__width").alias("width"), place.alias("bin"), "__low", "__high").agg(F.sum("n").alias("n")).select(*keys, "width", "bin", "n", F.col("__low").alias("low"), F.col("__high").alias("high"))


def doubling_bins(samples: DataFrame, keys: list[str], most: int = 128) -> DataFrame:
    """keys, width, bin, n on a grid through zero whose width is the least power of two that needs at most `most` bins.

    Merging neighbours in pairs doubles the width exactly, so that batches of any split give the same bins.
    """
    return merge_growing(growing_bins(samples, keys, most), keys, most).drop("low", "high")


def halve_bins(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The same histogram with bins twice as wide."""
    return bins.groupBy(*keys, (F.col("width") * 2).alias("width"), F.floor(F.col("bin") / 2).alias("bin")).agg(F.sum("n").alias("n"))


def sketch(samples: DataFrame, keys: list[str], accuracy: int = 400) -> DataFrame:
    """keys, sketch: a quantile sketch (KLL) of the finite samples of each key, which needs no places and merges with others."""
    finite = F.when(ieee.is_finite(F.col("value")), F.col("value"))
    return samples.groupBy(*keys).agg(F.kll_sketch_agg_double(finite, accuracy).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts to those of the whole."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share (name -> share)."""
    return sketches.select(*keys, *(F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in shares.items()))
