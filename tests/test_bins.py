"""Wide programs keep a table's columns; stored bins keep every key, merge, and rest on no second look."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetstorm.operators import summary
from sheetstorm.operators.simulate import apply_formulas


@pytest.mark.parametrize("draws", [15, 16, 17, 60])
def test_wide_formulas_keep_the_columns_of_the_table(spark, draws):
    rows = spark.createDataFrame([(i, f"k{i}", [i], None if i == 3 else i / 2) for i in range(20)], "id long, keep string, list array<int>, x double")
    formulas = {f"c{i}": f"=UNIFORM({i},{i + 1})+x" for i in range(draws)}
    made = apply_formulas(rows, formulas, iteration="id", seed=3)
    assert made.columns == ["id", "keep", "list", "x", *formulas]
    found = {r.id: r for r in made.collect()}
    assert all(found[i].keep == f"k{i}" and found[i].list == [i] for i in range(20)) and found[3].x is None and math.isnan(found[3].c0)
    narrow = {r.id: r for r in apply_formulas(rows, dict(list(formulas.items())[:4]), iteration="id", seed=3).collect()}
    for i in (0, 7, 19):
        assert [found[i][f"c{k}"] for k in range(4)] == pytest.approx([narrow[i][f"c{k}"] for k in range(4)], rel=1e-12)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "key string, iteration long, value double")


def totals(bins):
    return {r.key: r.n for r in bins.groupBy("key").agg(F.sum("n").alias("n")).collect()}


def test_keys_with_large_ids_keep_their_samples(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 9000, "a").otherwise("b").alias("key"), F.col("id").alias("iteration"), F.col("id").cast("double").alias("value"))
    bins = summary.histogram(rows, ["key"])
    assert totals(bins) == {"a": 9000, "b": 11_000}
    assert bins.where("key = 'b'").agg(F.min("low"), F.max("high")).first()[0] <= 9000


def test_keys_without_finite_values_at_first(spark):
    late = [("late", i, math.nan if i < summary.FIRST_BATCH else float(i)) for i in range(summary.FIRST_BATCH + 500)]
    rows = [*late, *(("never", i, [math.nan, math.inf, -math.inf][i % 3]) for i in range(9)), *((None, i, float(i)) for i in range(10)), ("one", 5, 2.0), ("null", 1, None)]
    table = summary.bin_table(rows_of(spark, rows), ["key"])
    assert totals(summary.bins_of(table, ["key"])) == {"late": 500, None: 10, "one": 1}
    found = {r.key: r for r in summary.summaries_of(table, ["key"]).collect()}
    assert (found["never"]["count"], found["never"].nans, found["never"].infinities, found["never"].mean) == (9, 3, 6, 0.0)
    assert (found["late"]["count"], found["late"].nans, found["late"].mean) == (summary.FIRST_BATCH + 500, summary.FIRST_BATCH, pytest.approx(summary.FIRST_BATCH + 249.5))
    assert found[None].mean == 4.5 and math.isnan(found["late"].first) and found["null"]["count"] == 1


def test_tables_of_parts_merge_to_that_of_the_whole(spark):
    rng = np.random.default_rng(3)
    values = [*np.exp(rng.standard_normal(3000) * 2).tolist(), math.nan, math.inf, 1e9]
    rows = rows_of(spark, [("k", i, float(v)) for i, v in enumerate(values)])
    whole = summary.bin_table(rows, ["key"])
    places = summary.place_bins(rows, ["key"])
    parts = [summary.bin_table(rows.where(F.col("iteration") % 3 == i), ["key"], places) for i in range(3)]
    merged = summary.merge_bins(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["key"])
    key = lambda t: {r.bin: (r["count"], r.n, r.nans, r.infinities, r.first_iteration, repr(r.first)) for r in t.collect()}
    assert key(merged) == key(whole)
    a, b = (summary.summaries_of(t, ["key"]).first() for t in (merged, whole))
    assert a.mean == pytest.approx(b.mean, rel=1e-12) and a.m2 == pytest.approx(b.m2, rel=1e-9) and a["count"] == 3003
    exact = np.array([v for v in values if math.isfinite(v)])
    assert b.mean == pytest.approx(exact.mean()) and b.m2 == pytest.approx(((exact - exact.mean()) ** 2).sum(), rel=1e-9)


def test_display_reads_its_bins_once(spark):
    shown = summary.display(summary.histogram(rows_of(spark, [("k", i, float(i)) for i in range(100)]), ["key"]), ["key"])
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
