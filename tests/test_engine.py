import math

import pytest
from pyspark.sql import functions as F

from sheetstorm.functions import ieee, random as R
from sheetstorm.operators import lookups, scenarios, summary
from sheetstorm.operators.simulate import apply_formulas, cross_check, iterations, simulate
from sheetstorm.plans.compiler import CellError, Sheet
from sheetstorm.queries import COSTS, PLANS, SHOP, STEPS
from sheetstorm.sources import workbook as W
from sheetstorm.streaming.progressive import batches, run_progressively, stream_histogram


def plain_hash(x):
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        x = ((x ^ x >> shift) * factor) % 2**32
    return x


def test_draws_are_keyed(spark):
    df = R.with_uniforms(R.with_seeded(iterations(spark, 1000, 123, 7), 5, "iteration"), {"u": (99, 0), "v": (99, 1)})
    rows = {r.iteration: r for r in df.collect()}
    for i in (123, 500, 1122):
        for name, place in (("u", 0), ("v", 1)):
            h = plain_hash(plain_hash(plain_hash(plain_hash(5) ^ i) ^ 99) ^ place)
            assert rows[i][name] == ((h >> 9) + 0.5) / 2**23
    one = simulate(spark, COSTS, ["C1"], 500, seed=3, parts=1).orderBy("iteration").collect()
    many = simulate(spark, COSTS, ["C1"], 500, seed=3, parts=9).orderBy("iteration").collect()
    assert one == many


def test_distributions(spark):
    cells = {"A1": "=UNIFORM(2,6)", "A2": "=NORMAL(10,3)", "A3": "=LOGNORMAL(0,0.5)", "A4": "=TRIANGULAR(0,1,4)", "A5": "=A1-A1", "A6": "=RAND()-RAND()"}
    names = list(cells)
    found = {r.cell: r for r in summary.summarize(simulate(spark, cells, names, 200_000, seed=42), names).collect()}
    expected = {"A1": (4, 4 / math.sqrt(12)), "A2": (10, 3), "A3": (math.exp(0.125), math.sqrt((math.exp(0.25) - 1) * math.exp(0.25))), "A4": (5 / 3, math.sqrt((16 + 1 - 4) / 18)), "A5": (0, 0), "A6": (0, math.sqrt(1 / 6))}
    for cell, (mean, sd) in expected.items():
        assert found[cell].mean == pytest.approx(mean, abs=5 * sd / math.sqrt(200_000) + 1e-12) and found[cell].sd == pytest.approx(sd, rel=0.02, abs=1e-12)


def test_ieee_wrappers(spark):
    rows = [(a, b) for a in (0.0, 1.0, -1.0, math.nan, math.inf) for b in (0.0, 2.0, math.nan, -math.inf)]
    df = spark.createDataFrame(rows, "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", ieee.divide(a, b).alias("d"), ieee.ln(a).alias("l"), ieee.floor(a).alias("f"), ieee.least(a, b).alias("m"), ieee.compare("lt", a, b).alias("lt"), ieee.compare("ne", a, b).alias("ne")).collect()
    import numpy as np

    for r in got:
        with np.errstate(all="ignore"):
            want = (np.divide(np.float64(r.a), np.float64(r.b)), np.log(np.float64(r.a)), np.floor(r.a), np.minimum(r.a, r.b), float(r.a < r.b), float(r.a != r.b))
        assert [x for x in (r.d, r.l, r.f, r.m, r.lt, r.ne)] == pytest.approx([float(x) for x in want], nan_ok=True)


def test_columns_agree_with_batches(spark):
    cells = {"A1": "=NORMAL(0,1)", "A2": "=NORMSINV(RAND())", "A3": "=IF(A1>A2,ROUND(A1,2),MOD(A2,0.3))", "A4": "=VLOOKUP(A1,B1:C3,2)", "B1": -9, "C1": 1, "B2": 0, "C2": 2, "B3": 1, "C3": 3, "A5": "=LN(A1)", "A6": "=NORMSDIST(A1)^0.5", "A7": "=1/INT(A1)", "A8": "=YEAR(DATE(2020,1,A1*100))"}
    checked = cross_check(spark, cells, ["A2", "A3", "A4", "A6", "A8"], 20_000, seed=9, tolerance=1e-10).collect()
    assert all(r.mismatches == 0 for r in checked)
    both = [simulate(spark, cells, ["A5", "A7"], 2000, engine=e).orderBy("iteration").collect() for e in ("columns", "batches")]
    for x, y in zip(*both, strict=True):
        assert list(x) == pytest.approx(list(y), nan_ok=True)


def test_unknown_outputs(spark):
    with pytest.raises(KeyError):
        simulate(spark, COSTS, ["Z9"], 10)
    with pytest.raises(CellError):
        simulate(spark, {"A1": "=NO()"}, ["A1"], 10)


def test_summaries_merge(spark):
    samples = simulate(spark, COSTS, ["C1"], 5000, seed=2)
    whole = summary.summarize(samples, ["C1"]).first()
    parts = summary.summarize(samples.withColumn("part", F.col("iteration") % 7), ["C1"], ["part"])
    merged = summary.merge_summaries(parts, ["cell"]).first()
    assert (merged["count"], merged.mean, merged.sd) == (5000, pytest.approx(whole.mean), pytest.approx(whole.sd))
    odd = spark.createDataFrame([(0, 1.0), (1, math.nan), (2, math.inf), (3, 3.0)], "iteration long, x double")
    r = summary.with_kind(summary.summarize(odd, ["x"])).first()
    assert (r["count"], r.mean, r.m2, r.nans, r.infinities, r.first, r.code) == (4, 2.0, 2.0, 1, 1, 1.0, "#NUM!") and r.sd == pytest.approx(math.sqrt(2 / 3))


def test_histograms(spark):
    samples = summary.long_samples(simulate(spark, {"A1": "=NORMAL(0,1)", "A2": "=LOGNORMAL(0,2)", "A3": 5}, ["A1", "A2", "A3"], 30_000), ["A1", "A2", "A3"])
    bins = summary.histogram(samples, ["cell"]).persist()
    totals = {r.cell: r.n for r in bins.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"A1": 30_000, "A2": 30_000, "A3": 30_000}
    q = {(r.cell, r.share): r.value for r in summary.quantiles(bins, ["cell"], [0.1, 0.5, 0.9]).collect()}
    assert q["A1", 0.1] == pytest.approx(-1.2816, abs=0.03) and q["A1", 0.5] == pytest.approx(0, abs=0.03) and q["A2", 0.9] == pytest.approx(math.exp(2 * 1.2816), rel=0.05) and q["A3", 0.5] == pytest.approx(5)
    shown = summary.display(bins, ["cell"]).collect()
    assert max(r.bar for r in shown) <= 63 and max(r.height for r in shown) == 1
    inside = {}
    for r in shown:
        inside[r.cell] = inside.get(r.cell, r.below * 30_000 + r.above * 30_000) + r.n
    assert all(v == pytest.approx(30_000) for v in inside.values())


def test_progress_and_streams(spark, tmp_path):
    assert list(batches(100, 10, 30)) == [(0, 10), (10, 20), (30, 30), (60, 30), (90, 10)]
    seen = []
    stopped = run_progressively(spark, COSTS, ["C1"], 10_000, first=500, every_seconds=0, progress=lambda n, s: seen.append(n) or n < 1500)
    assert seen == [500, 1500] and stopped.first()["count"] == 1500
    stream = stream_histogram(spark, COSTS, ["C1"], 5000).writeStream.format("memory").queryName("bins").outputMode("complete").trigger(processingTime="0 seconds").start()
    try:
        import time

        for _ in range(60):
            time.sleep(0.5)
            if (stream.lastProgress or {}).get("batchId", 0) >= 2:
                break
    finally:
        stream.stop()
    got = spark.table("bins").agg(F.sum("n").alias("n")).first().n
    assert got >= 10_000 and got % 5000 == 0
    whole = summary.histogram(summary.long_samples(simulate(spark, COSTS, ["C1"], got), ["C1"]), ["cell"])
    assert {(r.bin, r.n) for r in spark.table("bins").collect()} == {(r.bin, int(r.n)) for r in whole.collect()}


def test_scenarios(spark):
    assert scenarios.combination_count(PLANS) == 6 and scenarios.combination_count(STEPS) == 6 and [c.choices["price"] for c in scenarios.combinations(PLANS)] == ["low"] * 3 + ["high"] * 3
    rows = {(r.combination, r.cell): r for r in scenarios.run_scenario(spark, SHOP, PLANS).collect()}
    assert rows[1, "Results_A1"].mean / rows[4, "Results_A1"].mean == pytest.approx(8 / 12)  # common random numbers
    square = [Sheet("S", {"A1": "=NORMAL(10,1)", "A2": 3, "A3": "=A2^2*A1", "A4": "text"})]
    plan = scenarios.Sensitivity("s", ("S!A3", "S!A4", "S!Q9", "No!A1"), ("S!A2", "S!A1"), (0.01,), 2000)
    results = scenarios.run_scenario(spark, square, plan)
    measured = {(r.input, r.cell): r for r in scenarios.measures(scenarios.effects(results, scenarios.choices_table(spark, plan))).collect()}
    assert measured["S!A2", "S_A3"].elasticity == pytest.approx(2, rel=1e-3) and measured["S!A1", "S_A3"].elasticity == pytest.approx(1, rel=1e-6)
    codes = {r.cell: r.code for r in results.where("combination = 0").collect()}
    assert codes == {"S_A3": None, "S_A4": "#VALUE!", "S_Q9": None, "No_A1": "#REF!"}
    formulas = scenarios.Scenario("f", ("S!A3",), (scenarios.Dimension("d", ("S!A1",), (("fixed", (10,)), ("wide", ("=NORMAL(10,5)",)), ("gone", ("",)))),), 1000)
    kinds = {r.combination: (r.kind, r.mean) for r in scenarios.run_scenario(spark, square, formulas).collect()}
    assert kinds[1] == ("number", 90.0) and kinds[2][0] == "uncertain" and kinds[3] == ("number", 0.0)


def test_tables_of_lookups(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "k long, x double")
    table = spark.createDataFrame([(1, 0.0, 10.0), (2, 7.0, 20.0), (3, 3.0, 30.0)], "position int, low double, v double")
    found = {r.k: r.y for r in lookups.nearest_lookup(rows, table, "x", "low", "v", "y").collect()}
    assert found[1] == 30.0 and math.isnan(found[2]) and math.isnan(found[3])
    large = spark.range(3000).select(F.col("id").alias("position"), (F.pmod(F.col("id") * 7919, F.lit(3001)) / 3).alias("low"), F.col("id").cast("double").alias("v"))
    many = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 50 != 0, F.col("id") / 2.0 - 10).alias("x"))
    for descending in (False, True):
        a, b = ({r.k: r.y for r in lookups.nearest_lookup(many, large, "x", "low", "v", "y", descending=descending, broadcast_rows=n).collect()} for n in (10, 10_000))
        assert a.keys() == b.keys() and len(a) == 2000 and [a[k] for k in sorted(a)] == pytest.approx([b[k] for k in sorted(b)], nan_ok=True)
    assert apply_formulas(rows, {"y": "=IFERROR(x*2,-1)"}, iteration="k").orderBy("k").first().y == 10.0


def test_workbook_files(spark, tmp_path):
    path = tmp_path / "shop.json"
    W.save(str(path), SHOP, [PLANS, STEPS])
    assert W.load(str(path)) == (SHOP, [PLANS, STEPS])
    assert W.read_cells(spark, str(path)).count() == 8
    for text in ("{", "[]", '{"format": "other"}', W.dumps(SHOP).replace('"version": 1', '"version": 2'), W.dumps([]), W.dumps([SHOP[0], SHOP[0]]), W.dumps([Sheet("S", {"a1": 1})]), W.dumps([Sheet("S", names={"A1": "A1"})])):
        with pytest.raises(W.WorkbookError):
            W.loads(text)
    sheets = W.rename_name(W.set_cell(SHOP, "Inputs", "A1", " 12 "), "price", "Tariff")
    assert sheets[0].cells["A1"] == 12 and sheets[1].cells["A1"] == "=Tariff*Demand*(1-Rate)" and W.list_names(sheets)[0][0] == "Cost"
    assert "A1" not in W.set_cell(sheets, "Inputs", "A1", " ")[0].cells and W.last_row(SHOP[0]) == 5 and len(W.add_sheet(SHOP, "New")) == 3


def test_filters_lopsided_effects_and_stopping(spark):
    from sheetstorm.streaming.progressive import histogram_progressively

    results = spark.createDataFrame([(1, "x", "uncertain", 10, 1.0, 2.0, None), (2, "x", "uncertain", 10, 3.0, 2.0, None), (3, "x", "uncertain", 10, 9.0, 2.0, None)], "combination int, cell string, kind string, count long, mean double, m2 double, code string")
    results = results.selectExpr("*", "0L AS nans", "0L AS infinities")
    choices = spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "b", "q")], "combination int, one string, two string")
    kept = scenarios.pivot(results, choices, ["two"], filters={"one": "b"}).collect()
    assert sorted((r.two, r["count"], r.mean) for r in kept) == [("p", 10, 3.0), ("q", 10, 9.0)]
    both = scenarios.pivot(results, choices, ["two"]).where("two = 'p'").first()
    assert (both["count"], both.mean, both.m2) == (20, 2.0, 2 + 2 + 20 * 1.0)
    found = spark.createDataFrame([("i", 0.1, "x", 10.0, 9.0, 11.0), ("j", 0.1, "x", 10.0, 9.0, 13.0)], "input string, step double, cell string, base double, down double, up double")
    assert {r.input: r.lopsided for r in scenarios.measures(found).collect()} == {"i": False, "j": True}
    bins = histogram_progressively(spark, COSTS, ["C1"], 30_000, seed=7, first=1000, progress=lambda done, so_far: done < 3000)
    assert bins.agg({"n": "sum"}).first()[0] == 3000


def test_large_values_keep_a_small_deviation(spark):
    parts = spark.createDataFrame([(10, 1e9 - 1, 0.0), (10, 1e9 + 1, 0.0)], "count long, mean double, m2 double").selectExpr("'x' AS cell", "*", "0L AS nans", "0L AS infinities")
    assert summary.merge_summaries(parts, ["cell"]).first().m2 == pytest.approx(20.0)


def test_written_digits_and_kinds(spark):
    rows = spark.createDataFrame([(1, 123.456)], "k long, x double")
    found = apply_formulas(rows, {"a": "=ROUND(x,1.7)", "b": "=TRUNC(x,-1)", "c": "=ROUND(x,1+1)"}, iteration="k").first()
    scale = 10**1.7
    assert found.a == pytest.approx(math.floor(123.456 * scale + 0.5) / scale, rel=1e-12) and found.b == 120 and found.c == pytest.approx(123.46)
