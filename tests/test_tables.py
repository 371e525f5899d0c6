"""Runs in phases, engines that stop each other, durable streams, growing histograms, sketches, lattices, running totals, as-of by key, dependencies."""

import math
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from sheetstorm.operators import dependencies, lookups, scenarios, summary
from sheetstorm.operators import simulate as simulate_module
from sheetstorm.operators.simulate import simulation
from sheetstorm.plans.compiler import Sheet
from sheetstorm.queries import COSTS, PLANS, SHOP, WALK
from sheetstorm.sources.workbook import cells_table
from sheetstorm.streaming import progressive
from sheetstorm.streaming.accumulated import accumulate, accumulated


@pytest.mark.parametrize("draws", [16, 17, 60])
def test_scenarios_of_wide_models_over_a_table(spark, draws):
    rows = spark.range(400).select(F.col("id").alias("key"), (F.col("id") / 100).alias("x"), F.lit("kept").alias("text"))
    model = [Sheet("S", {"A1": 2, **{f"B{i}": f"=UNIFORM(0,{i})" for i in range(1, draws + 1)}, "C1": f"=A1*SUM(B1:B{draws})+x", "C2": "=A1*10"})]
    plan = scenarios.Scenario("p", ("S!C1", "S!C2"), (scenarios.Dimension("a", ("S!A1",), (("one", (1,)), ("three", (3,)))),))
    found = {(r.combination, r.cell): r for r in scenarios.run_scenario(rows, model, plan, iteration="key").collect()}
    assert {c for c, _ in found} == {0, 1, 2} and all(r["count"] == 400 for r in found.values())
    low, base, high = (found[i, "S_C1"].mean - 1.995 for i in (1, 0, 2))
    assert base == pytest.approx(2 * low) and high == pytest.approx(3 * low) and low == pytest.approx(sum(range(1, draws + 1)) / 2, rel=0.05)
    assert [found[i, "S_C2"].kind for i in range(3)] == ["number"] * 3 and found[2, "S_C2"].mean == 30


def test_one_reading_for_all_combinations(spark):
    rows = spark.range(100).withColumnRenamed("id", "key").withColumn("o", F.lit(1.0))
    made = scenarios.prepare(rows, SHOP, PLANS, iteration="key").samples
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1 and "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_phases_agree_with_one_run(spark):
    run = simulation(spark, COSTS, ["C1"], 20_000, seed=7)
    seen = []
    state = progressive.run_in_phases(run, first=1000, binned_until=9000, every_seconds=0, progress=lambda s: seen.append(s.done))
    whole = summary.summarize(run.samples(0, 20_000), ["C1"]).first()
    got = state.summaries().first()
    assert (got["count"], got.first) == (20_000, whole.first) and got.mean == pytest.approx(whole.mean, rel=1e-12) and got.sd == pytest.approx(whole.sd, rel=1e-9)
    assert seen == [1000, 3000, 7000, 9000, 20_000] or seen[-1] == 20_000
    assert state.bins().agg(F.sum("n")).first()[0] == 9000
    exact = summary.histogram(summary.long_samples(run.samples(0, 9000), ["C1"]), ["cell"])
    assert {(r.bin, r.n) for r in state.bins().collect()} == {(r.bin, r.n) for r in exact.collect()}


def test_nothing_finite_at_first_and_empty_tables(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") > 9000, F.col("id").cast("double")).alias("x"))
    state = progressive.run_in_phases(simulation(rows, {"A1": "=x*2"}, ["A1"], iteration="k"))
    assert state.bins().agg(F.sum("n")).first()[0] == 10_999 and state.summaries().first().nans == 9001


def test_a_tag_stops_a_run(spark):
    over = threading.Event()

    def again():  # an interruption reaches jobs that run; between two of them there is none
        while not over.wait(0.5):
            spark.sparkContext.cancelJobsWithTag("mine")

    thread = threading.Thread(target=again)
    thread.start()
    try:
        with pytest.raises(Exception, match="(?i)cancel|interrupt"):
            progressive.run_progressively(spark, WALK, list(WALK), 20_000_000, first=4_000_000, tag="mine")
    finally:
        over.set()
        thread.join()


def test_engines_run_at_once_and_stop_each_other(spark, monkeypatch):
    run = simulation(spark, COSTS, ["C1", "B1"], 9000, seed=7)
    state = progressive.run_engines(run, first=1000, compared=5000)
    assert {(r.output, r.compared, r.mismatches, r.agrees) for r in state.comparison().collect()} == {("C1", 5000, 0, True), ("B1", 5000, 0, True)} and set(state.done.values()) == {9000}

    real = simulate_module.interpret

    def failing(df, *args, **kw):
        time.sleep(1)
        raise RuntimeError("the second engine fails")

    monkeypatch.setattr(simulate_module, "interpret", failing)
    long = simulation(spark, {"A1": "=NORMAL(0,1)"}, ["A1"], 400_000_000)
    began = time.time()
    with pytest.raises(RuntimeError, match="second engine"):
        progressive.run_engines(long, first=100_000_000, compared=10)
    assert time.time() - began < 60
    monkeypatch.setattr(simulate_module, "interpret", real)


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    rng = random.Random(4)
    rows = [("late" if i > 600 and i % 3 == 0 else "k", i, math.nan if i % 50 == 7 else rng.gauss(0, 1) * 10 ** rng.randrange(4)) for i in range(1000)]
    df = spark.createDataFrame(rows, "cell string, iteration long, value double")
    folder = str(tmp_path)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")
        accumulate(stream, ["cell"], f"{folder}/state", merged_every=2).awaitTermination()

    for i in range(5):
        df.where(F.floor(F.col("iteration") / 200) == i).coalesce(1).write.mode("append").parquet(f"{folder}/source")
        if i in (1, 4):
            run()
    plain = lambda: {tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else repr(x) for x in r) for r in accumulated(spark, f"{folder}/state", ["cell"]).collect()}
    first = plain()
    # A batch that was written but not committed is run again: as if the driver had died between both.
    commits = sorted((tmp_path / "state/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "state/checkpoint/commits").glob(".*crc"):
        crc.unlink()
    run()
    assert plain() == first
    got = {r.cell: r for r in summary.summaries_of(accumulated(spark, f"{folder}/state", ["cell"]), ["cell"]).collect()}
    want = {r["key"]: r for r in summary.summarize(df.select(F.col("cell").alias("key"), "iteration", F.col("value").alias("v")), ["v"], ["key"]).collect()}
    for key, r in want.items():
        assert (got[key]["count"], got[key].nans) == (r["count"], r.nans) and got[key].mean == pytest.approx(r.mean) and got[key].m2 == pytest.approx(r.m2)


def test_growing_histograms_merge_in_any_order(spark):
    rng = random.Random(9)
    rows = [("a", rng.gauss(5, 1)) for _ in range(3000)] + [("a", -1e6), ("a", math.nan), (None, 3.0), ("b", math.inf), ("c", 0.0), ("c", 0.0)]
    df = spark.createDataFrame(rows, "cell string, value double").repartition(5)
    whole = {(r.cell, r.width, r.bin): r.n for r in summary.doubling_bins(df, ["cell"]).collect()}
    counted = {}
    for (cell, _, _), n in whole.items():
        counted[cell] = counted.get(cell, 0) + n
    assert counted == {"a": 3001, None: 1, "c": 2}
    parts = summary.growing_bins(df.where("cell in ('a', 'c')"), ["cell"])
    left = summary.merge_growing(parts.where("low > -100"), ["cell"])
    right = summary.merge_growing(parts.where("low <= -100"), ["cell"])
    both = summary.merge_growing(left.unionByName(right), ["cell"])
    assert {(r.cell, r.width, r.bin): r.n for r in both.collect()} == {k: n for k, n in whole.items() if k[0] in ("a", "c")}
    (width,) = {w for c, w, _ in whole if c == "a"}
    assert math.log2(width).is_integer() and 1e6 / 128 <= width <= 4e6 / 128


def test_sketches_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 4).alias("part"), F.when(F.col("id") % 100 == 0, math.nan).otherwise(F.col("id").cast("double")).alias("value"))
    merged = summary.merge_sketches(summary.sketch(df, ["part"]).withColumn("all", F.lit(1)), ["all"])
    r = summary.sketch_quantiles(merged, ["all"], {"p10": 0.1, "p90": 0.9}).first()
    assert r.p10 == pytest.approx(4000, abs=600) and r.p90 == pytest.approx(36_000, abs=600)


def test_lattice_holds_every_pivot(spark):
    results = scenarios.run_scenario(spark, SHOP, PLANS)
    choices = scenarios.choices_table(spark, PLANS)
    found = scenarios.lattice(results, choices, ["price", "terms"]).persist()
    for shown, filters in ((["price"], {}), (["price"], {"terms": "worse"}), (["terms"], {"price": "low"}), ([], {"price": "high"}), (["price", "terms"], {})):
        a = {(tuple(r[c] for c in shown), r.cell): (r["count"], round(r.mean, 9), round(r.sd, 6), r.kind) for r in scenarios.pick(found, ["price", "terms"], shown, filters).collect()}
        b = {(tuple(r[c] for c in shown), r.cell): (r["count"], round(r.mean, 9), round(r.sd, 6), r.kind) for r in scenarios.pivot(results, choices, shown, filters=filters).collect()}
        assert a == b


def test_running_totals(spark):
    rows = [("s", 3, 1.5), ("s", 5, 2.0), ("s", 5, 9.0), ("s", 8, None), ("s", 9, math.nan), ("s", 12, 4.0), ("t", 1, 7.0)]
    series = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "series string, period long, value double, row int")
    asked = [(0, "s", 0, 4), (1, "s", 3, 5), (2, "s", 4, 8), (3, "s", 6, 20), (4, "s", 10, 12), (5, "s", 13, 20), (6, "s", 5, 4), (7, "t", 1, 1), (8, "no", 1, 9), (9, None, 1, 2), (10, "s", None, 4)]
    found = {r.k: (r.total, r.periods) for r in lookups.range_totals(spark.createDataFrame(asked, "k int, series string, a long, b long"), series, "a", "b").collect()}
    assert math.isnan(found.pop(3)[0])
    assert found == {0: (1.5, 2), 1: (3.5, 3), 2: (2.0, 5), 4: (4.0, 3), 5: (0.0, 0), 6: (0.0, 0), 7: (7.0, 1), 8: (0.0, 0), 9: (0.0, 0), 10: (0.0, 0)}


@pytest.mark.parametrize("descending", [False, True])
def test_nearest_by_key(spark, descending):
    rng = random.Random(2)
    table = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", i, float(rng.randrange(200)), float(i)) for i in range(900)]
    rows = [(i, rng.choice(["hot", "hot", "hot", f"k{rng.randrange(35)}", None]), rng.choice([5.0, float(rng.randrange(-5, 205)), math.nan, None])) for i in range(1500)]
    df, t = spark.createDataFrame(rows, "id int, key string, x double"), spark.createDataFrame(table, "key string, position int, low double, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.id: r.y for r in lookups.nearest_lookup(df, t, "x", "low", "v", "y", descending=descending, by=("key",)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, key, x in rows:
        fits = [(p, v) for k, p, low, v in table if k == key and x is not None and (low >= x if descending else low <= x)]
        assert found[i] == max(fits)[1] if fits else math.isnan(found[i])


def test_references_and_circles(spark):
    sheet = {"A1": 1, "A2": "=A1+$B$3*Other!C1", "B3": "=SUM(A4:B5)+LOG10(A1)", "A4": "=a5", "A5": "=B5", "B5": "=A4", "B4": "text", "C1": "=C1", "C2": "=C1+D2", "D2": "=RAND()", "D3": "=D2*2", "AB7": "=A1:A1"}
    cells = cells_table(spark, [Sheet("S", sheet), Sheet("Other", {"C1": "=S!D3"})])
    edges = {(r.node, r.needs) for r in dependencies.references(cells).collect()}
    assert edges >= {("S!A2", "S!A1"), ("S!A2", "S!B3"), ("S!A2", "Other!C1"), ("S!B3", "S!A4"), ("S!B3", "S!B4"), ("S!A4", "S!A5"), ("Other!C1", "S!D3"), ("S!AB7", "S!A1")} and not any("10" in b for _, b in edges)
    found = {r.node: r for r in dependencies.analyse(cells).collect()}
    assert {n: r.cycle for n, r in found.items() if r.cycle} == {"S!A4": "S!A4", "S!A5": "S!A4", "S!B5": "S!A4", "S!C1": "S!C1"}
    assert {n for n, r in found.items() if r.blocked} == {"S!B3", "S!A2", "S!C2"}
    assert {n: r.level for n, r in found.items() if r.level is not None} == {"S!A1": 0, "S!D2": 0, "S!D3": 1, "Other!C1": 2, "S!AB7": 1}
    assert {n for n, r in found.items() if r.uncertain} == {"S!D2", "S!D3", "Other!C1", "S!A2", "S!C2"}


def test_circles_that_share_no_name(spark):
    rng = random.Random(1)
    edges = sorted({(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(55)})
    nodes = sorted({x for e in edges for x in e})
    reach = {a: {b for x, b in edges if x == a} for a in nodes}
    for _ in nodes:
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    want = {a: min(b for b in r if a in reach[b]) for a, r in reach.items() if a in r}
    got = dependencies.cycles(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "node string, needs string"))
    assert {r.node: r.cycle for r in got.collect()} == want


def test_progressive_histogram_bins_every_row(spark):
    """Ids beyond BINNED count too, and bins rest on the first rows, not on the first ids, where ids are far apart."""
    count = progressive.BINNED + 9000
    rows = spark.range(count).select((F.col("id") * 5).alias("k"), (F.col("id") % 777).cast("double").alias("x"))
    bins = progressive.histogram_progressively(rows, {"A1": "=x"}, ["A1"], first=100_000, iteration="k")
    want = summary.histogram(rows.select(F.lit("A1").alias("cell"), F.col("k").alias("iteration"), F.col("x").alias("value")), ["cell"])
    assert sorted(map(tuple, bins.collect())) == sorted(map(tuple, want.collect()))
    assert bins.agg(F.sum("n")).first()[0] == count


def test_dependencies_send_no_table_to_the_driver(spark):
    cells = cells_table(spark, [Sheet("S", {"A1": "=UNIFORM(0,1)", "A2": "=A1", "B1": "=B2", "B2": "=B1"})])
    found = dependencies.analyse(cells)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.node: (r.level, r.cycle, r.uncertain) for r in found.collect()} == {"S!A1": (0, None, True), "S!A2": (1, None, True), "S!B1": (None, "S!B1", False), "S!B2": (None, "S!B1", False)}
