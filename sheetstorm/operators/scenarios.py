"""Scenarios: combinations of alternatives, run on common random numbers; pivots; sensitivities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.compiler import CellError, Compiled, Sheet, compile_sheets, parse_number
from ..plans.lowering import Spread
from ..plans.programs import Program
from .simulate import as_sheets, column_name, iterations, run_program
from .storage import kept
from .summary import BARS, FIRST_BATCH, bin_table, bins_of, display, edges_of, long_samples, merge_summaries, on_bars, place_bins, quantiles, summaries_of, summarize, with_kind, with_sd, with_windows

Override = tuple[str, str, object]  # sheet, address, input (None clears; a callable changes what is there)


@dataclass(frozen=True)
class Dimension:
    """alternatives: (label, inputs), an input for each of the cells `Sheet!A1`; None leaves a cell as it is."""

    name: str
    cells: tuple[str, ...]
    alternatives: tuple[tuple[str, tuple], ...]


@dataclass(frozen=True)
class Scenario:
    name: str
    outputs: tuple[str, ...]
    dimensions: tuple[Dimension, ...] = ()
    samples: int = 10_000


@dataclass(frozen=True)
class Sensitivity:
    name: str
    outputs: tuple[str, ...]
    inputs: tuple[str, ...]
    steps: tuple[float, ...] = (0.1,)
    samples: int = 10_000


@dataclass(frozen=True)
class Combination:
    id: int
    choices: dict[str, str] = field(default_factory=dict)
    overrides: tuple[Override, ...] = ()


def combination_count(scenario: Scenario | Sensitivity) -> int:
    if isinstance(scenario, Sensitivity):
        return 2 * len(scenario.inputs) * len(scenario.steps)
    return reduce(lambda n, d: n * len(d.alternatives), _used(scenario), 1) if _used(scenario) else 0


def _used(scenario: Scenario) -> list[Dimension]:
    return [d for d in scenario.dimensions if d.alternatives and d.cells]


def _place(cell: str) -> tuple[str, str]:
    sheet, _, address = cell.rpartition("!")
    return sheet, address.upper()


def combinations(scenario: Scenario | Sensitivity) -> list[Combination]:
    """All choices, the last dimension fastest; of a sensitivity by input, step, and minus before plus."""
    if isinstance(scenario, Sensitivity):
        every = product(scenario.inputs, scenario.steps, (-1, 1))
        return [Combination(i, {"input": c, "step": str(h), "sign": str(s)}, ((*_place(c), scaled(1 + s * h)),)) for i, (c, h, s) in enumerate(every, 1)]
    dimensions = _used(scenario)
    found = []
    for i, picks in enumerate(product(*(d.alternatives for d in dimensions)) if dimensions else [], 1):
        overrides = tuple((*_place(c), x) for d, (_, inputs) in zip(dimensions, picks, strict=True) for c, x in zip(d.cells, inputs, strict=True) if x is not None)
        found.append(Combination(i, {d.name: label for d, (label, _) in zip(dimensions, picks, strict=True)}, overrides))
    return found


@dataclass(frozen=True)
class scaled:
    """Numbers are multiplied, formulas wrapped; texts and empty cells stay."""

    factor: float

    def __call__(self, content):
        if isinstance(content, str):
            if content.startswith("="):
                return f"=({content[1:]})*{self.factor!r}"
            number = parse_number(content)
            return content if number is None else number * self.factor
        return content if content is None else content * self.factor


def apply_overrides(sheets: list[Sheet], overrides: tuple[Override, ...]) -> list[Sheet]:
    """New sheets; the given ones are unchanged."""
    out = {s.name.lower(): replace(s, cells=dict(s.cells)) for s in sheets}
    for name, address, content in overrides:
        sheet = out[name.lower()] if name else next(iter(out.values()))
        if callable(content):
            content = content(sheet.cells.get(address))
        if content in (None, ""):
            sheet.cells.pop(address, None)
        else:
            sheet.cells[address] = content
    return list(out.values())


def resolve_outputs(compiled: Compiled, outputs: tuple[str, ...], sheets: list[Sheet]) -> tuple[dict[str, str], list[tuple[str, str, str]], list[str]]:
    """(column -> cell) of outputs that run, (column, code, message) of those that can't, and empty ones, which are 0."""
    known = {s.name.lower() for s in sheets}
    runs, errors, empty = {}, [], []
    for cell in outputs:
        name, (sheet, address) = column_name(cell), _place(cell)
        if sheet and sheet.lower() not in known:
            errors.append((name, "#REF!", f"There is no sheet {sheet}"))
        elif any(k[1] == address and (not sheet or k[0].lower() == sheet.lower()) for k in compiled.texts):
            errors.append((name, "#VALUE!", f"{cell} is a text"))
        else:
            try:
                compiled.find(cell)
                runs[name] = cell
            except CellError as e:
                errors.append((name, e.code, e.message))
            except KeyError:
                empty.append(name)
    return runs, errors, empty


@dataclass(frozen=True)
class Prepared:
    """Samples of all combinations: iteration, combination and a column for each output, which some combinations may lack."""

    samples: DataFrame
    opening: DataFrame  # the samples of the first rows
    outputs: list[str]
    errors: list[tuple[int, str, str, str]]  # combination, output, code, message
    certain: dict[str, list[int]]  # output -> combinations that rest on no draw and no column of the table


def prepare(rows: SparkSession | DataFrame, model, scenario: Scenario | Sensitivity, *, seed: int = 1, baseline: bool = True, iteration: str = "iteration") -> Prepared:
    """What a scenario computes, for iterations that are numbered (rows: a session) or the rows of a table, keyed by a column.

    A table's columns are names in the formulas. Draws are made once for a row and shared by all combinations:
    the row becomes one for each combination after them. Numbers that alternatives change are columns of the
    combination, and so are the factors of scaled formulas; what else changes compiles into the same program.
    """
    numbered = not isinstance(rows, DataFrame)
    if numbered:
        rows, first, iteration = iterations(rows, scenario.samples), iterations(rows, min(scenario.samples, FIRST_BATCH)), "iteration"
    else:
        first = rows.orderBy(iteration).limit(FIRST_BATCH)
    columns: dict[str, str | None] = {} if numbered else dict.fromkeys(rows.columns)
    sheets = as_sheets(model)
    every = ([Combination(0)] if baseline else []) + combinations(scenario)
    sheets_of = {c.id: apply_overrides(sheets, c.overrides) for c in every}
    changed = list(dict.fromkeys((n or sheets[0].name, a) for c in every for n, a, _ in c.overrides))
    content = lambda given, n, a: next((s.cells.get(a) for s in given if s.name.lower() == n.lower()), None)
    plain = compile_sheets(sheets, columns)

    # Cells that a parameter stands for: a number in every combination, or a formula times a factor.
    parameters: dict[tuple[str, str], tuple[str, str]] = {}
    values: dict[int, dict[str, float]] = {c.id: {} for c in every}
    for cell in changed:
        name, base = f"__p{len(parameters)}", content(sheets, *cell)
        inputs = {c.id: content(sheets_of[c.id], *cell) for c in every}
        factors = {c.id: next((x.factor for n, a, x in c.overrides if (n or sheets[0].name, a) == cell and isinstance(x, scaled)), 1.0) for c in every}
        if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in inputs.values()):
            parameters[cell] = name, f"={name}"
            found = {i: float(x) for i, x in inputs.items()}
        elif isinstance(base, str) and base.startswith("=") and all(x == base if factors[i] == 1.0 else x == scaled(factors[i])(base) for i, x in inputs.items()) and _is_number(plain, cell):
            parameters[cell] = name, f"=({base[1:]})*{name}"
            found = factors
        else:
            continue
        for i, x in found.items():
            values[i][name] = x

    shapes: dict[tuple, list[Combination]] = {}
    for c in every:
        shapes.setdefault(tuple(str(content(sheets_of[c.id], *cell)) for cell in changed if cell not in parameters), []).append(c)
    program, names = Program(), columns | {name: None for name, _ in parameters.values()}
    outputs: dict[int, dict[str, int]] = {}
    errors: list[tuple[int, str, str, str]] = []
    for group in shapes.values():
        own = [replace(s, cells=s.cells | {a: text for (n, a), (_, text) in parameters.items() if n.lower() == s.name.lower()}) for s in sheets_of[group[0].id]]
        compiled = compile_sheets(own, names, program)
        runs, failed, empty = resolve_outputs(compiled, scenario.outputs, own)
        errors += [(c.id, *e) for c in group for e in failed]
        regs = {name: compiled.find(cell).reg for name, cell in runs.items()} | {name: program.const(0) for name in empty}
        outputs |= {c.id: regs for c in group}
    uncertain = program.uncertain(set(columns))
    spread = Spread("combination", {c.id: values[c.id] for c in every}, {c.id: outputs[c.id] for c in every})
    certain = {name: [i for i, regs in outputs.items() if name in regs and regs[name] not in uncertain] for name in spread.columns}
    used = [] if numbered else sorted({op[1] for op in program.ops if op[0] == "input" and op[1] in columns} - {iteration})

    def run(df: DataFrame) -> DataFrame:
        given = df.select(F.col(f"`{iteration}`").cast("long").alias("iteration"), *(F.col(f"`{c}`") for c in used if c != "iteration"))
        made = run_program(given, program, {}, seed=seed, spread=spread)
        return made.select("iteration", "combination", *(F.col(f"`{c}`") for c in spread.columns))

    return Prepared(run(rows), run(first), spread.columns, errors, certain)


def _is_number(compiled: Compiled, cell: tuple[str, str]) -> bool:
    try:
        return compiled.find("!".join(cell)).granularity is None
    except (CellError, KeyError):
        return False


def _results(summaries: DataFrame, prepared: Prepared) -> DataFrame:
    """Summaries per combination and cell as results: what rests on nothing uncertain is a number, what failed an error."""
    session = summaries.sparkSession
    failed = [F.struct(F.lit(i).cast("int"), F.lit(name)) for i, name, _, _ in prepared.errors]
    if failed:
        summaries = summaries.where(~F.struct("combination", "cell").isin(failed))
    is_certain = reduce(lambda a, b: a | b, ((F.col("cell") == name) & F.col("combination").isin(ids) for name, ids in prepared.certain.items() if ids), F.lit(False))
    exact = {"mean": F.col("first"), "m2": F.lit(0.0), "sd": F.lit(0.0), "kind": F.lit("number")}
    found = with_kind(summaries)
    found = found.withColumns({c: F.when(is_certain & (F.col("kind") != "error"), v).otherwise(F.col(c)) for c, v in exact.items()})
    if not failed:
        return found
    given = session.createDataFrame([(i, name, code) for i, name, code, _ in prepared.errors], "combination int, cell string, code string")
    number = lambda v, kind="double": F.lit(v).cast(kind)
    fixed = given.select(
        "combination", "cell", number(0, "long").alias("count"), number(0).alias("mean"), number(0).alias("m2"), number(0, "long").alias("nans"), number(0, "long").alias("infinities"), number(None).alias("first"), number(0).alias("sd"), "code", F.lit("error").alias("kind"),
    )
    return found.unionByName(fixed, allowMissingColumns=True)


def run_scenario(rows: SparkSession | DataFrame, model, scenario: Scenario | Sensitivity, *, seed: int = 1, baseline: bool = True, iteration: str = "iteration") -> DataFrame:
    """combination (0: the baseline), cell, count, mean, m2, sd, nans, infinities, first, code, kind, from one reading of the rows (see prepare)."""
    prepared = prepare(rows, model, scenario, seed=seed, baseline=baseline, iteration=iteration)
    if not prepared.outputs:
        empty = prepared.samples.sparkSession.createDataFrame([], "combination int, cell string, count long, mean double, m2 double, nans long, infinities long, first double, sd double")
        return _results(empty, prepared)
    return _results(summarize(prepared.samples, prepared.outputs, ["combination"]), prepared)


@dataclass(frozen=True)
class Binned:
    """The stored bin table of a scenario (see summary.bin_table) by combination and cell, with what results need beside it."""

    table: DataFrame
    prepared: Prepared

    def results(self, shares: dict[str, float] | None = None) -> DataFrame:
        """As run_scenario, with a column for each share: that quantile, or the number itself."""
        found = _results(summaries_of(self.table, RESULT), self.prepared)
        if not shares:
            return found
        columns = [F.max(F.when(F.col("share") == p, F.col("value"))).alias(name) for name, p in shares.items()]
        read = quantiles(bins_of(self.table, RESULT), RESULT, list(shares.values())).groupBy(*RESULT).agg(*columns)
        joined = found.join(read, RESULT, "left")
        return joined.withColumns({name: F.when(F.col("kind") == "number", F.col("mean")).when(F.col("kind") == "uncertain", F.col(name)) for name in shares})

    def windows(self) -> DataFrame:
        """combination, cell, lo, hi, below, above, bar, n: the display window of every output that varies."""
        return display(bins_of(self._varying(), RESULT), RESULT).select(*RESULT, "lo", "hi", "below", "above", "bar", "n")

    def profiles(self) -> DataFrame:
        """combination, cell, kind, count, mean, lo, hi, bar, n: windows beside their result in one reading; a number has one row, without a bar."""
        every = Window.partitionBy(*RESULT)
        certain = reduce(lambda a, b: a | b, ((F.col("cell") == name) & F.col("combination").isin(ids) for name, ids in self.prepared.certain.items() if ids), F.lit(False))
        bad = F.sum(F.col("nans") + F.col("infinities")).over(every) > 0
        mean = F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)
        same = F.min("mean").over(every) == F.max("mean").over(every)
        told = self.table.withColumns({"kind": F.when(bad, "error").when(certain | (same & (F.sum("m2").over(every) == 0)), "number").otherwise("uncertain"), "total": F.sum("count").over(every), "centre_": mean})
        low, high = edges_of(F.col("bin"), F.col("centre"), F.col("scale"))
        bins = told.where("bin is not null or kind = 'error'").select(*RESULT, "kind", F.col("total").alias("count"), F.col("centre_").alias("mean"), low.alias("low"), high.alias("high"), "n")
        shown = on_bars(with_windows(bins.where("kind = 'uncertain'"), RESULT), [*RESULT, "kind", "count", "mean"])
        lone = bins.where("kind <> 'uncertain'").groupBy(*RESULT, "kind", "count", "mean").agg(F.lit(None).cast("int").alias("bar"), F.first("count").cast("double").alias("n"))
        return shown.unionByName(lone.select(*RESULT, "kind", "count", "mean", F.col("mean").alias("lo"), F.col("mean").alias("hi"), "bar", "n"))

    def _varying(self) -> DataFrame:
        certain = [F.struct(F.lit(i).cast("int"), F.lit(name)) for name, ids in self.prepared.certain.items() for i in ids]
        return self.table.where(~F.struct("combination", "cell").isin(certain)) if certain else self.table


RESULT = ["combination", "cell"]


def bin_scenario(rows: SparkSession | DataFrame, model, scenario: Scenario | Sensitivity, *, seed: int = 1, baseline: bool = True, iteration: str = "iteration") -> Binned:
    """The samples of a scenario as stored bins: results, quantiles, windows and mixtures all come from them."""
    prepared = prepare(rows, model, scenario, seed=seed, baseline=baseline, iteration=iteration)
    long = lambda samples: long_samples(samples, prepared.outputs, ["combination"]).where("value is not null")
    return Binned(bin_table(long(prepared.samples), RESULT, kept(place_bins(long(prepared.opening), RESULT))), prepared)


def scenario_windows(rows: SparkSession | DataFrame, model, scenario: Scenario | Sensitivity, **options) -> DataFrame:
    """combination, cell, lo, hi, below, above, bar, n: the display window of every output that varies, from the samples of run_scenario."""
    return bin_scenario(rows, model, scenario, **options).windows()


def choices_table(spark: SparkSession, scenario: Scenario | Sensitivity) -> DataFrame:
    """combination and a column per dimension with the label chosen."""
    every = combinations(scenario)
    names = list(every[0].choices) if every else []
    return spark.createDataFrame([(c.id, *c.choices.values()) for c in every], "combination int" + "".join(f", `{n}` string" for n in names))


def pivot(results: DataFrame, choices: DataFrame, rows: list[str], columns: list[str] | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """Pools the results of the combinations that share the fields shown; filters keep one label of a field.

    Fields that are neither shown nor filtered are pooled: the mixture of their alternatives. Any error wins.
    """
    shown = results.join(choices, "combination")
    for name, label in (filters or {}).items():
        shown = shown.where(F.col(name) == label)
    keys = [*rows, *(columns or []), "cell"]
    return pool(shown, keys)


def lattice(results: DataFrame, choices: DataFrame, fields: list[str]) -> DataFrame:
    """fields (null where pooled), cell, count, mean, m2, sd, nans, infinities, code, kind, pooled: the mixture of every choice of fields.

    One aggregation of mergeable summaries over all grouping sets: what a pivot shows, filters or pools is a
    selection of these rows (pick). `pooled` has a bit for each field, the last field the lowest. Labels are
    those that a person wrote, so that the sets are few.
    """
    finite = F.col("count") - F.col("nans") - F.col("infinities")
    every = Window.partitionBy("cell")
    shown = results.join(F.broadcast(choices), "combination").withColumn("__finite", finite)
    shown = shown.withColumn("__base", F.coalesce(F.try_divide(F.sum(F.col("__finite") * F.col("mean")).over(every), F.sum("__finite").over(every)), F.lit(0.0)))
    apart, n = F.col("mean") - F.col("__base"), F.sum("__finite")
    moved = F.coalesce(F.try_divide(F.sum(F.col("__finite") * apart), n), F.lit(0.0))
    sets = [[*(f for i, f in enumerate(fields) if not k >> (len(fields) - 1 - i) & 1), "cell"] for k in range(1 << len(fields))]
    found = shown.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in [*fields, "cell"])).agg(
        F.sum("count").alias("count"), (F.first("__base") + moved).alias("mean"), F.greatest(F.sum(F.col("m2") + F.col("__finite") * apart * apart) - moved * moved * n, F.lit(0.0)).alias("m2"),
        F.sum("nans").alias("nans"), F.sum("infinities").alias("infinities"), F.min("code").alias("code"), (F.every(F.col("kind") == "number") & (F.min("mean") == F.max("mean"))).alias("same"),
        F.shiftright(F.grouping_id(), 1).cast("int").alias("pooled"),
    )
    found = found.withColumn("m2", F.when(F.col("same"), 0.0).otherwise(F.col("m2")))
    kind = F.when(F.col("code").isNotNull(), "error").when(F.col("same"), "number").otherwise("uncertain")
    return with_sd(found).withColumn("kind", kind).drop("same")


def pick(found: DataFrame, fields: list[str], shown: list[str], filters: dict[str, str] | None = None) -> DataFrame:
    """The rows of a lattice of these fields for a choice: fields shown, fields held at a label, and all others pooled."""
    filters = filters or {}
    pooled = sum(1 << (len(fields) - 1 - i) for i, f in enumerate(fields) if f not in shown and f not in filters)
    rows = found.where(F.col("pooled") == pooled)
    for name, label in filters.items():
        rows = rows.where(F.col(name) == label)
    return rows


def pool(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results to those of their mixture: equal numbers stay a number, an error makes an error."""
    same = F.every(F.col("kind") == "number") & (F.min("mean") == F.max("mean"))
    pooled = merge_summaries(results, keys, {"code": F.min("code"), "same": same})
    return pooled.withColumn("kind", F.when(F.col("code").isNotNull(), "error").when(F.col("same"), "number").otherwise("uncertain")).drop("same")


def pool_windows(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi, bar, n: profiles (Binned.profiles, with the keys joined to them) spread over bars on the range that covers all that share the keys.

    A result that is a number counts with all its samples at one place; samples outside their own window are
    left out, as in the window. Where a result is an error there is no window. The profiles are read once.
    """
    every = Window.partitionBy(*keys)
    sound = profiles.withColumn("__bad", F.max((F.col("kind") == "error").cast("int")).over(every)).where("__bad = 0")
    whole = sound.withColumns({"__lo": F.min("lo").over(every), "__hi": F.max("hi").over(every)})
    whole = whole.withColumn("__hi", F.when(F.col("__hi") > F.col("__lo"), F.col("__hi")).otherwise(F.col("__lo") + BARS))
    width, common = (F.col("hi") - F.col("lo")) / BARS, (F.col("__hi") - F.col("__lo")) / BARS
    # A number is a bin of the breadth of a bar of the common range, so that it falls on that bar alone.
    at = F.least(F.lit(BARS - 1), F.greatest(F.lit(0), F.floor((F.col("mean") - F.col("__lo")) / common)))
    low = F.when(F.col("bar").isNull(), F.col("__lo") + at * common).otherwise(F.col("lo") + F.col("bar") * width)
    high = F.when(F.col("bar").isNull(), F.col("__lo") + (at + 1) * common).otherwise(F.col("lo") + (F.col("bar") + 1) * width)
    bins = whole.select(*keys, low.alias("low"), high.alias("high"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), "n")
    return on_bars(bins, keys).select(*keys, "lo", "hi", "bar", "n")


def window_quantiles(windows: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share (name -> share): quantiles of what windows show."""
    width = (F.col("hi") - F.col("lo")) / BARS
    bins = windows.where("n > 0").select(*keys, (F.col("lo") + F.col("bar") * width).alias("low"), (F.col("lo") + (F.col("bar") + 1) * width).alias("high"), "n")
    found = quantiles(bins, keys, list(shares.values()))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(name) for name, p in shares.items()))


def pivot_table(pooled: DataFrame, rows: list[str], column: str, labels: list[str], *, value: str = "mean", by: str | None = None, descending: bool = True) -> DataFrame:
    """rows, a column of `value` for each label of `column`, and place: the rows in order of the label `by`, missing ones last."""
    wide = pooled.groupBy(*rows).pivot(column, labels).agg(F.first(value))
    if by is None:
        return wide.withColumn("place", F.row_number().over(Window.orderBy(*rows)))
    key = F.col(f"`{by}`")
    # A pivot has a row for each choice of labels that a person wrote.
    return wide.withColumn("place", F.row_number().over(Window.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *rows)))


def against_baseline(results: DataFrame) -> DataFrame:
    """base, delta and percent (of the size of the baseline) of each combination's mean."""
    based = results.withColumn("base", F.max(F.when(F.col("combination") == 0, F.col("mean"))).over(Window.partitionBy("cell")))
    delta = F.col("mean") - F.col("base")
    return based.where("combination > 0 and base is not null").withColumn("delta", delta).withColumn("percent", F.when(F.col("base") != 0, delta / F.abs("base")))


def effects(results: DataFrame, choices: DataFrame, statistic: str = "mean") -> DataFrame:
    """input, step, cell, base, down, up: a statistic (a column of results: mean, sd, p10, ...) of the baseline and of the input lowered and raised."""
    value = F.when(F.col("kind") != "error", F.col(statistic))
    told = results.join(F.broadcast(choices), "combination", "left").withColumn("base", F.max(F.when(F.col("combination") == 0, value)).over(Window.partitionBy("cell")))
    moved = told.where("combination > 0").groupBy("input", F.col("step").cast("double").alias("step"), "cell", "base").agg(F.max(F.when(F.col("sign") == "-1", value)).alias("down"), F.max(F.when(F.col("sign") == "1", value)).alias("up"))
    return moved.select("input", "step", "cell", "base", "down", "up")


def measures(found: DataFrame) -> DataFrame:
    """elasticity, percent and delta of effects, null where the baseline is 0, and whether rise and fall differ by over 10%."""
    swing = (F.col("up") - F.col("down")) / 2
    based = F.col("base") != 0
    rise, fall = F.col("up") - F.col("base"), F.col("base") - F.col("down")
    return found.withColumns(
        {
            "delta": swing,
            "percent": F.when(based, swing / F.abs("base")),
            "elasticity": F.when(based, swing / F.col("step") / F.col("base")),
            "lopsided": F.abs(rise - fall) > 0.1 * F.greatest(F.abs(rise), F.abs(fall)),
        }
    )


def matrix_order(measured: DataFrame, measure: str = "elasticity", *, by: str = "output", descending: bool = True) -> DataFrame:
    """rank by the size of an effect, missing ones last either way: of the inputs for each output, or of the outputs for each input."""
    within, among = ("cell", "input") if by == "output" else ("input", "cell")
    size = F.abs(measure)
    w = Window.partitionBy(within).orderBy(size.desc_nulls_last() if descending else size.asc_nulls_last(), among)
    return measured.withColumn("rank", F.row_number().over(w))


def tornado(found: DataFrame) -> DataFrame:
    """cell, input, low, high against the baseline, ranked by the length of the bar."""
    bars = found.where("down is not null and up is not null").select("cell", "input", "step", (F.col("down") - F.col("base")).alias("low"), (F.col("up") - F.col("base")).alias("high"))
    return bars.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "step").orderBy(F.abs(F.col("high") - F.col("low")).desc(), "input")))


def spider(found: DataFrame) -> DataFrame:
    """cell, input, x, y: relative change of the output over that of the input, through (0, 0)."""
    based = found.where("base <> 0")
    change = lambda c: (F.col(c) - F.col("base")) / F.abs("base")
    points = F.array(F.struct((-F.col("step")).alias("x"), change("down").alias("y")), F.struct(F.col("step").alias("x"), change("up").alias("y")), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    return based.select("cell", "input", F.explode(points).alias("point")).select("cell", "input", "point.*").distinct()
