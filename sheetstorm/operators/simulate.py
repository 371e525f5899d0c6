"""Running models: over generated iterations, or over the rows of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ieee
from ..plans.compiler import Compiled, Sheet, compile_sheets
from ..plans.lowering import Spread, interpret, lower
from ..plans.programs import Program

#: Registers and draws beyond which the generated code would be too wide and its stages too many: then batches are interpreted.
WIDEST, MOST_DRAWS = 1500, 16


def as_sheets(model: dict | list[Sheet] | Sheet) -> list[Sheet]:
    """A model is its sheets, or the cells of a single sheet."""
    if isinstance(model, dict):
        return [Sheet("Sheet1", model)]
    return [model] if isinstance(model, Sheet) else list(model)


def column_name(cell: str) -> str:
    """A column for a cell: `Inputs!B3` becomes Inputs_B3."""
    return "".join(c if c.isalnum() else "_" for c in cell)


def iterations(spark: SparkSession, count: int, start: int = 0, parts: int | None = None) -> DataFrame:
    """Contiguous ids, wrapped to 32 bits as the draws take them."""
    return spark.range(start, start + count, 1, parts or spark.sparkContext.defaultParallelism).select(F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("iteration"))


def run_compiled(df: DataFrame, compiled: Compiled, outputs: dict[str, str], *, seed: int = 1, iteration: str = "iteration", engine: str = "auto") -> DataFrame:
    """df with a column for each output (column -> cell); the same draws whatever the engine and partitioning."""
    return run_program(df, compiled.program, {name: compiled.find(cell).reg for name, cell in outputs.items()}, seed=seed, iteration=iteration, engine=engine)


def run_program(df: DataFrame, program: Program, outputs: dict[str, int], *, seed: int = 1, iteration: str = "iteration", engine: str = "auto", spread: Spread | None = None) -> DataFrame:
    """df with a column for each output (column -> register); with a spread, every row once for each combination.

    Programs that are too wide for generated code run in Arrow batches, and so do combinations whose outputs
    are different registers. Either way all columns of df stay, and draws are made once for a row.
    """
    variants = list(spread.outputs.values()) if spread else [outputs]
    needed = program.needs([reg for regs in variants for reg in regs.values()])
    wide = len(needed) > WIDEST or sum(program.ops[reg][0] == "draw" for reg in needed) > MOST_DRAWS
    if engine == "batches" or (engine == "auto" and (wide or any(regs != variants[0] for regs in variants))):
        return interpret(df, program, outputs, seed=seed, iteration=iteration, spread=spread)
    return lower(df, program, variants[0], seed=seed, iteration=iteration, spread=spread)


def simulate(spark: SparkSession, model, outputs: list[str], count: int, *, seed: int = 1, start: int = 0, parts: int | None = None, engine: str = "auto") -> DataFrame:
    """iteration and a column per output cell: one row per iteration. Unknown outputs and outputs with an error raise."""
    compiled = compile_sheets(as_sheets(model))
    return run_compiled(iterations(spark, count, start, parts), compiled, {column_name(o): o for o in outputs}, seed=seed, engine=engine)


def apply_formulas(df: DataFrame, formulas: dict[str, str], *, inputs: dict[str, str | None] | None = None, model=None, seed: int = 1, iteration: str = "iteration") -> DataFrame:
    """Adds formula columns to a table: its columns are names in the formulas, beside the cells of `model`.

    inputs gives columns that hold periods their granularity; columns that aren't mentioned are numbers.
    A later formula may use an earlier one by name. Null is NaN.
    """
    names = {c: None for c in df.columns} | (inputs or {})
    cells = {f"A{i}": text for i, text in enumerate(formulas.values(), 1)}
    sheet = Sheet("Formulas", cells, names={name: f"A{i}" for i, name in enumerate(formulas, 1)})
    compiled = compile_sheets([*as_sheets(model or []), sheet], names)
    return run_compiled(df, compiled, {name: f"Formulas!A{i}" for i, name in enumerate(formulas, 1)}, seed=seed, iteration=iteration)


@dataclass(frozen=True)
class Simulation:
    """A model over numbered iterations (rows: a session) or over the rows of a table, whose columns are names; any range of ids can be run."""

    rows: SparkSession | DataFrame
    compiled: Compiled
    outputs: dict[str, str]  # column -> cell
    count: int | None = None
    seed: int = 1
    iteration: str = "iteration"

    @property
    def session(self) -> SparkSession:
        return self.rows.sparkSession if isinstance(self.rows, DataFrame) else self.rows

    def span(self) -> tuple[int, int]:
        """The first id and the one after the last."""
        if not isinstance(self.rows, DataFrame):
            return 0, self.count
        low, high = self.rows.agg(F.min(self.iteration), F.max(self.iteration)).first()
        return (0, 0) if low is None else (int(low), int(high) + 1)

    def opening(self, count: int) -> int:
        """The id after those of the first so many rows, however far apart the ids of a table are."""
        if not isinstance(self.rows, DataFrame):
            return count
        first = self.rows.select(F.col(self.iteration).cast("long").alias("id")).where("id is not null").orderBy("id").limit(count)
        last = first.agg(F.max("id")).first()[0]
        return 0 if last is None else last + 1

    def samples(self, start: int, end: int, engine: str = "auto") -> DataFrame:
        """iteration and a column per output of the ids from start to before end; in a table, a filter that its scan can use."""
        if isinstance(self.rows, DataFrame):
            own = self.rows.where((F.col(self.iteration) >= start) & (F.col(self.iteration) < end))
            used = {op[1] for op in self.compiled.program.ops if op[0] == "input"} - {self.iteration, "iteration"}
            own = own.select(F.col(self.iteration).cast("long").alias("iteration"), *(F.col(f"`{c}`") for c in sorted(used)))
        else:
            own = iterations(self.rows, end - start, start)
        return run_compiled(own, self.compiled, self.outputs, seed=self.seed, engine=engine).select("iteration", *(F.col(f"`{c}`") for c in self.outputs))


def simulation(rows: SparkSession | DataFrame, model, outputs: list[str], count: int | None = None, *, seed: int = 1, iteration: str = "iteration") -> Simulation:
    """Compiles a model. A count belongs to numbered iterations; a table runs all of its rows."""
    columns = {c: None for c in rows.columns} if isinstance(rows, DataFrame) else {}
    compiled = compile_sheets(as_sheets(model), {"iteration" if c == iteration else c: None for c in columns} | columns)
    return Simulation(rows, compiled, {column_name(o): o for o in outputs}, count, seed, iteration)


def cross_check(rows: SparkSession | DataFrame, model, outputs: list[str], count: int | None = None, *, seed: int = 1, iteration: str = "iteration", tolerance: float = 1e-4, share: float = 0.001) -> DataFrame:
    """output, compared, worst, mismatches, allowed, agrees: columns against batches, joined by iteration."""
    made = simulation(rows, model, outputs, count, seed=seed, iteration=iteration)
    a, b = (made.samples(*made.span(), engine=e) for e in ("columns", "batches"))
    return compare_samples(a, b, list(made.outputs), tolerance=tolerance, share=share)


def compare_samples(a: DataFrame, b: DataFrame, outputs: list[str], *, key: str = "iteration", tolerance: float = 1e-4, share: float = 0.001) -> DataFrame:
    """The error is relative with a floor of 1; equal infinities agree, NaN never does."""
    both = a.select(key, *outputs).join(b.select(key, *(F.col(o).alias(f"{o}__b") for o in outputs)), key)
    aggregates = []
    for o in outputs:
        x, y = F.col(o), F.col(f"{o}__b")
        error = F.when(x.eqNullSafe(y) & ~F.isnan(x), 0.0).when(ieee.is_finite(x) & ieee.is_finite(y), F.abs(x - y) / F.greatest(F.lit(1.0), F.abs(y))).otherwise(F.lit(ieee.INF))
        aggregates.append(F.struct(F.lit(o).alias("output"), F.count(F.lit(1)).alias("compared"), F.max(error).alias("worst"), F.count_if(error > tolerance).alias("mismatches")).alias(o))
    each = both.agg(*aggregates).select(F.explode(F.array(*(F.col(o) for o in outputs))).alias("x")).select("x.*")
    return each.withColumn("allowed", F.floor(F.col("compared") * share)).withColumn("agrees", F.col("mismatches") <= F.col("allowed"))
