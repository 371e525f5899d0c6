"""Programs as DataFrame columns in stages, and the same programs over numpy batches as a second opinion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ieee, normal
from ..functions import random as R
from .programs import BINARY, NAN, UNARY, Program

#: An expression of more operations than this becomes a column of its own.
LARGEST = 24
#: Draws whose hashes are made side by side: rows that are much wider get no generated code.
DRAWS = 16
_BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": ieee.divide,
    "pow": ieee.power,
    "min": ieee.least,
    "max": ieee.greatest,
}
_UNARY = {
    "neg": lambda a: -a,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "ln": ieee.ln,
    "abs": F.abs,
    "floor": ieee.floor,
    "finite": lambda a: ieee.is_finite(a).cast("double"),
    "density": normal.density,
    "phi": normal.cdf,
}
#: Operations that use an argument more than once: the argument had better be a column.
_REPEATS = frozenset(["div", "min", "max", "ln", "floor", "finite", "phi", "eq", "ne", "lt", "gt", "le", "ge"])


@dataclass(frozen=True)
class Spread:
    """Combinations that every row is computed for: what each gives to inputs, and the registers of its columns."""

    key: str
    values: dict[int, dict[str, float]]
    outputs: dict[int, dict[str, int]]

    @property
    def inputs(self) -> set[str]:
        return {name for values in self.values.values() for name in values}

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(name for outputs in self.outputs.values() for name in outputs))


def lower(df: DataFrame, program: Program, outputs: dict[str, int], *, seed: int = 1, iteration: str = "iteration", spread: Spread | None = None) -> DataFrame:
    """Adds a double column per output to df, whose columns are the program's inputs.

    Only what the outputs rest on is computed. A register that is used more than once, that a wrapper
    would repeat, or that grew large is a column of a stage; stages are as few as the longest chain of
    such registers. Draws are made from the iteration column, first of all. With a spread a row then becomes
    one for each combination, so that all of them share its draws; their outputs must be the same registers.
    """
    needed = program.needs(list(outputs.values()))
    kept = df.columns
    uses = Counter(a for reg in needed for a in program.arguments(reg))
    repeated = {a for reg in needed if program.ops[reg][0] in ("un", "bin") and (program.ops[reg][1] in _REPEATS or program.ops[reg][1] == "phi_inverse") for a in program.arguments(reg)}
    draws = [reg for reg in needed if program.ops[reg][0] == "draw"]
    known = {reg for reg in draws if all(program.ops[a][0] == "const" for a in program.arguments(reg))}
    if draws:
        df = R.with_seeded(df, seed, iteration)
    for part in (draws[at : at + DRAWS] for at in range(0, len(draws), DRAWS)):
        uniforms = {reg: [f"__u{reg}_{k}" for k in range(R.UNIFORMS[program.ops[reg][1]])] for reg in part}
        df = R.with_uniforms(df, {name: (program.ops[reg][2], k) for reg, names in uniforms.items() for k, name in enumerate(names)})
        own = {reg: R.drawn(program.ops[reg][1], [F.col(x) for x in uniforms[reg]], [F.lit(program.ops[a][1]) for a in program.arguments(reg)]) for reg in part if reg in known}
        if own:  # one column instead of two uniforms
            df = df.withColumns({f"__r{reg}": column for reg, column in own.items()}).drop(*(x for reg in own for x in uniforms[reg]))
    if spread:
        names = sorted(spread.inputs)
        each = F.array(*(F.struct(F.lit(c).cast("int").alias(spread.key), *(F.lit(float(values[n])).alias(n) for n in names)) for c, values in spread.values.items()))
        df = df.select("*", F.inline(each))
        kept = [*kept, spread.key]

    columns: dict[int, Column] = {}
    stage: dict[int, int] = {}
    size: dict[int, int] = {}
    stages: dict[int, dict[str, Column]] = {}

    def settle(reg: int, column: Column, at: int, n: int, force: bool = False) -> None:
        op = program.ops[reg]
        if op[0] not in ("const", "input") and (force or uses[reg] > 1 or reg in repeated or n > LARGEST):
            name = f"__r{reg}"
            stages.setdefault(at, {})[name] = column
            columns[reg], stage[reg], size[reg] = F.col(name), at + 1, 1
        else:
            columns[reg], stage[reg], size[reg] = column, at, n

    for reg in needed:
        op = program.ops[reg]
        args = program.arguments(reg)
        c = [columns[a] for a in args]
        at = max((stage[a] for a in args), default=0)
        n = 1 + sum(size[a] for a in args)
        if op[0] == "const":
            settle(reg, F.lit(op[1]), 0, 1)
        elif op[0] == "input":
            settle(reg, F.coalesce(F.col(op[1]).cast("double"), F.lit(NAN)), 0, 1)
        elif reg in known:
            columns[reg], stage[reg], size[reg] = F.col(f"__r{reg}"), 0, 1
        elif op[0] == "draw":
            settle(reg, R.drawn(op[1], [F.col(f"__u{reg}_{k}") for k in range(R.UNIFORMS[op[1]])], c), at, n + 4)
        elif op[0] == "sel":
            settle(reg, F.when(c[0] != 0, c[1]).otherwise(c[2]), at, n)
        elif op[0] == "bin":
            settle(reg, _BINARY[op[1]](*c) if op[1] in _BINARY else ieee.compare(op[1], *c), at, n + 2 * (op[1] in _REPEATS))
        elif op[1] == "phi_inverse":
            names = f"__g{reg}", f"__p{reg}"
            stages.setdefault(at, {})[names[0]] = normal.inverse_guess(c[0])
            stages.setdefault(at + 1, {})[names[1]] = normal.cdf(F.col(names[0]))
            settle(reg, normal.inverse_step(F.col(names[0]), c[0], F.col(names[1])), at + 2, 6, force=True)
        else:
            settle(reg, _UNARY[op[1]](c[0]), at, n + 12 * (op[1] == "phi"))
    for at in sorted(stages):
        df = df.withColumns(stages[at])
    return df.select(*(F.col(f"`{c}`") for c in kept if c not in outputs), *(columns[reg].cast("double").alias(name) for name, reg in outputs.items()))


def registers(program: Program, regs: list[int], inputs: dict[str, np.ndarray | float], iterations: np.ndarray, seed: int = 1, known: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """The values of registers over a batch, a whole array per operation; those already known are not computed again."""
    values: dict[int, np.ndarray] = dict(known or {})
    with np.errstate(all="ignore"):
        for reg in program.needs(regs):
            if reg in values:
                continue
            op = program.ops[reg]
            c = [values[a] for a in program.arguments(reg)]
            if op[0] == "const":
                values[reg] = np.float64(op[1])
            elif op[0] == "input":
                values[reg] = np.asarray(inputs[op[1]], dtype=float)
            elif op[0] == "draw":
                values[reg] = R.drawn_numpy(op[1], [R.uniform_numpy(seed, iterations, op[2], k) for k in range(R.UNIFORMS[op[1]])], c)
            elif op[0] == "sel":
                values[reg] = np.where(c[0] != 0, c[1], c[2])
            else:
                values[reg] = (UNARY if op[0] == "un" else BINARY)[op[1]](*c)
    return values


def evaluate(program: Program, outputs: dict[str, int], inputs: dict[str, np.ndarray], iterations: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """The outputs of a program over a batch."""
    values = registers(program, list(outputs.values()), inputs, iterations, seed)
    return {name: np.broadcast_to(values[reg], len(iterations)).astype(float) for name, reg in outputs.items()}


def interpret(df: DataFrame, program: Program, outputs: dict[str, int], *, seed: int = 1, iteration: str = "iteration", spread: Spread | None = None) -> DataFrame:
    """As lower, but in Arrow batches: for programs too wide for generated code, and to check lower by.

    The columns of df stay, whatever their types. With a spread, what rests on no combination is computed once
    for a batch, and each combination computes its own registers only; an output that it lacks is null.
    """
    spread = spread or Spread("", {0: {}}, {0: outputs})
    names = spread.columns
    every = sorted({reg for regs in spread.outputs.values() for reg in regs.values()})
    moving = program.resting_on(lambda op: op[0] == "input" and op[1] in spread.inputs)
    shared = [reg for reg in program.needs(every) if reg not in moving]
    inputs = sorted({program.ops[r][1] for r in program.needs(every) if program.ops[r][0] == "input"} - spread.inputs)
    kept = [f for f in df.schema if f.name not in names]
    given = df.select(*(F.col(f"`{f.name}`") for f in kept), *(F.col(f"`{c}`").cast("double").alias(f"__in_{c}") for c in inputs), F.col(f"`{iteration}`").cast("long").alias("__at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # not through pandas, which would turn NaN into null
            size = batch.num_rows
            columns = {c: batch.column(f"__in_{c}").to_numpy(zero_copy_only=False).astype(float) for c in inputs}
            at = batch.column("__at").to_numpy(zero_copy_only=False)
            known = registers(program, shared, columns, at, seed)
            for combination, regs in spread.outputs.items():
                found = registers(program, list(regs.values()), columns | spread.values[combination], at, seed, known)
                made = [pa.array(np.broadcast_to(found[regs[name]], size).astype(float)) if name in regs else pa.nulls(size, pa.float64()) for name in names]
                label = [pa.array(np.full(size, combination, np.int32))] if spread.key else []
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *label, *made], [*(f.name for f in kept), *[spread.key][: len(label)], *names])

    fields = [*kept, *([T.StructField(spread.key, T.IntegerType())] if spread.key else []), *(T.StructField(name, T.DoubleType()) for name in names)]
    return given.mapInArrow(run, T.StructType(fields))
