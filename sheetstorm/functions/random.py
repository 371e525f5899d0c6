"""Draws keyed by (seed, iteration, stream, place): the same whatever the partitioning, unlike rand().

A 32-bit hash is three steps that each use their input twice. Written as one expression a draw would
double at every step, so that each step is a column of its own (a stage).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed values of the 32-bit mixing hash: shifts and multipliers, and the constants of FNV-1a.
SHIFTS, FACTORS = (16, 15, 16), (0x7FEB352D, 0x846CA68B)
FNV_START, FNV_FACTOR, GOLDEN = 0x811C9DC5, 0x01000193, 0x9E3779B9
#: Uniforms a kind of draw needs.
UNIFORMS = {"uniform": 1, "normal": 2, "lognormal": 2, "triangular": 1}


def hash32(x: int) -> int:
    for shift, factor in zip(SHIFTS, (*FACTORS, 1), strict=True):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x


def hash32_numpy(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in zip(SHIFTS, (*FACTORS, 1), strict=True):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(MASK)
    return x


def stream_of(sheet: str, address: str, place: int) -> int:
    """The stream of the place-th draw in a cell's formula: it depends on the cell's name only."""
    h = FNV_START
    for byte in f"{sheet.lower()}!{address}".encode():
        h = ((h ^ byte) * FNV_FACTOR) & MASK
    return hash32((h + place * GOLDEN) & MASK)


def with_hashes(df: DataFrame, sources: dict[str, Column]) -> DataFrame:
    """Adds the hashes of longs below 2**32 (name -> source): four stages, however many there are."""
    df = df.withColumns({f"{name}_0": source for name, source in sources.items()})
    for i, (shift, factor) in enumerate(zip(SHIFTS, (*FACTORS, 1), strict=True)):
        # A factor above 2**31 is taken less 2**32: the same low bits, and the product stays within a long.
        signed = F.lit(factor if factor < 1 << 31 else factor - (1 << 32)).cast("long")
        steps = {}
        for name in sources:
            x = F.col(f"{name}_{i}")
            steps[f"{name}_{i + 1}" if i < 2 else name] = (x.bitwiseXOR(F.shiftright(x, shift)) * signed).bitwiseAND(F.lit(MASK))
        df = df.withColumns(steps)
    return df.drop(*(f"{name}_{i}" for name in sources for i in range(3)))


def unit(u: Column) -> Column:
    """23 bits, in the open interval (0, 1)."""
    return (F.shiftright(u, 9).cast("double") + 0.5) * 2.0**-23


def with_seeded(df: DataFrame, seed: int, iteration: str) -> DataFrame:
    """Adds __seeded, the hash of seed and iteration that all draws share."""
    return with_hashes(df, {"__seeded": F.col(iteration).cast("long").bitwiseAND(F.lit(MASK)).bitwiseXOR(F.lit(hash32(seed & MASK)).cast("long"))})


def with_uniforms(df: DataFrame, streams: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds uniforms (name -> (stream, place)) to rows with __seeded, in eight stages. Places share the hash of their stream."""
    if not streams:
        return df
    of_stream = {stream: f"__stream_{stream}" for stream, _ in streams.values()}
    df = with_hashes(df, {name: F.col("__seeded").bitwiseXOR(F.lit(stream).cast("long")) for stream, name in of_stream.items()})
    df = with_hashes(df, {f"{name}_hash": F.col(of_stream[stream]).bitwiseXOR(F.lit(place).cast("long")) for name, (stream, place) in streams.items()})
    return df.withColumns({name: unit(F.col(f"{name}_hash")) for name in streams}).drop(*(f"{name}_hash" for name in streams), *of_stream.values())


def uniform_numpy(seed: int, iteration: np.ndarray, stream: int, place: int) -> np.ndarray:
    x = hash32_numpy((iteration.astype(np.int64) & MASK).astype(np.uint64) ^ np.uint64(hash32(seed & MASK)))
    x = hash32_numpy(hash32_numpy(x ^ np.uint64(stream)) ^ np.uint64(place))
    return ((x >> np.uint64(9)).astype(float) + 0.5) * 2.0**-23


def drawn(kind: str, u: list[Column], args: list[Column]) -> Column:
    if kind == "uniform":
        return args[0] + (args[1] - args[0]) * u[0]
    if kind == "triangular":
        low, mode, high = args
        span = high - low
        return F.when(u[0] * span < mode - low, low + F.sqrt(u[0] * span * (mode - low))).otherwise(high - F.sqrt((1 - u[0]) * span * (high - mode)))
    value = args[0] + args[1] * (F.sqrt(-2 * F.ln(u[0])) * F.cos(F.lit(np.pi) * (2 * u[1] - 1)))
    return F.exp(value) if kind == "lognormal" else value


def drawn_numpy(kind: str, u: list[np.ndarray], args: list[np.ndarray]) -> np.ndarray:
    if kind == "uniform":
        return args[0] + (args[1] - args[0]) * u[0]
    if kind == "triangular":
        low, mode, high = args
        span = high - low
        with np.errstate(invalid="ignore"):
            return np.where(u[0] * span < mode - low, low + np.sqrt(u[0] * span * (mode - low)), high - np.sqrt((1 - u[0]) * span * (high - mode)))
    value = args[0] + args[1] * (np.sqrt(-2 * np.log(u[0])) * np.cos(np.pi * (2 * u[1] - 1)))
    return np.exp(value) if kind == "lognormal" else value
