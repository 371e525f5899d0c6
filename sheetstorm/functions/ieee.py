"""Arithmetic on doubles as IEEE 754 has it, where Spark's own would throw, give NULL or treat NaN as the greatest value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")
#: From here on every double is whole; Spark's floor would leave the range of a long.
WHOLE = float(2**53)


def nan() -> Column:
    return F.lit(NAN)


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when((a == 0) | F.isnan(a), nan()).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def ln(a: Column) -> Column:
    return F.when(F.isnan(a) | (a < 0), nan()).when(a == 0, F.lit(-INF)).otherwise(F.ln(a))


def floor(a: Column) -> Column:
    return F.when(F.isnan(a) | (F.abs(a) >= WHOLE), a).otherwise(F.floor(a).cast("double"))


def compare(how: str, a: Column, b: Column) -> Column:
    """eq ne lt gt le ge as 1.0 or 0.0; NaN equals nothing and compares false."""
    numbers = ~F.isnan(a) & ~F.isnan(b)
    test = {"eq": a == b, "ne": a == b, "lt": a < b, "gt": a > b, "le": a <= b, "ge": a >= b}[how] & numbers
    return (~test if how == "ne" else test).cast("double")


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.greatest(a, b))


def is_finite(a: Column) -> Column:
    return ~F.isnan(a) & (F.abs(a) < INF)


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def round_half_away(x: Column, digits: int) -> Column:
    """Half away from zero in binary: the sign times floor(|x| 10^d + 0.5) / 10^d."""
    return _scaled(x, digits, lambda size: floor(size + 0.5))


def round_down(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, floor)


def round_up(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, lambda size: -floor(-size))


def _scaled(x: Column, digits: int, whole) -> Column:
    scale = F.lit(10.0**digits)
    return F.when(x < 0, -1.0).otherwise(1.0) * whole(F.abs(x) * scale) / scale


def modulo(a: Column, b: Column) -> Column:
    """The sign of the divisor; NaN for a divisor of 0."""
    return a - b * floor(divide(a, b))
