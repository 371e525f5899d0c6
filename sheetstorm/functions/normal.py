"""The standard normal distribution: density, cumulative (a rational fit by Hart) and its inverse (Acklam's fit, one Halley step)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ieee import nan

#: Coefficients of the published fits, highest power first.
CDF_ABOVE = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BELOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_SPLIT, CDF_END, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.506628274631
INVERSE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
INVERSE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
INVERSE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INVERSE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
INVERSE_SPLIT = 0.02425


def _horner(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _fraction(x, one):
    """The continued fraction of the tail, five levels deep."""
    out = x + 0.65
    for level in (4, 3, 2, 1):
        out = x + level / out
    return one / out


def density(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def cdf(z: Column) -> Column:
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    tail = F.when(x > CDF_END, F.lit(0.0)).when(x < CDF_SPLIT, e * _horner(CDF_ABOVE, x) / _horner(CDF_BELOW, x)).otherwise(e * _fraction(x, F.lit(1.0)) / ROOT_TWO_PI)
    return F.when(F.isnan(z), nan()).when(z > 0, 1 - tail).otherwise(tail)


def cdf_numpy(z):
    x = np.abs(np.asarray(z, dtype=float))
    with np.errstate(all="ignore"):
        e = np.exp(-x * x / 2)
        tail = np.where(x > CDF_END, 0.0, np.where(x < CDF_SPLIT, e * _horner(CDF_ABOVE, x) / _horner(CDF_BELOW, x), e * _fraction(x, 1.0) / ROOT_TWO_PI))
        return np.where(np.isnan(z), np.nan, np.where(np.asarray(z) > 0, 1 - tail, tail))


def inverse_guess(p: Column) -> Column:
    """Acklam's fit; NaN outside (0, 1)."""

    def outer(q: Column) -> Column:
        r = F.sqrt(-2 * F.ln(q))
        return _horner(INVERSE_C, r) / _horner(INVERSE_D, r)

    d = p - 0.5
    inner = d * _horner(INVERSE_A, d * d) / _horner(INVERSE_B, d * d)
    return (
        F.when(F.isnan(p) | (p <= 0) | (p >= 1), nan())
        .when(p < INVERSE_SPLIT, outer(p))
        .when(p > 1 - INVERSE_SPLIT, -outer(1 - p))
        .otherwise(inner)
    )


def inverse_step(guess: Column, p: Column, cumulative: Column) -> Column:
    """One Halley step; cumulative is cdf(guess), best a column of its own."""
    u = (cumulative - p) * math.sqrt(2 * math.pi) * F.exp(guess * guess / 2)
    return F.when(F.isnan(guess), nan()).otherwise(guess - u / (1 + guess * u / 2))


def inverse(p: Column) -> Column:
    guess = inverse_guess(p)
    return inverse_step(guess, p, cdf(guess))


def inverse_numpy(p):
    p = np.asarray(p, dtype=float)
    with np.errstate(all="ignore"):

        def outer(q):
            r = np.sqrt(-2 * np.log(q))
            return _horner(INVERSE_C, r) / _horner(INVERSE_D, r)

        d = p - 0.5
        guess = np.where(p < INVERSE_SPLIT, outer(p), np.where(p > 1 - INVERSE_SPLIT, -outer(1 - p), d * _horner(INVERSE_A, d * d) / _horner(INVERSE_B, d * d)))
        guess = np.where((p > 0) & (p < 1), guess, np.nan)
        u = (cdf_numpy(guess) - p) * math.sqrt(2 * math.pi) * np.exp(guess * guess / 2)
        return guess - u / (1 + guess * u / 2)
