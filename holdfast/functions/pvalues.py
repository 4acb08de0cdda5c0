"""Tail probabilities of the t and chi-square distributions.

Applied to one row per test (nine in the report), after Spark has reduced the
data to the statistics.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T

_TINY, _EPS, _STEPS = 1e-300, 1e-15, 10_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    total = d
    for i in range(1, _STEPS):
        for term in (
            i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)),
            -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            total *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return total


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of chi-square: series below the mean, continued fraction above."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        for i in range(1, _STEPS):
            term *= z / (a + i)
            total += term
            if term < total * _EPS:
                break
        return 1.0 - front * total
    b = z + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    total = d
    for i in range(1, _STEPS):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        total *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return front * total


@F.pandas_udf(T.DoubleType())
def p_value(kind: pd.Series, statistic: pd.Series, df: pd.Series) -> pd.Series:
    tails = {"t": t_two_sided, "chi2": chi2_upper}
    return pd.Series([
        None if pd.isna(s) or pd.isna(d) else tails[k](s, d) for k, s, d in zip(kind, statistic, df)
    ], dtype="float64")
