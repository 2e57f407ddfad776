"""Intervals and exact tests as column expressions, with their constants from the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def normal_quantile(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def wilson(k: Column, n: Column, z: float = Z95, clamp: bool = True) -> Column:
    """A struct lo, hi: Wilson's score interval of k in n, held in [0, 1] if `clamp`. Null if n is not positive or k not in 0..n."""
    k, n = k.cast("double"), n.cast("double")
    p = k / F.when(n > 0, n)
    base = 1 + z * z / F.when(n > 0, n)
    centre = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    lo, hi = centre - half, centre + half
    if clamp:
        lo, hi = F.greatest(F.lit(0.0), lo), F.least(F.lit(1.0), hi)
    return F.when((n > 0) & (k >= 0) & (k <= n), F.struct(lo.alias("lo"), hi.alias("hi")))


def _stirling_rest(n: int) -> float:
    """ln n! less Stirling's formula for it, n > 0."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def binomial_p(a: int, b: int) -> float:
    """min(1, 2 P(X <= min(a, b))) of a + b fair draws.

    The term at min(a, b) comes from its distance to the middle, without differences of large logarithms; the terms below it
    are ratios to it and are added until they don't count, which is after some sqrt(a + b) terms at most.
    """
    n, m = a + b, min(a, b)
    if a == b:
        return 1.0
    if m == 0:
        return 2.0 ** (1 - n) if n < 1075 else 0.0
    e = (n - 2 * m) / n
    far = sum(e ** (2 * k) / (k * (2 * k - 1)) for k in range(1, 30)) if e < 0.5 else (1 - e) * math.log1p(-e) + (1 + e) * math.log1p(e)
    log_term = _stirling_rest(n) - _stirling_rest(m) - _stirling_rest(n - m) - n / 2 * far + 0.5 * math.log(n / (2 * math.pi * m * (n - m)))
    total, ratio, k = 1.0, 1.0, m
    while k > 0 and ratio > 1e-18 * total:
        ratio *= k / (n - k + 1)
        total += ratio
        k -= 1
    return min(1.0, 2 * math.exp(log_term) * total)


def binomial_two_sided(a: Column, b: Column) -> Column:
    """The exact two-sided p-value of a against b under equal odds, `binomial_p`; 1 if both are 0, null if one is null. For few rows, as it goes to Python."""

    def p_values(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([binomial_p(int(x), int(y)) if pd.notna(x) and pd.notna(y) else None for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(p_values, DoubleType())(a.cast("bigint"), b.cast("bigint"))
