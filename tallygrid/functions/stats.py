"""Statistical expressions: shape, rounding, confidence limits and p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: The normal quantile of 95 % limits.
Z95 = 1.96


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``whole``; null for an empty whole."""
    return F.round(F.try_divide(part * 100.0, whole), digits)


def skewness(x: str, n: Column) -> Column:
    """Bias-adjusted skewness: null under 3 values, 0 for a constant."""
    adjusted = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.var_pop(x) == 0, 0.0).otherwise(adjusted)


def kurtosis(x: str, n: Column) -> Column:
    """Bias-adjusted excess kurtosis: null under 4 values, 0 for a constant."""
    adjusted = F.try_divide((n - 1) * ((n + 1) * F.kurtosis(x) + 6), (n - 2) * (n - 3))
    return F.when(n < 4, None).when(F.var_pop(x) == 0, 0.0).otherwise(adjusted)


def wald_limits(p: Column, n: Column) -> tuple[Column, Column]:
    """95 % limits of a proportion, within 0 and 1."""
    half = Z95 * F.sqrt(p * (1 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    for step in range(400):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if step and abs(1 - c * d) < 1e-14:
            break
    return front * (value - 1)


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation of ``n`` pairs."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


@pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """:func:`correlation_p` over columns; the input is one row per pair of columns."""
    return pd.Series([correlation_p(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n)], dtype="float64")
