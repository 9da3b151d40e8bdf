"""Tails of Student's t and of the binomial, which Spark has no function for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, value, up, down = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        down = 1 / (1 + term * down or tiny)
        up = 1 + term / up or tiny
        value *= up * down
        if abs(1 - up * down) < 1e-14:
            break
    return front * (value - 1)


def student_t_upper(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def binomial_upper(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) of n trials; 1 for k = 0."""
    return 1.0 if k <= 0 else incomplete_beta(k, n - k + 1, p)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """One-sided p-values of a column of t statistics; NULL stays NULL."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else student_t_upper(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def binomial_pvalue(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else binomial_upper(int(a), int(b)) for a, b in zip(k, n)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """a / b by floating-point rules: over zero it is endless, zero over zero no number."""
    over_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def uniform(*key: Column | str) -> Column:
    """A number from 0 to 1 that depends on the key only, in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 12), 16, 10).cast("double") / float(2**48)
