"""Tail probabilities in plain Python, and pandas UDFs over them."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def binomial_two_sided(k: int, n: int) -> float:
    """Sign test at one half."""
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


def _t_values(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def t_p_value(t: Column, df: Column) -> Column:
    return F.pandas_udf(_t_values, "double")(t, df)


def normal_cdf(z: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(NormalDist().cdf, na_action="ignore")

    return F.pandas_udf(run, "double")(z)


def normal_quantile(p: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: NormalDist().inv_cdf(x) if 0 < x < 1 else None, na_action="ignore")

    return F.pandas_udf(run, "double")(p)
