"""Tails of the t and F distributions, by the continued fraction of the incomplete beta function, in batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's method."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper p-value of F."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f >= 0 else 1.0


def _each(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns)], dtype="float64").replace({np.nan: None}).astype("float64")


def t_two_sided(t: Column, df: Column) -> Column:
    return F.pandas_udf(lambda a, b: _each(t_tail, a, b), "double", functionType=F.PandasUDFType.SCALAR)(t, df)


def f_upper_tail(f: Column, d1: Column, d2: Column) -> Column:
    return F.pandas_udf(lambda a, b, c: _each(f_tail, a, b, c), "double", functionType=F.PandasUDFType.SCALAR)(f, d1, d2)
