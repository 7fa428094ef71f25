"""Distribution functions for already-aggregated rows (a few per fold or group)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(_NORMAL.cdf, na_action="ignore")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_t_lower(t: float, df: float) -> float:
    """P(T <= t)."""
    tail = 0.5 * _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return tail if t <= 0 else 1.0 - tail


@F.pandas_udf(DoubleType())
def student_t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(a) or pd.isna(b) else student_t_lower(a, b) for a, b in zip(t, df)
    ], dtype="float64")


def digamma(n):
    """The digamma function of a positive count: shifted up by six, then the asymptotic series (error below 1e-11)."""
    z = n.cast("double") + 6
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    for j in range(6):
        series = series - 1 / (n.cast("double") + j)
    return series
