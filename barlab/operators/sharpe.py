"""Probabilistic and deflated Sharpe ratio of per-trade returns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlab.functions.stats import normal_cdf, normal_ppf

EULER_GAMMA = 0.5772156649015329
GATE = 0.95
_FLOOR = 1e-6


def sharpe_moments(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, mean, sample std, bias-corrected skewness and excess kurtosis."""
    n = F.count(x).cast("double")
    pop_skew, pop_kurt = F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, pop_skew * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(pop_skew)
    kurt = F.when(n > 3, ((n + 1) * pop_kurt + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(pop_kurt)
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        skew.alias("skew"), kurt.alias("excess_kurtosis"),
    )


def expected_max_sharpe(n_trials: int, variance: Column | float = 1.0) -> Column:
    """Expected best Sharpe of ``n_trials`` skill-less trials with the given variance."""
    if n_trials < 1:
        raise ValueError("n_trials must be at least 1")
    v = F.lit(variance) if isinstance(variance, (int, float)) else variance
    if n_trials == 1:
        return F.lit(0.0)
    unit = (1 - EULER_GAMMA) * normal_ppf(1 - 1 / n_trials) + EULER_GAMMA * normal_ppf(1 - 1 / (n_trials * math.e))
    return F.greatest(F.lit(0.0), F.sqrt(v) * unit)


def probabilistic_sharpe_z(sharpe: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Argument of the normal CDF in the probabilistic Sharpe ratio; null under two returns."""
    spread = 1.0 - skew * sharpe + (kurt + 2.0) / 4.0 * sharpe * sharpe
    return F.when(n >= 2, (sharpe - benchmark) * F.sqrt(n - 1.0) / F.sqrt(F.greatest(spread, F.lit(_FLOOR))))


def probabilistic_sharpe(sharpe: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    return normal_cdf(probabilistic_sharpe_z(sharpe, benchmark, n, skew, kurt))


def deflated_sharpe(
    df: DataFrame, keys: Sequence[str], x: str, n_trials: int = 1, variance: float = 1.0, gate: float = GATE
) -> DataFrame:
    """Deflated Sharpe per group. Constant returns short-cut to 1 (positive) or 0."""
    m = sharpe_moments(df, keys, x)
    flat = F.col("std") == 0
    star = F.when(flat, 0.0).otherwise(expected_max_sharpe(n_trials, variance))
    sharpe = F.when(~flat, F.col("mean") / F.col("std"))
    value = F.when(flat, (F.col("mean") > 0).cast("double")).otherwise(
        probabilistic_sharpe(F.col("sharpe"), F.col("sharpe_star"), F.col("n").cast("double"), F.col("skew"),
                             F.col("excess_kurtosis"))
    )
    two = F.col("n") >= 2
    return (
        m.withColumn("sharpe", F.when(two, sharpe)).withColumn("sharpe_star", F.when(two, star))
        .withColumn("dsr", F.when(two, value))
        .withColumn("discount_active", F.lit(float(n_trials > 1 and variance > 0)))
        .withColumn("gate_pass", (F.col("dsr") > gate).cast("double"))
        .select(*keys, "n", "sharpe", "sharpe_star", F.when(two & flat, 0.0).otherwise(F.col("skew")).alias("skew"),
                F.when(two & flat, 0.0).otherwise(F.col("excess_kurtosis")).alias("excess_kurtosis"), "dsr",
                "discount_active", "gate_pass")
    )
