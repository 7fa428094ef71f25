"""Conditional invariance: how the label's mean given a feature bin moves from train to test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlab.operators.attach import attach
from barlab.operators.ranks import quantiles

PASS_THRESHOLD = {"binary": 0.15, "regression": 0.5, "multiclass": 0.15}
N_BINS = 5
MIN_BIN_ROWS = 20


def quantile_bin(x: Column, cuts: Column) -> Column:
    """A value equal to a cut belongs to the bin above it; equal cuts collapse."""
    return F.size(F.filter(F.array_distinct(cuts), lambda c: c <= x))


def bin_shifts(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], objective: str, y: str = "y",
    role: str = "role", n_bins: int = N_BINS, min_rows: int = MIN_BIN_ROWS,
) -> DataFrame:
    """One row per (key, feature, bin) with enough rows on both sides: sizes and ``diff``.

    Cut points are exact train quantiles; features with fewer than ``n_bins * min_rows`` train values
    are left out.
    """
    if objective not in PASS_THRESHOLD:
        raise ValueError(f"unknown objective {objective!r}")
    if n_bins < 2 or min_rows < 1:
        raise ValueError("need n_bins >= 2 and min_rows >= 1")
    long = rows.select(*keys, role, F.col(y).cast("double").alias("_y"), *[F.col(f).cast("double") for f in features])
    long = long.unpivot([*keys, role, "_y"], list(features), "feature", "x").filter(F.col("x").isNotNull())
    by = [*keys, "feature"]
    train = long.filter(F.col(role) == "train")
    cuts = quantiles(train, by, "x", [i / n_bins for i in range(1, n_bins)], "_cuts")
    big = train.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n_bins * min_rows).drop("_n")
    binned = attach(long, cuts.join(big, by), by, F.col("x")).withColumn("bin", quantile_bin(F.col("x"), F.col("_cuts")))
    side = lambda r, c: F.when(F.col(role) == r, c)
    sizes = [F.count(side(r, F.lit(1))).alias(f"n_{r}") for r in ("train", "test")]
    enough = (F.col("n_train") >= min_rows) & (F.col("n_test") >= min_rows)
    if objective == "multiclass":
        cell = binned.groupBy(*by, "bin", "_y").agg(*sizes)
        total = cell.groupBy(*by, "bin").agg(F.sum("n_train").alias("_tr"), F.sum("n_test").alias("_te"))
        gap = F.abs(F.col("n_train") / F.col("_tr") - F.col("n_test") / F.col("_te"))
        return (
            cell.join(total, [*by, "bin"])
            .filter((F.col("_tr") >= min_rows) & (F.col("_te") >= min_rows))
            .groupBy(*by, "bin")
            .agg(F.max("_tr").alias("n_train"), F.max("_te").alias("n_test"), F.max(gap).alias("diff"))
        )
    means = [F.avg(side(r, F.col("_y"))).alias(f"_m_{r}") for r in ("train", "test")]
    out = binned.groupBy(*by, "bin").agg(*sizes, *means).filter(enough)
    diff = F.abs(F.col("_m_train") - F.col("_m_test"))
    if objective == "regression":
        spread = rows.filter(F.col(role) == "train").groupBy(*keys).agg(F.stddev_pop(y).alias("_sd"))
        out = out.join(spread, list(keys)) if keys else out.join(F.broadcast(spread))
        out = out.filter(F.col("_sd") > 0)
        diff = diff / F.col("_sd")
    return out.select(*by, "bin", "n_train", "n_test", diff.alias("diff"))


def summarize(shifts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return shifts.groupBy(*keys).agg(
        F.max("diff").alias("ci_max_abs_diff"), F.avg("diff").alias("ci_mean_abs_diff"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def per_feature_max(shifts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst shift of each feature; features whose every bin agrees exactly are not listed."""
    return shifts.groupBy(*keys, "feature").agg(F.max("diff").alias("max_diff")).filter(F.col("max_diff") > 0)


def conditional_invariance(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], objective: str, y: str = "y", role: str = "role",
    n_bins: int = N_BINS, min_rows: int = MIN_BIN_ROWS,
) -> DataFrame:
    """Summary per key with the reason when nothing could be compared, and the pass flag."""
    shifts = summarize(bin_shifts(rows, keys, features, objective, y, role, n_bins, min_rows), keys)
    sides = rows.groupBy(*keys).agg(
        F.count_if(F.col(role) == "train").alias("_tr"), F.count_if(F.col(role) == "test").alias("_te"),
        F.stddev_pop(F.when(F.col(role) == "train", F.col(y))).alias("_sd"),
    )
    joined = sides.join(shifts, list(keys), "left") if keys else sides.join(F.broadcast(shifts))
    reason = F.when((F.col("_tr") == 0) | (F.col("_te") == 0), "empty_train_or_test")
    if objective == "regression":
        reason = reason.when(F.col("_sd") == 0, "degenerate_train_label")
    reason = reason.when(F.coalesce("n_pairs", F.lit(0)) == 0, "no_eligible_bins")
    return joined.select(
        *keys, "ci_max_abs_diff", "ci_mean_abs_diff", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
        reason.alias("skipped_reason"),
        F.coalesce((F.col("ci_max_abs_diff") < PASS_THRESHOLD[objective]) & reason.isNull(), F.lit(False)).alias("passes"),
    )
