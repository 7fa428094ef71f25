"""Calibration tables and drift of predictions by month, fold and walk-forward zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlab.operators.attach import attach, row_hash
from barlab.operators.folds import assign_folds
from barlab.operators.metrics import binary_metrics


def calibration_bin(p: Column, n_bins: int = 10) -> Column:
    """Equal-width bins on [0, 1], right-closed, with 0 in the first; null outside."""
    edges = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins + 1)])
    index = F.size(F.filter(edges, lambda e: e < p))
    return F.when((p >= 0) & (p <= 1), index)


def calibration_bins(
    df: DataFrame, keys: Sequence[str] = (), y: str = "actual", p: str = "predicted", n_bins: int = 10
) -> DataFrame:
    binned = df.withColumn("bin", calibration_bin(F.col(p), n_bins)).filter(F.col("bin").isNotNull())
    return binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_pred"), F.avg(y).alias("actual_rate")
    ).withColumn("abs_gap", F.abs(F.col("mean_pred") - F.col("actual_rate")))


def bin_label(n_bins: int = 10) -> Column:
    lo, hi = F.col("bin") / n_bins, (F.col("bin") + 1) / n_bins
    opening = F.when(F.col("bin") == 0, "[").otherwise("(")
    return F.concat(opening, F.format_string("%.2f, %.2f]", lo, hi))


def expected_calibration_error(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*keys).agg((F.sum(F.col("abs_gap") * F.col("count")) / F.sum("count")).alias("ece"))


def per_month_metrics(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "actual", p: str = "predicted"
) -> DataFrame:
    monthly = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    return binary_metrics(monthly, [*keys, "month"], y, p)


def fold_window_note(saved_train_end: Column, last_fold: Column) -> Column:
    """How a fold's test window relates to the training data of the saved (last) model."""
    return (
        F.when(F.col("test_end") <= saved_train_end, "inside_train")
        .when(F.col("fold") == last_fold, "last_fold")
        .otherwise("overlap")
    )


def per_fold_saved_vs_own(
    predictions: DataFrame, folds: DataFrame, own: DataFrame, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Metrics of the saved model in every fold's test window, beside the fold's own AUC.

    ``own`` holds keys, fold, own_auc. A small table of fold ends per key marks each window.
    """
    placed = assign_folds(predictions, folds, keys, ts, roles=("test",))
    saved = binary_metrics(placed, [*keys, "fold"]).select(
        *keys, "fold", "n", F.col("auc").alias("saved_auc")
    )
    ends = folds.groupBy(*keys).agg(
        F.max("fold").alias("_last"), F.max_by("train_end", "fold").alias("_saved_end")
    )
    base = folds.join(ends, list(keys)) if keys else folds.join(F.broadcast(ends))
    noted = base.withColumn("note", fold_window_note(F.col("_saved_end"), F.col("_last"))).select(
        *keys, "fold", "test_start", "test_end", "note"
    )
    return (
        noted.join(saved, [*keys, "fold"], "left").join(own, [*keys, "fold"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


def zones(predictions: DataFrame, folds: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Adds ``zone``: last_fold (its test window) or post (from its end on); other rows drop."""
    bounds = folds.groupBy(*keys).agg(
        F.max_by("test_start", "fold").alias("_lo"), F.max_by("test_end", "fold").alias("_hi")
    )
    joined = attach(predictions, bounds, keys, row_hash(predictions))
    zone = F.when(F.col(ts) >= F.col("_hi"), "post").when(F.col(ts) >= F.col("_lo"), "last_fold")
    return joined.withColumn("zone", zone).filter(F.col("zone").isNotNull()).drop("_lo", "_hi")


def post_window_metrics(
    predictions: DataFrame, folds: DataFrame, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    zoned = zones(predictions, folds, keys, ts)
    by = [*keys, "zone"]
    ece = expected_calibration_error(calibration_bins(zoned, by), by)
    return binary_metrics(zoned, by).join(ece, by, "left")
