"""Embargoed walk-forward folds, row-to-fold expansion and per-fold guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.times import from_micros, micros
from barlab.operators.attach import attach, row_hash

TRAIN_DAYS, TEST_DAYS, EMBARGO_DAYS, N_FOLDS = 365, 21, 7, 6
_DAY = 86_400_000_000


def generate_folds(
    windows: DataFrame,
    train_days: int = TRAIN_DAYS,
    test_days: int = TEST_DAYS,
    embargo_days: int = EMBARGO_DAYS,
    n_folds: int = N_FOLDS,
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Fold boundaries for each row of ``windows``; its other columns are kept as keys.

    Test windows follow each other without overlap; a fold whose test window would end past ``end``
    is not produced.
    """
    if train_days <= 0 or test_days <= 0 or embargo_days < 0 or n_folds <= 0:
        raise ValueError("fold sizes must be positive (embargo may be 0)")
    keys = [c for c in windows.columns if c not in (start, end)]
    first = micros(start) + (train_days + embargo_days) * _DAY
    lo = F.col("_first") + F.col("fold").cast("long") * (test_days * _DAY)
    cut = lo - embargo_days * _DAY
    return (
        windows.select(*keys, first.alias("_first"), micros(end).alias("_end"))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        .filter(lo + test_days * _DAY <= F.col("_end"))
        .select(
            *keys, "fold",
            from_micros(cut - train_days * _DAY).alias("train_start"), from_micros(cut).alias("train_end"),
            from_micros(lo).alias("test_start"), from_micros(lo + test_days * _DAY).alias("test_end"),
        )
    )


def last_n_folds(folds: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Most recent ``n`` folds per key; fold numbers are kept."""
    if n <= 0:
        raise ValueError("n must be positive")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fold")))
    return folds.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def assign_folds(
    rows: DataFrame,
    folds: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    roles: Sequence[str] = ("train", "test"),
) -> DataFrame:
    """(row, fold, role) for every fold window holding the row's timestamp.

    Folds travel as one array per key (one entry per fold and role), so rows expand only into the
    windows that match; there is no row-by-fold product. The rows of a key are dealt over many tasks (``attach``); without keys the
    fold table is one row by construction and is broadcast.
    """
    bound = lambda role: F.struct(
        F.col("fold"), F.lit(role).alias("role"),
        F.col(f"{role}_start").alias("lo"), F.col(f"{role}_end").alias("hi"),
    )
    spans = folds.select(*keys, F.explode(F.array(*[bound(r) for r in roles])).alias("_w"))
    per_key = spans.groupBy(*keys).agg(F.array_sort(F.collect_list("_w")).alias("_windows"))
    joined = attach(rows, per_key, keys, row_hash(rows))
    inside = lambda w: (w["lo"] <= F.col(ts)) & (F.col(ts) < w["hi"])
    return (
        joined.withColumn("_w", F.explode(F.filter("_windows", inside)))
        .withColumn("fold", F.col("_w.fold")).withColumn("role", F.col("_w.role"))
        .drop("_w", "_windows")
    )


def day_cells(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column], ts: str = "ts") -> DataFrame:
    """Additive statistics per day. Fold windows start at midnight and overlap heavily, so cells are
    combined per fold instead of copying rows into every fold."""
    return rows.groupBy(*keys, F.date_trunc("day", ts).cast("timestamp_ntz").alias(ts)).agg(*aggs)


def class_guard(
    rows: DataFrame, folds: DataFrame, objective: str, keys: Sequence[str] = (), ts: str = "ts", y: str = "y",
    n_classes: int = 3,
) -> DataFrame:
    """Rows and classes per fold side, and the reason a fold cannot be fitted (null: it can)."""
    cells = day_cells(rows, [*keys, y], [F.count(F.lit(1)).alias("_n")], ts)
    placed = assign_folds(cells, folds, keys, ts)
    side = lambda role, agg, c: agg(F.when(F.col("role") == role, c))
    counts = placed.groupBy(*keys, "fold").agg(
        side("train", F.sum, F.col("_n")).alias("n_train"), side("test", F.sum, F.col("_n")).alias("n_test"),
        side("train", F.count_distinct, F.col(y)).alias("train_classes"),
        side("test", F.count_distinct, F.col(y)).alias("test_classes"),
    )
    full = folds.select(*keys, "fold").join(counts, [*keys, "fold"], "left").fillna(
        0, ["n_train", "n_test", "train_classes", "test_classes"]
    )
    reason = F.when(F.col("n_train") == 0, "empty_train_window").when(F.col("n_test") == 0, "empty_test_window")
    if objective in ("binary", "multiclass"):
        need, why = (2, "single_class_train_set") if objective == "binary" else (
            n_classes, "insufficient_classes_in_train_set")
        reason = reason.when(F.col("train_classes") < need, why).when(
            F.col("test_classes") < 2, "single_class_test_set")
    return full.withColumn("skipped_reason", reason)


def fold_aggregate(
    metrics: DataFrame, primary: str, keys: Sequence[str] = ("run_id",), fold: str = "fold"
) -> DataFrame:
    """Mean, median, population std, trend slope and best fold of the primary metric over valid folds.

    ``metrics`` is long: keys, fold, metric, value. Folds per run are few, so the grouped lists stay
    small.
    """
    valid = metrics.filter((F.col("metric") == primary) & F.col("value").isNotNull() & ~F.isnan("value"))
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(fold)) - 1
    ranked = valid.withColumn("_pos", position.cast("double"))
    n = F.count(F.lit(1))
    return ranked.groupBy(*keys).agg(
        n.alias("n_folds_valid"),
        F.avg("value").alias("primary_mean"),
        F.percentile("value", F.lit(0.5)).alias("primary_median"),
        F.stddev_pop("value").alias("primary_std"),
        F.when(n >= 2, F.regr_slope(F.col("value"), F.col("_pos"))).alias("trend_slope"),
        F.max_by(fold, F.struct("value", -F.col(fold))).alias("best_fold"),
        F.max("value").alias("best_value"),
        F.max_by("value", fold).alias("last_value"),
    )


def metric_means(metrics: DataFrame, primary: str, keys: Sequence[str] = ("run_id",), fold: str = "fold") -> DataFrame:
    """Mean of the finite values of every metric over folds whose primary metric is finite."""
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    valid = metrics.filter((F.col("metric") == primary) & finite).select(*keys, fold).distinct()
    kept = metrics.join(valid, [*keys, fold], "left_semi")
    return kept.groupBy(*keys, "metric").agg(
        F.avg(F.when(finite, F.col("value"))).alias("mean_value"), F.count_if(finite).alias("n_folds")
    )
