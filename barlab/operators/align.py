"""From long feature rows to a complete feature matrix on a bar grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlab.schema import INTERVAL_CODES


def classify_features(registry: DataFrame, symbol: str, interval: str) -> DataFrame:
    """Adds ``scope``: per_bar, skip (per-bar, but not for this symbol and interval) or global."""
    per_bar = (F.coalesce(F.size("symbols"), F.lit(0)) > 0) & (F.coalesce(F.size("intervals"), F.lit(0)) > 0)
    here = F.array_contains("symbols", symbol) & F.array_contains("intervals", interval)
    return registry.withColumn(
        "scope", F.when(per_bar & here, "per_bar").when(per_bar, "skip").otherwise("global")
    )


def long_to_wide(long: DataFrame, names: Sequence[str], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """One column per feature, in the given order. A conditional max is a pivot with fixed columns."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("feature_name") == n, F.col("value"))).alias(n) for n in names])


def wide_to_long(wide: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), list(names), "feature_name", "value")


def align_exact(grid: DataFrame, wide: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    return grid.join(wide, list(keys), "left")


def feature_coverage(wide: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Non-null count and share of grid slots per column, one pass over the matrix."""
    counts = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_slots"), *[F.count(n).alias(n) for n in names]
    )
    return counts.unpivot([*keys, "n_slots"], list(names), "feature_name", "n_non_null").withColumn(
        "pct_non_null", F.round(F.col("n_non_null") / F.col("n_slots"), 4)
    )


def prune_all_null(coverage: DataFrame) -> DataFrame:
    return coverage.filter(F.col("n_non_null") > 0)


def drop_incomplete(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return wide.dropna(subset=list(names))


def drop_report(wide: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Slots, kept rows and dropped rows of :func:`drop_incomplete`."""
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    return wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_slots"), F.count_if(complete).alias("n_kept"), F.count_if(~complete).alias("n_dropped")
    )


def interval_indicator(interval: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in INTERVAL_CODES.items() for x in kv])
    return F.element_at(codes, interval)


def filter_serving_interval(df: DataFrame, interval: str) -> DataFrame:
    """Evaluation rows of the serving interval; unstacked data passes through."""
    if "interval_indicator" not in df.columns:
        return df
    return df.filter(F.col("interval_indicator") == INTERVAL_CODES[interval])


def stack_intervals(pieces: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of per-interval datasets with equal columns, tagged by interval code and piece order."""
    columns = pieces[0][1].columns
    stacked = None
    for order, (interval, piece) in enumerate(pieces):
        extra, missing = set(piece.columns) - set(columns), set(columns) - set(piece.columns)
        if extra or missing:
            raise ValueError(f"columns differ at {interval}: extra={sorted(extra)} missing={sorted(missing)}")
        tagged = piece.withColumn("interval_indicator", F.lit(INTERVAL_CODES[interval])).withColumn(
            "piece_order", F.lit(order)
        )
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked


def schema_difference(left: DataFrame, right: DataFrame, key: str = "feature_name") -> DataFrame:
    """Feature names on one side only, in one full join of the distinct names."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "extra").when(F.col("_r").isNull(), "missing")
    return a.join(b, key, "full").select(key, side.alias("side")).filter(F.col("side").isNotNull())


def sum_coverage(pieces: DataFrame) -> DataFrame:
    """Coverage of a stack from its pieces' coverage rows (feature_name, n_slots, n_non_null)."""
    return pieces.groupBy("feature_name").agg(
        F.sum("n_slots").alias("n_slots"), F.sum("n_non_null").alias("n_non_null")
    ).withColumn("pct_non_null", F.round(F.col("n_non_null") / F.col("n_slots"), 4))
