"""Chronological splits as row-position bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlab.functions.times import seconds_of
from barlab.operators.frames import number_rows

META_FRACTION = 0.2
EARLY_STOP_EMBARGO_DAYS = 7


def _positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return number_rows(df, keys, order, "_rn", "_total")


def slice_by_time(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def split_chronological(
    df: DataFrame, val_fraction: float, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)
) -> DataFrame:
    """``role``: the last ``max(1, round(n * val_fraction))`` rows are ``val``."""
    if not 0.0 < val_fraction < 0.5:
        raise ValueError(f"val_fraction must lie in (0, 0.5), got {val_fraction}")
    n_val = F.greatest(F.lit(1), F.bround(F.col("_total") * val_fraction).cast("long"))
    role = F.when(F.col("_rn") >= F.col("_total") - n_val, "val").otherwise("train")
    return _positions(df, keys, order).withColumn("role", role).drop("_rn", "_total")


def early_stopping_carve(
    df: DataFrame, val_fraction: float, interval: str, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)
) -> DataFrame:
    """``role``: inner / embargo / es_val bands, or null where a guard disables the carve."""
    gap = max(1, round(EARLY_STOP_EMBARGO_DAYS * 86400 / seconds_of(interval)))
    size = F.bround(F.col("_total") * val_fraction).cast("long")
    inner_end = F.col("_total") - size - gap
    role = F.when((size >= 10) & (inner_end > 0), F.when(F.col("_rn") < inner_end, "inner").when(
        F.col("_rn") < F.col("_total") - size, "embargo").otherwise("es_val"))
    return _positions(df, keys, order).withColumn("role", role).drop("_rn", "_total")


def meta_split(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """The last ``max(1, round(n * 0.2))`` rows fit the meta model, the earlier ones the primary."""
    n_meta = F.greatest(F.lit(1), F.bround(F.col("_total") * META_FRACTION).cast("long"))
    role = F.when(F.col("_rn") < F.col("_total") - n_meta, "primary").otherwise("meta")
    return _positions(df, keys, order).withColumn("role", role).drop("_rn", "_total")


def stride_sample(df: DataFrame, n_max: int, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Every k-th row with k = n // n_max, at most ``n_max`` rows per key (a sampling operator)."""
    k = F.greatest(F.lit(1), F.floor(F.col("_total") / n_max))
    pick = (F.col("_rn") % k == 0) & (F.col("_rn") / k < n_max)
    return _positions(df, keys, order).filter((F.col("_total") <= n_max) | pick).drop("_rn", "_total")


def halves(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    half = F.when(F.col("_rn") < F.floor(F.col("_total") / 2), 1).otherwise(2)
    return _positions(df, keys, order).withColumn("half", half)


def encode_multiclass(y: Column) -> Column:
    """-1/0/1 -> 0/1/2; anything else (null and NaN included) fails the query."""
    bad = F.raise_error(F.concat(F.lit("unknown class label "), F.coalesce(y.cast("string"), F.lit("null"))))
    return F.when(y == -1, 0).when(y == 0, 1).when(y == 1, 2).otherwise(bad.cast("int"))


def decode_multiclass(code: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("unknown class code "), F.coalesce(code.cast("string"), F.lit("null"))))
    return F.when(code.isin(0, 1, 2), code.cast("int") - 1).otherwise(bad.cast("int"))
