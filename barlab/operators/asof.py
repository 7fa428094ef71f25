"""As-of alignment of irregular series onto a regular grid.

1. A source row can only matter from the first grid slot at or after it, and only the newest row per
   slot survives; one partial aggregation per (key, slot) therefore bounds the data by the grid size.
2. Forward fill runs inside time blocks; the last value of each block is carried forward through a
   table with one row per block. No window spans a whole series and no non-equi join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.times import from_micros, micros

BLOCK_SLOTS = 4096


def _slot(ts: str, step_us: int, origin_us: Column) -> Column:
    gap = micros(ts) - origin_us
    return from_micros(origin_us + gap + F.pmod(-gap, F.lit(step_us)))


def fill_forward(
    df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], block_us: int
) -> DataFrame:
    """Last non-null value of each column at or before ``ts``; columns are ``(ts, value)`` structs."""
    part = [*keys, "_block"]
    rows = df.withColumn("_block", F.floor(micros(ts) / block_us))
    local = Window.partitionBy(*part).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*part).agg(*[F.max(c).alias(c) for c in columns])
        .select(*part, *[F.last(c, ignorenulls=True).over(before).alias(f"_c_{c}") for c in columns])
    )
    filled = rows
    for c in columns:
        filled = filled.withColumn(c, F.last(c, ignorenulls=True).over(local))
    joined = filled.join(carried, part)
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(c, f"_c_{c}"))
    return joined.drop("_block", *[f"_c_{c}" for c in columns])


def asof_wide(
    grid: DataFrame,
    series: DataFrame,
    caps: Mapping[str, float | None],
    step_seconds: int,
    origin: Column,
    keys: Sequence[str] = (),
    ts: str = "ts",
    exact: Sequence[str] = (),
    with_source: bool = False,
) -> DataFrame:
    """Grid rows with one column per feature: the newest value no older than the feature's cap.

    ``caps`` maps feature name to hours (None or 0: no limit) and fixes the column order; ``exact``
    lists features whose policy allows only a value stamped on the slot itself. ``series`` has
    ``keys``, ``feature_name``, ``ts``, ``value``. ``with_source`` adds ``<name>_src_ts``.
    """
    names = list(caps)
    step_us = step_seconds * 1_000_000
    origin_us = micros(origin)
    pair = F.struct(F.col(ts).alias("ts"), F.col("value").alias("value"))
    newest = (
        series.filter(F.col("feature_name").isin(names) & F.col("value").isNotNull())
        .groupBy(*keys, "feature_name", _slot(ts, step_us, origin_us).alias("_slot"))
        .agg(F.max(F.col(ts)).alias("ts"), F.max_by("value", micros(ts)).alias("value"))
        .groupBy(*keys, F.col("_slot").alias(ts))
        .agg(*[F.max(F.when(F.col("feature_name") == n, pair)).alias(n) for n in names])
    )
    base = grid.select(*keys, ts).withColumn("_grid", F.lit(True))
    merged = base.join(newest, [*keys, ts], "full")
    filled = fill_forward(merged, keys, ts, names, BLOCK_SLOTS * step_us).filter("_grid")
    out = [F.col(k) for k in keys] + [F.col(ts)]
    for n in names:
        age = micros(F.col(ts)) - micros(F.col(f"{n}.ts"))
        keep = (
            age == 0 if n in exact
            else (age <= int(caps[n] * 3_600_000_000) if caps[n] else F.lit(True))
        )
        out.append(F.when(keep, F.col(f"{n}.value")).alias(n))
        if with_source:
            out.append(F.when(keep, F.col(f"{n}.ts")).alias(f"{n}_src_ts"))
    return filled.select(*out)
