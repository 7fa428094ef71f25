"""OHLCV bars from raw ticks, and regular bar grids."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlab.functions.times import floor_to, from_micros, micros, seconds_of
from barlab.schema import INTERVAL_SECONDS


def tick_order(ts: Column, tiebreak: Column) -> Column:
    """One decimal that sorts by time, then id.

    A decimal buffer keeps open/close in a hash aggregate with partial aggregation; a struct
    ordering would force a sort of the raw ticks.
    """
    wide = "decimal(19,0)"
    return (micros(ts).cast(wide) * F.lit(10**18).cast(wide)).cast("decimal(38,0)") + tiebreak.cast(wide)


def build_bars(
    ticks: DataFrame,
    interval: str,
    symbol: Column,
    ts: Column,
    price: Column,
    order: Column,
    taker: Column | None = None,
) -> DataFrame:
    """One row per (symbol, bar start). ``order`` ranks ticks inside a bar for open and close."""
    width = INTERVAL_SECONDS[interval]
    taker = F.lit(True) if taker is None else taker
    return (
        ticks.select(
            symbol.alias("symbol"), floor_to(ts, width).alias("start_time"),
            price.cast("double").alias("_p"), order.alias("_o"), taker.alias("_t"),
        )
        .groupBy("symbol", "start_time")
        .agg(
            F.min_by("_p", "_o").alias("open_price"),
            F.max("_p").alias("high_price"),
            F.min("_p").alias("low_price"),
            F.max_by("_p", "_o").alias("close_price"),
            F.sum("_p").alias("volume"),
            F.sum(F.when(F.col("_t"), F.col("_p")).otherwise(F.lit(0.0))).alias("taker_buy_base_volume"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .withColumn("interval", F.lit(interval))
    )


def bar_grid(spark: SparkSession, start: datetime, end: datetime, interval: str) -> DataFrame:
    """Half-open regular grid ``[start, end)`` of bar starts, generated in parallel."""
    step = seconds_of(interval)
    n = max(0, -(-int((end - start).total_seconds()) // step))
    base = micros(F.lit(start).cast("timestamp_ntz"))
    return spark.range(n).select(from_micros(base + F.col("id") * step * 1_000_000).alias("ts"))


def grid_between(bounds: DataFrame, interval: str, start: str = "start", end: str = "end") -> DataFrame:
    """Half-open grid per row of ``bounds``; other columns are kept as keys.

    Two explodes (days, then slots of a day) keep any single array small.
    """
    step = seconds_of(interval) * 1_000_000
    block = 1024 * step
    lo, hi = micros(start), micros(end)
    keys = [c for c in bounds.columns if c not in (start, end)]
    blocks = (
        bounds.filter(hi > lo)
        .select(*keys, lo.alias("_lo"), hi.alias("_hi"))
        .select(*keys, "_hi", F.explode(F.sequence("_lo", F.col("_hi") - 1, F.lit(block))).alias("_b"))
    )
    last = F.least(F.col("_b") + block, F.col("_hi")) - 1
    slots = blocks.select(*keys, F.explode(F.sequence(F.col("_b"), last, F.lit(step))).alias("_us"))
    return slots.select(*keys, from_micros(F.col("_us")).alias("ts"))
