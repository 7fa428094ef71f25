"""Timestamp arithmetic on TIMESTAMP_NTZ columns (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barlab.schema import GRID_INTERVALS, INTERVAL_SECONDS


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def ntz(ts: Column | str) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def to_naive_utc(ts: Column, zone: str | Column) -> Column:
    """Wall-clock time of ``zone`` as naive UTC."""
    return F.to_utc_timestamp(ts, zone).cast("timestamp_ntz")


def seconds_of(interval: str, allowed: tuple[str, ...] = GRID_INTERVALS) -> int:
    if interval not in allowed:
        raise ValueError(f"unsupported interval {interval!r}; known: {', '.join(allowed)}")
    return INTERVAL_SECONDS[interval]


def floor_to(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned slot holding ``ts``."""
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(seconds * 1_000_000)))


def default_cap_hours(interval: str) -> int:
    """Age cap of a coarse bar feature without its own: whole hours of one bar, at least one."""
    return max(1, seconds_of(interval) // 3600)
