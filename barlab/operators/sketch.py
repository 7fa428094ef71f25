"""Mergeable summaries of a distribution.

Two kinds. A KLL sketch (Spark's own, partial aggregation, merged by ``merge_sketches``) answers quantiles and ranks within a stated
error and can be stored; it is random, so two evaluations may differ within that error. A slot sample is a function of the set of
values alone, whatever the order, the partitions and the retries; it places cut points on which exact results are built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

KLL_K = 400
SLOTS = 1024


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a KLL sketch with parameter ``k`` at 99 % confidence (published fit for single quantiles)."""
    return 2.296 / k ** 0.9723


def quantile_sketch(df: DataFrame, keys: Sequence[str], value: str, k: int = KLL_K, out: str = "sketch") -> DataFrame:
    """One KLL sketch of the non-null ``value`` per group. Map tasks build sketches of a few kilobytes, only those are shuffled."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias(out))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = KLL_K, sketch: str = "sketch") -> DataFrame:
    """Sketches of coarser groups from those of finer ones, of stored parts or of earlier runs."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double(sketch, F.lit(k)).alias(sketch))


def sketch_quantiles(sketch: Column, probs: Sequence[float]) -> Column:
    """The array of quantiles at ``probs``; each is a value that occurred."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in probs]))


def sketch_rank(sketch: Column, value: Column) -> Column:
    """The share of values up to ``value``."""
    return F.kll_sketch_get_rank_double(sketch, value.cast("double"))


def slot_sample(df: DataFrame, keys: Sequence[str], values: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Up to ``slots`` of the distinct ``values`` of each group: in every hash slot the one with the smallest hash.

    A uniform sample of the distinct values with a standard rank error of at most 1 / (2 sqrt(slots)) among them. Minima merge in
    any order, so the sample is the same on every evaluation and a task holds at most ``slots`` rows of a group. ``_seen``
    counts a slot's rows.
    """
    h = F.xxhash64(*values, F.lit("slot"))
    return df.groupBy(*keys, F.pmod(h, F.lit(slots)).alias("_slot")).agg(
        *[F.min_by(v, h).alias(v) for v in values], F.count(F.lit(1)).alias("_seen")).drop("_slot")
