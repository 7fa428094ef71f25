"""Order statistics over groups of any size: prefix sums, exact quantiles, rank AUC, rank bins.

A group is first reduced to its distinct values (map-side combine), then cut into value ranges. The
cut points come from a slot sample of a hash-selected subset of the distinct values (``sketch``), so
they are the same on every re-run, balance the ranges however the values cluster and rest on at most
``SLOTS`` values of a group; results never depend on them. Each range
is scanned on its own and ranges are chained through a table of at most ``RANGES`` rows per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.operators.attach import attach
from barlab.operators.sketch import KLL_K, quantile_sketch, sketch_quantiles, slot_sample

RANGES = 128
_PICK = 4096
_STEP = 12


def _with_range(distinct: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    picked = slot_sample(distinct.filter(F.pmod(F.xxhash64(value), F.lit(_PICK)) == 0), keys, [value])
    cuts = picked.groupBy(*keys).agg(F.array_distinct(F.percentile(value, probs)).alias("_cuts"))
    cuts = cuts.withColumn("_heads", F.filter("_cuts", lambda c, i: i % _STEP == _STEP - 1))
    joined = attach(distinct, cuts, keys, F.col(value), "left")
    below = lambda array: F.size(F.filter(array, lambda c: c < F.col(value)))
    base = below("_heads") * _STEP
    index = base + below(F.slice("_cuts", base + 1, F.lit(_STEP)))
    return joined.withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(index)).drop("_cuts", "_heads")


def prefix_sums(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column]
) -> DataFrame:
    """One row per (keys, value): each sum, its total over smaller values, and its group total.

    For a sum ``s`` the columns are ``s``, ``s_before`` and ``s_total``.
    """
    part = [*keys, "_range"]
    distinct = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ranged = _with_range(distinct, keys, value)
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*part).agg(*[F.sum(n).alias(n) for n in sums]).select(
        *part,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(n).over(group).alias(f"{n}_total") for n in sums],
    )
    smaller = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    scanned = ranged
    for n in sums:
        scanned = scanned.withColumn(f"{n}_before", F.coalesce(F.sum(n).over(smaller), F.lit(0)))
    joined = scanned.join(offsets, part)  # ranges already split a large group
    for n in sums:
        joined = joined.withColumn(f"{n}_before", F.col(f"{n}_before") + F.col(f"_o_{n}"))
    return joined.drop("_range", *[f"_o_{n}" for n in sums])


def score_ranges(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column, weight: Column | None = None,
    extras: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per (keys, range): positives ``_pos``, negatives ``_neg`` and ``_u``, the number of
    (positive, smaller negative) pairs with ties counted half, over the whole group.

    ``extras`` are additive expressions over the distinct score and its ``_pos`` and ``_neg`` counts.
    """
    w = F.lit(1) if weight is None else weight
    part = [*keys, "_range"]
    extras = extras or {}
    distinct = df.filter(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.when(positive, w).otherwise(F.lit(0))).alias("_pos"),
        F.sum(F.when(positive, F.lit(0)).otherwise(w)).alias("_neg"),
    )
    smaller = Window.partitionBy(*part).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(smaller), F.lit(0))
    ranges = (
        _with_range(distinct, keys, score)
        .withColumn("_u", F.col("_pos") * (below + F.col("_neg") / 2.0))
        .groupBy(*part)
        .agg(*[F.sum(c).alias(c) for c in ("_u", "_pos", "_neg")], *[F.sum(e).alias(n) for n, e in extras.items()])
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_neg").over(earlier), F.lit(0))
    return ranges.withColumn("_u", F.col("_u") + F.col("_pos") * ahead)


def auc(
    df: DataFrame, keys: Sequence[str], score: str, positive: Column, weight: Column | None = None,
    out: str = "auc",
) -> DataFrame:
    """Tie-aware rank AUC per group; null unless both classes occur. Integer weights count as copies."""
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return score_ranges(df, keys, score, positive, weight).groupBy(*keys).agg(
        F.when(pairs > 0, F.sum("_u") / pairs).alias(out)
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles"
) -> DataFrame:
    """Exact quantiles with linear interpolation, one array per group."""
    scanned = prefix_sums(df.filter(F.col(value).isNotNull()), keys, value, {"n": F.lit(1)})
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    h = F.col("t.p") * (F.col("n_total") - 1)
    lo, hi = F.floor(h), F.ceil(h)
    holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    ends = (
        scanned.withColumn("t", F.explode(targets))
        .filter(holds(lo) | holds(hi))
        .groupBy(*keys, F.col("t.i").alias("_i"))
        .agg(
            F.max(F.when(holds(lo), F.col(value))).alias("_lo"),
            F.max(F.when(holds(hi), F.col(value))).alias("_hi"),
            F.max(h - lo).alias("_f"),
        )
    )
    point = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_i"), point.alias("q"))))
    return ends.groupBy(*keys).agg(F.transform(ordered, lambda s: s["q"]).alias(out))


def approx_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles", k: int = KLL_K
) -> DataFrame:
    """Quantiles from one mergeable sketch per group, within ``sketch.rank_error(k)``; a single pass with one small shuffle.

    Each result is a value that occurred, without interpolation. Use ``quantiles`` where the exact ones are needed.
    """
    sketched = quantile_sketch(df, keys, value, k, "_sketch")
    return sketched.select(*keys, sketch_quantiles(F.col("_sketch"), probs).alias(out))
