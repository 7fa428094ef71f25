"""Mutual information of a continuous feature with a class, from nearest neighbours, over every row.

The one-dimensional estimator of the literature: with r the distance from a row to the k-th nearest row of its own class and m the
rows of all classes nearer than r, the information is psi(N) + <psi(k)> - <psi(class size)> - <psi(m)>. Rows
with equal value and class are one cell with a count. Neighbours come from sorted chunks with a halo of k cells, m from prefix
counts at both ends of the interval, so no task sees a whole feature and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barlab.functions.stats import digamma
from barlab.operators.frames import over_chunks
from barlab.operators.ranks import prefix_sums
from barlab.session import cut_lineage

NEIGHBOURS = 3


def _near(k: int, spec: WindowSpec) -> Column:
    """The (distance, rows) of the up to 2k cells around a row's own, nearest first."""
    sides = []
    for j in range(1, k + 1):
        for cell, sign in ((F.lag, 1), (F.lead, -1)):
            sides.append(F.struct((sign * (F.col("_x") - cell("_x", j).over(spec))).alias("d"), cell("_c", j).over(spec).alias("_c")))
    return F.sort_array(F.filter(F.array(*sides), lambda s: s["d"].isNotNull()))


def class_radius(cells: DataFrame, by: Sequence[str], k: int = NEIGHBOURS, chunk_rows: int | None = None) -> DataFrame:
    """``cells`` (by, _y, _x, _c) with ``_k``, the neighbours used (fewer in a class of fewer rows), and ``_r``, the distance to the last."""
    rows = over_chunks(cells, [*by, "_y"], ["_x"], k, k, lambda df, spec: df.withColumn("_near", _near(k, spec)), chunk_rows)
    others = F.aggregate("_near", F.col("_c") - 1, lambda a, s: a + s["_c"])
    rows = rows.withColumn("_k", F.least(F.lit(k).cast("long"), others)).filter("_k > 0")
    start = F.struct((F.col("_k") - (F.col("_c") - 1)).alias("left"), F.lit(0.0).alias("_r"))
    walk = F.aggregate("_near", start, lambda a, s: F.when(a["left"] <= 0, a).otherwise(F.struct((a["left"] - s["_c"]).alias("left"), s["d"].alias("_r"))))
    return rows.withColumn("_r", walk["_r"]).drop("_near")


def neighbour_information(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), y: str = "y", k: int = NEIGHBOURS, chunk_rows: int | None = None
) -> DataFrame:
    """(keys, feature, mi, score): the information in nats, not below 0, and its share of the class entropy.

    Rows without a class or a value do not count, nor does a class of a single row. Ties are equal distances: a row counts as nearer
    than r if its value lies strictly between value - r and value + r; where r is 0 the rows of the same value count. A
    feature without two rows of one class is left out.
    """
    by = [*keys, "feature"]
    long = df.filter(F.col(y).isNotNull()).select(*keys, F.col(y).alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [*keys, "_y"], list(features), "feature", "_x").filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    cells = long.groupBy(*by, "_y", "_x").agg(F.count(F.lit(1)).alias("_c"))
    near = cut_lineage(class_radius(cells, by, k, chunk_rows))  # read for the interval ends and for their counts
    sides = F.array(*[F.struct(F.lit(side).alias("side"), (F.col("_x") + side * F.col("_r")).alias("v")) for side in (-1, 1)])
    ends = near.withColumn("_end", F.explode(sides)).select(*by, "_y", "_x", "_c", "_k", "_r", F.col("_end.side").alias("_side"), F.col("_end.v").alias("_v"))
    points = cells.select(*by, F.col("_x").alias("_v"), F.col("_c").alias("_n")).unionByName(ends.select(*by, "_v", F.lit(0).cast("long").alias("_n")))
    counts = prefix_sums(points, by, "_v", {"_n": F.col("_n")}).select(*by, "_v", "_n", "_n_before")
    upto = F.when(F.col("_side") > 0, F.col("_n_before")).otherwise(-F.col("_n_before") - F.col("_n"))
    m = F.when(F.max("_r") > 0, F.sum(upto)).otherwise(F.max("_n")).alias("_m")
    rows = ends.join(counts, [*by, "_v"]).groupBy(*by, "_y", "_x").agg(F.max("_c").alias("_c"), F.max("_k").alias("_k"), m)
    mean = lambda c: F.sum(F.col("_c") * digamma(F.col(c)))
    inside = rows.groupBy(*by).agg(F.sum("_c").alias("_n"), (mean("_k") - mean("_m")).alias("_s"))
    sizes = cells.groupBy(*by, "_y").agg(F.sum("_c").alias("_c")).withColumn("_t", F.sum("_c").over(Window.partitionBy(*by)))
    share = F.col("_c") / F.col("_t")
    classes = sizes.groupBy(*by).agg(F.sum(F.when(F.col("_c") > 1, F.col("_c") * digamma(F.col("_c")))).alias("_sc"), (-F.sum(share * F.log(share))).alias("_h"))
    mi = F.greatest(digamma(F.col("_n")) + (F.col("_s") - F.col("_sc")) / F.col("_n"), F.lit(0.0))
    return inside.join(classes, by).select(*by, mi.alias("mi"), F.when(F.col("_h") > 0, mi / F.col("_h")).alias("score"))
