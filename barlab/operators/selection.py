"""Feature selection: correlation pruning, then the most informative features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barlab.operators.integrity import mutual_information
from barlab.operators.neighbours import neighbour_information

ALWAYS_KEEP = ("interval_indicator",)
CORR_THRESHOLD = 0.7
MAX_FEATURES = 8
BLOCK = 64
FAN_IN = 256

_PRODUCTS = "bi int, bj int, part int, s array<double>"


def _products(frames: Iterator[pa.RecordBatch], centre: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """A task's share of the Gram matrix of the centred columns: one row per block pair of the upper triangle."""
    p = len(centre)
    blocks = [(i, j) for i in range(0, p, block) for j in range(i, p, block)]
    sums: dict = {}
    for batch in frames:
        x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(p)]) - centre
        for i, j in blocks:
            product = x[:, i:i + block].T @ x[:, j:j + block]
            sums[i, j] = product if (i, j) not in sums else sums[i, j] + product
    if sums:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in blocks], pa.int32()), pa.array([j for _, j in blocks], pa.int32()),
             pa.array([part] * len(blocks), pa.int32()), pa.array([sums[b].ravel() for b in blocks], pa.list_(pa.float64()))],
            ["bi", "bj", "part", "s"])


def _added(table: pa.Table) -> np.ndarray:
    """The sum of a group's blocks, added in the order of their parts."""
    ordered = table.sort_by("part")["s"].combine_chunks()
    return ordered.flatten().to_numpy().reshape(len(ordered), -1).sum(axis=0)


def corr_matrix(df: DataFrame, features: Sequence[str], block: int = BLOCK) -> DataFrame:
    """|correlation| of every feature pair as (i, j, corr); undefined entries are null. A missing value raises.

    A first pass finds means and deviations, one number per feature. In the second each task adds up products of feature
    blocks, upper triangle only; a block pair's shares meet at most ``FAN_IN`` at a time in two rounds and leave as rows, so
    the driver never holds features x features numbers.
    """
    names, p = list(features), len(features)
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.raise_error(F.lit(f"{f} has a missing value")).cast("double")).alias(f)
    x = df.select(*[value(f) for f in names])
    row = x.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(names)], *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(names)],
                F.count(F.lit(1)).alias("n")).first()
    n = row["n"]
    centre = np.array([row[f"m{i}"] if n else 0.0 for i in range(p)])
    scale = np.sqrt(np.array([row[f"v{i}"] if n else 0.0 for i in range(p)]))

    def gather(table: pa.Table) -> pa.Table:
        return pa.table({"bi": table["bi"][:1], "bj": table["bj"][:1], "part": pa.array([table["part"][0].as_py() % FAN_IN], pa.int32()),
                         "s": pa.array([_added(table)], pa.list_(pa.float64()))})

    def rows(table: pa.Table) -> pa.Table:
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        i, j = np.arange(bi, min(bi + block, p)), np.arange(bj, min(bj + block, p))
        with np.errstate(all="ignore"):
            corr = np.abs(_added(table).reshape(len(i), len(j)) / n / np.outer(scale[i], scale[j]))
        corr[~np.isfinite(corr)] = np.nan
        a, b, c = np.repeat(i, len(j)), np.tile(j, len(i)), np.minimum(corr, 1.0).ravel()
        a, b, c = (np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([c, c])) if bi < bj else (a, b, c)
        return pa.table({"i": pa.array([names[k] for k in a], pa.string()), "j": pa.array([names[k] for k in b], pa.string()),
                         "corr": pa.array(c, pa.float64(), from_pandas=True)})

    shares = x.mapInArrow(lambda frames: _products(frames, centre, block), _PRODUCTS)
    gathered = shares.groupBy("bi", "bj", F.pmod("part", F.lit(FAN_IN)).alias("share")).applyInArrow(gather, _PRODUCTS)
    return gathered.groupBy("bi", "bj").applyInArrow(rows, "i string, j string, corr double")


def correlated_pairs(corr: DataFrame, threshold: float = CORR_THRESHOLD) -> DataFrame:
    return corr.filter((F.col("i") < F.col("j")) & (F.col("corr") > threshold))


def side_columns(columns: Sequence[str], keep: Sequence[str] = ALWAYS_KEEP) -> list[str]:
    return [c for c in columns if c in keep]


def prune(names: Sequence[str], mi: dict[str, float], corr: dict[tuple[str, str], float], threshold: float) -> list[str]:
    """``names`` without the losers of the pairs (i < j) above ``threshold``, taken in alphabetical order: of two that are still
    there the less informative goes, the later name on a tie."""
    gone: set[str] = set()
    for pair in sorted(p for p, c in corr.items() if c is not None and c > threshold):
        if gone.isdisjoint(pair):
            first, second = pair
            gone.add(first if mi[first] < mi[second] else second)
    return [n for n in names if n not in gone]


def select_features(
    df: DataFrame, features: Sequence[str], y: str = "y", max_features: int = MAX_FEATURES,
    threshold: float = CORR_THRESHOLD, n_bins: int | None = None,
) -> list[str]:
    """Structural columns first, then the kept candidates in input order.

    The information of a feature is estimated from nearest neighbours, or from ``n_bins`` quantile bins if given. The statistics are Spark
    jobs; the driver reads one number per feature and the pairs above the threshold.
    """
    if max_features < 1:
        raise ValueError("max_features must be at least 1")
    keep = side_columns(features)
    names = [f for f in features if f not in keep]
    if not names:
        return keep
    estimate = mutual_information(df, names, (), y, n_bins) if n_bins else neighbour_information(df, names, (), y)
    mi = {n: 0.0 for n in names} | {r.feature: r.mi for r in estimate.collect()}
    similar = {(r.i, r.j): r.corr for r in correlated_pairs(corr_matrix(df, names), threshold).collect()}
    left = prune(names, mi, similar, threshold)
    budget = max(1, max_features - len(keep))
    best = set(sorted(left, key=lambda n: (-mi[n], names.index(n)))[:budget])
    return keep + [n for n in left if n in best]
