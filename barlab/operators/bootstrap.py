"""Bootstrap confidence interval of the macro one-vs-rest AUC.

Resampling with replacement is replaced by a Poisson(1) weight per (row, replicate) drawn from a hash
of both, so every task, retry and class of a row sees the same draw. Rows are sorted once by
(class, score range, score) and never multiplied by the number of replicates: each Arrow batch of a
range is folded into one weight vector per range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barlab.operators.ranks import _with_range

_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
#: The draw for every value of a hash's upper 16 bits; 255 where these do not settle it.
_TOP = np.searchsorted(_POISSON, np.arange(1 << 16) / 65536.0, side="right")
_TOP = np.where(np.searchsorted(_POISSON, np.arange(1, (1 << 16) + 1) / 65536.0, side="left") == _TOP, _TOP, 255).astype(np.uint8)
#: Rows that are hashed, and rows that are folded, at a time: what stays in a core's cache with a thousand replicates.
_HASHED, _FOLDED = 64, 512


def poisson_weights(row_hash: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Matrix (rows, replicates) of Poisson(1) draws as bytes, a pure function of its arguments."""
    ids = row_hash.astype(np.int64).view(np.uint64)
    out = np.empty((len(ids), replicates), np.uint8)
    with np.errstate(over="ignore"):
        r = np.arange(replicates, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
        for at in range(0, len(ids), _HASHED):
            z = ids[at:at + _HASHED, None] ^ r[None, :]
            moved = np.empty_like(z)
            for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z ^= np.right_shift(z, np.uint64(shift), out=moved)
                z *= np.uint64(mult)
            z ^= np.right_shift(z, np.uint64(31), out=moved)
            draw = _TOP[np.right_shift(z, np.uint64(48), out=moved).astype(np.uint16)]
            open_ = draw == 255
            draw[open_] = np.searchsorted(_POISSON, (z[open_] >> np.uint64(11)) * 2.0**-53, side="right")
            out[at:at + _HASHED] = draw
    return out


def _inner_pairs(w: np.ndarray, positive: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of positive rows, of negative rows, and (positive, smaller negative) pairs with ties counted half, per replicate.

    ``first``: where the rows of each score begin. All sums are whole numbers, so their order does not matter.
    """
    negative = w[~positive]
    before = np.zeros((len(negative) + 1, w.shape[1]), np.int32)
    np.cumsum(negative, axis=0, dtype=np.int32, out=before[1:])
    seen = np.concatenate([[0], np.cumsum(~positive)])
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))[positive]
    start, end = seen[first], seen[np.append(first[1:], len(w))]
    mine = w[positive]
    twice = before[start[of]]
    twice += before[end[of]]
    twice *= mine
    return mine.sum(axis=0, dtype=np.int64), before[-1].astype(np.int64), twice.sum(axis=0, dtype=np.int64) / 2


def _fold_ranges(keys: Sequence[str], replicates: int, seed: int):
    """Batches sorted by (keys, class, range, score) -> per range the vectors pos, neg and u."""
    group = [*keys, "_class", "_range"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def emit():
            state["u"] += state["tp"] * (state["neg"] + state["tn"] / 2)
            row = dict(zip(group, current))
            row["pos"] = [(state["pos"] + state["tp"]).tolist()]
            row["neg"] = [(state["neg"] + state["tn"]).tolist()]
            row["u"] = [state["u"].tolist()]
            return pd.DataFrame(row)

        for pdf in batches:
            ids = pdf[group].ne(pdf[group].shift()).any(axis=1).cumsum()
            for _, part in pdf.groupby(ids, sort=False):
                label = tuple(part[group].iloc[0])
                if label != current:
                    if current is not None:
                        yield emit()
                    current = label
                    state = {k: np.zeros(replicates) for k in ("pos", "neg", "u", "tp", "tn")}
                    state["score"] = None
                for lo in range(0, len(part), _FOLDED):
                    piece = part.iloc[lo:lo + _FOLDED]
                    score = piece["_score"].to_numpy()
                    w = poisson_weights(piece["_id"].to_numpy(), replicates, seed)
                    first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
                    positive = piece["_pos"].eq(True).to_numpy(bool)
                    lead = 0
                    if state["score"] == score[0]:  # the score that the last piece ended with goes on
                        lead = first[1] if len(first) > 1 else len(score)
                        state["tp"] = state["tp"] + w[:lead][positive[:lead]].sum(axis=0, dtype=np.int64)
                        state["tn"] = state["tn"] + w[:lead][~positive[:lead]].sum(axis=0, dtype=np.int64)
                        if lead == len(score):
                            continue
                        first = first[1:]
                    state["u"] += state["tp"] * (state["neg"] + state["tn"] / 2)
                    state["pos"] += state["tp"]
                    state["neg"] += state["tn"]
                    last = first[-1]
                    if len(first) > 1:
                        tp, tn, u = _inner_pairs(w[lead:last], positive[lead:last], first[:-1] - lead)
                        state["u"] += u + tp * state["neg"]
                        state["pos"] += tp
                        state["neg"] += tn
                    state.update(tp=w[last:][positive[last:]].sum(axis=0, dtype=np.int64),
                                 tn=w[last:][~positive[last:]].sum(axis=0, dtype=np.int64), score=score[-1])
        if current is not None:
            yield emit()

    return run


def bootstrap_macro_auc(
    df: DataFrame, n_classes: int, keys: Sequence[str], row_id: Sequence[str], y: str = "y", probs: str = "probs",
    replicates: int = 1000, seed: int = 42,
) -> DataFrame:
    """Mean, 5 % and 95 % quantiles and population std of the replicate AUCs per key; replicates that
    lose a class are dropped and counted out."""
    each = df.select(*keys, y, F.xxhash64(*row_id).alias("_id"), F.posexplode(probs).alias("_class", "_score"))
    by = [*keys, "_class"]
    # An explicit partition count keeps the numeric work spread out; by bytes alone it would be merged.
    ranges = (
        _with_range(each.withColumn("_pos", F.col(y) == F.col("_class")), by, "_score")
        .select(*by, "_range", "_score", "_id", "_pos")
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_range")
        .sortWithinPartitions(*by, "_range", "_score", "_id")
    )
    kinds = {f.name: f.dataType.simpleString() for f in ranges.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, "_range"])
    folded = ranges.mapInPandas(
        _fold_ranges(keys, replicates, seed), f"{schema}, pos array<double>, neg array<double>, u array<double>"
    )
    long = folded.select(*by, "_range", F.posexplode(F.arrays_zip("pos", "neg", "u")).alias("rep", "v")).select(
        *by, "_range", "rep", "v.*"
    )
    earlier = Window.partitionBy(*by, "rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    chained = long.withColumn("u", F.col("u") + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
    pairs = F.sum("pos") * F.sum("neg")
    aucs = chained.groupBy(*by, "rep").agg(F.when(pairs > 0, F.sum("u") / pairs).alias("auc"))
    macro = aucs.groupBy(*keys, "rep").agg(F.when(F.count("auc") == n_classes, F.avg("auc")).alias("auc"))
    q = F.percentile("auc", F.array(F.lit(0.05), F.lit(0.95)))
    return macro.groupBy(*keys).agg(
        F.avg("auc").alias("auc_mean"), q.alias("_q"), F.stddev_pop("auc").alias("auc_std"),
        F.count("auc").alias("n_valid"), F.count(F.lit(1)).alias("n_bootstrap"),
    ).select(*keys, "auc_mean", F.col("_q")[0].alias("ci_lower_5"), F.col("_q")[1].alias("ci_upper_95"),
             "auc_std", "n_valid", "n_bootstrap")
