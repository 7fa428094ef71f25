"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k over their ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barlab.llm.common import free_name, frugal, U64, mix, slices, store, text_bytes, word_hashes

#: Classes of bytes for word shapes: letters of either case, digits; any other byte stands for itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[128:], _SHAPE[65:91], _SHAPE[48:58] = 97, 97, 65, 48
BINS = 4096


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text: (bucket per n-gram, document per n-gram).

    Four families: words, word shapes (runs of one class of characters drawn together), pairs of neighbouring shapes,
    and whether a word repeats the one before it.
    """
    raw, at = text_bytes(column)
    words, before, _ = word_hashes(raw, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(before))
    if not len(words):
        return np.zeros(0, np.int64), doc
    shape = _SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = shape[1:] != shape[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    keep[heads] = True
    kept_at = np.concatenate([[0], np.cumsum(keep)])[at]
    shapes = word_hashes(shape[keep], kept_at, lower=False)[0]
    start = np.ones(len(words), bool)
    start[1:] = doc[1:] != doc[:-1]
    again = np.zeros(len(words), U64)
    again[1:] = ((words[1:] == words[:-1]) & ~start[1:]).astype(U64)
    prev = np.concatenate([[U64(0)], shapes[:-1]])
    prev[start] = 0
    grams = [words, mix(shapes + U64(11)), mix(mix(shapes + U64(23)) ^ prev), mix(again + U64(37))]
    return np.concatenate([(g % U64(buckets)).astype(np.int64) for g in grams]), np.tile(doc, len(grams))


def usable_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) once per labelled id, with its larger label; rows without an id or a value of 0 or 1 are left out."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return clean.groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids of each class, those with the smallest hashes: (doc_id, label)."""
    clean = usable_labels(labels, column)
    take = lambda v: clean.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return take(0).unionByName(take(1))


def intercept_shift(labels: DataFrame, column: str, picked: DataFrame) -> float:
    """What takes an intercept fitted on ``picked`` (of ``bounded_labels``) to the class ratio of all labels; 0 if nothing was left out."""
    n, m = ({r.label: r["count"] for r in df.groupBy("label").count().collect()} for df in (usable_labels(labels, column), picked))
    return float(np.log(n[1] / n[0] * m[0] / m[1])) if len(m) == 2 else 0.0


def gram_counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all texts and of the target ones (label 1): one number per bucket."""

    @frugal
    def count(batches):
        total = np.zeros((2, buckets))
        for batch in slices(batches):
            gram, doc = features(batch.column("text"), buckets)
            good = np.asarray(batch.column("label").fill_null(-1)) == 1
            total[0] += np.bincount(gram, minlength=buckets)
            total[1] += np.bincount(gram[good[doc]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.list_(pa.float64())), pa.array([total[1]], pa.list_(pa.float64()))], names=["raw", "target"])

    arrays = docs.select("text", "label").mapInArrow(count, "raw array<double>, target array<double>")
    rows = arrays.select(F.posexplode(F.arrays_zip("raw", "target")).alias("i", "x")).groupBy("i").agg(F.sum("x.raw").alias("raw"), F.sum("x.target").alias("target")).collect()
    out = np.zeros((2, buckets))
    for r in rows:
        out[:, r.i] = r.raw, r.target
    return out[0], out[1]


def weigh(docs: DataFrame, log_ratio: np.ndarray, out: str = "__weight") -> DataFrame:
    """``docs`` with the column ``out``: the mean log-ratio of a text's n-grams (0 for a text without words)."""
    held = docs.sparkSession.sparkContext.broadcast(log_ratio)  # one number per bucket
    schema = docs.withColumn(out, F.lit(0.0)).schema

    @frugal
    def scan(batches):
        ratio = held.value
        for batch in slices(batches):
            gram, doc = features(batch.column("text"), len(ratio))
            n = np.bincount(doc, minlength=batch.num_rows)
            w = np.bincount(doc, ratio[gram], batch.num_rows) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w)], names=[*batch.schema.names, out])

    return docs.mapInArrow(scan, schema)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope of a one-variable logistic regression, the k-th point counted ``n[k]`` times (Newton steps with a small ridge)."""
    mid = float(np.average(x, weights=n))
    scale = float(np.sqrt(np.average((x - mid) ** 2, weights=n))) or 1.0  # away from zero the steps would not converge
    total = float(n.sum())
    z = np.stack([np.ones_like(x), (x - mid) / scale], axis=1)
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (n * p * (1 - p))[:, None]).T @ z + ridge * total * np.diag([1e-6, 1e-2]) + 1e-9 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, z.T @ (n * (y - p)) - ridge * total * np.array([1e-6, 1e-2]) * b), -4, 4)
    return float(b[0] - b[1] * mid / scale), float(b[1] / scale)


def kth_largest(rows: DataFrame, k: int) -> float | None:
    """The k-th largest value of column ``key``, found by counting ever finer bins; nothing is sorted as a whole."""
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if k <= 0 or low is None:
        return None
    while high > low:
        step = (high - low) / BINS
        inside = rows.where(F.col("key").between(low, high))
        bins = inside.groupBy(F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1)).alias("bin")).agg(
            F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r.bin):
            if k <= r.n:
                if (r.lo, r.hi) == (low, high):
                    return low
                low, high = r.lo, r.hi
                break
            k -= r.n
        else:
            return low
    return low


def gumbel(seed: int) -> Column:
    """Gumbel noise that depends on the id alone."""
    u = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def importance_resample(docs: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = 1 << 15, bound: int = 20_000,
                        seed: int = 17, out: str = "__quality") -> DataFrame:
    """``docs`` with ``out``, a struct of weight, log_odds, key and kept: Gumbel top-k over the importance of each text.

    The target model counts the n-grams of texts labelled 1, the raw model those of all texts. At most ``bound`` labels of
    each class take part (they also calibrate the mean log-ratio to log-odds, at the class ratio of all labels); every text
    is counted and weighed whole.
    ``key`` is log-odds plus Gumbel noise, and the k largest keys are kept, k being the number of texts with
    non-negative log-odds. Null and empty texts have no n-grams and weight 0. Equal rows have equal keys and stay or go
    together, as do ties at the k-th key. Without labels of both classes everything is kept. Labels with a null id or
    value are left out; an id labelled twice counts with its larger label.
    """
    picked = store(bounded_labels(labels, label, bound), "labels")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw, target = gram_counts(narrow.join(F.broadcast(picked), "doc_id", "left"), buckets)  # at most 2 * bound rows
    smooth = lambda c: np.log((c + 1) / (c.sum() + len(c)))
    ratio = smooth(target) - smooth(raw) if target.any() else np.zeros(buckets)
    weighed = store(weigh(narrow, ratio).select("doc_id", "__weight"), "weights")
    # a labelled id may be repeated without bound: equal weights, to four digits, come as one row
    sample = weighed.join(F.broadcast(picked), "doc_id").groupBy(F.round("__weight", 4).alias("w"), "label").agg(F.count("*").alias("n")).orderBy("w", "label").collect()
    x, y, n = (np.array([r[c] for r in sample], float) for c in ("w", "label", "n"))
    a, b = logistic(x, y, n) if len(set(y)) == 2 else (1.0, 0.0)
    a += intercept_shift(labels, label, picked)
    odds = F.lit(a) + F.lit(b) * F.col("__weight")
    keyed = weighed.select(odds.alias("odds"), (odds + gumbel(seed)).alias("key"))
    cut = kth_largest(keyed, keyed.where("odds >= 0").count())
    name = free_name("__weight", docs.columns)
    key, odds = (F.lit(a) + F.lit(b) * F.col(name) + gumbel(seed)), F.lit(a) + F.lit(b) * F.col(name)
    kept = key >= F.lit(cut) if cut is not None else F.lit(False)
    quality = F.struct(F.col(name).alias("weight"), odds.alias("log_odds"), key.alias("key"), kept.alias("kept"))
    return weigh(docs, ratio, name).withColumn(out, quality).drop(name)


def keep_resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``importance_resample`` keeps, with their columns whatever their names."""
    name = free_name("__quality", docs.columns)
    return importance_resample(docs, labels, out=name).where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
