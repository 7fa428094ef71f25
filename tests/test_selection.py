"""Neighbour information against a direct evaluation, the blocked Gram matrix, pruning, and the shared check aggregate."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.stats import digamma
from barlab.operators import integrity, selection
from barlab.operators.neighbours import neighbour_information


def psi(n):
    return sum(1 / j for j in range(1, int(n))) - 0.5772156649015329


def direct(x, y, k=3):
    """The estimator by comparing every row with every row."""
    rows = [(a, b) for a, b in zip(x, y) if a is not None and b is not None and not math.isnan(a)]
    size, terms = Counter(b for _, b in rows), []
    for i, (a, b) in enumerate(rows):
        if size[b] < 2:
            continue
        own = sorted(abs(a - c) for j, (c, d) in enumerate(rows) if j != i and d == b)
        kk = min(k, len(own))
        r = own[kk - 1]
        m = sum(a - r < c < a + r for c, _ in rows) if r > 0 else sum(c == a for c, _ in rows)
        terms.append(psi(kk) - psi(size[b]) - psi(m))
    n = len(rows)
    h = -sum(c / n * math.log(c / n) for c in size.values())
    mi = max(0.0, psi(len(terms)) + np.mean(terms))
    return mi, mi / h if h > 0 else None


CASES = {
    "separate": lambda rng, n: (lambda y: (y * 3 + rng.normal(size=n), y))(rng.integers(0, 3, n)),
    "noise": lambda rng, n: (rng.normal(size=n), rng.integers(0, 2, n)),
    "tied": lambda rng, n: (lambda y: (y + rng.integers(0, 4, n).astype(float), y))(rng.integers(0, 2, n)),
    "constant": lambda rng, n: (np.full(n, 2.5), rng.integers(0, 2, n)),
    "hot": lambda rng, n: (np.where(rng.random(n) < 0.8, 1.0, np.round(rng.normal(size=n), 3)), (rng.random(n) < 0.9).astype(int)),
    "rare": lambda rng, n: (np.round(rng.normal(size=n), 6), np.r_[np.zeros(n - 4), 1, 1, 2, 3].astype(int)),
}


@pytest.mark.parametrize("case", CASES)
def test_neighbour_information_equals_direct_evaluation(spark, case):
    x, y = CASES[case](np.random.default_rng(2), 400)
    rows = [(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1), (0.5, None), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "f double, y int").repartition(3)
    got = neighbour_information(df, ["f"], chunk_rows=16).first()
    assert (got.mi, got.score) == pytest.approx(direct(*zip(*rows)), abs=1e-9)
    if case == "tied":
        assert tuple(neighbour_information(df, ["f"]).first())[1:] == pytest.approx((got.mi, got.score), abs=1e-12)


def test_neighbour_information_by_key_and_without_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 2}", float(v), float(-v if i % 3 else v), int(v > 0)) for i, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "s string, a double, b double, y int")
    got = {(r.s, r.feature): r.mi for r in neighbour_information(df, ["a", "b"], ["s"]).collect()}
    for s in ("s0", "s1"):
        part = [r for r in rows if r[0] == s]
        assert got[s, "a"] == pytest.approx(direct([r[1] for r in part], [r[3] for r in part])[0], abs=1e-9)
        assert got[s, "b"] == pytest.approx(direct([r[2] for r in part], [r[3] for r in part])[0], abs=1e-9)
    assert neighbour_information(df.limit(0), ["a"]).collect() == []


def test_digamma(spark):
    got = spark.range(1, 200).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-10) for r in got)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_blocked_correlations(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 7)) + 1e6
    x[:, 3] = x[:, 0] * -2 + rng.normal(size=500) * 0.1
    x[:, 5] = 4.0
    names = [f"f{i}" for i in range(7)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {(r.i, r.j): r.corr for r in selection.corr_matrix(df, names, block).collect()}
    with np.errstate(all="ignore"):
        want = np.abs(np.corrcoef(x.T))
    assert len(got) == 49
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert (got[a, b] is None) if 5 in (i, j) else got[a, b] == pytest.approx(want[i, j], abs=1e-9)
    assert selection.corr_matrix(df.limit(0), names).collect() == []
    with pytest.raises(Exception, match="missing value"):
        selection.corr_matrix(df.withColumn("f2", F.when(F.col("f2") > 1e6, F.col("f2"))), names).collect()


def test_selection_by_neighbours_drops_the_weaker_twin(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 600)
    strong = y * 2 + rng.normal(size=600)
    data = np.c_[strong + rng.normal(size=600) * 0.3, strong, rng.normal(size=600), y + rng.normal(size=600)]
    df = spark.createDataFrame([(*map(float, r), 1.0, int(c)) for r, c in zip(data, y)], "twin double, strong double, noise double, weak double, interval_indicator double, y int")
    names = ["interval_indicator", "twin", "strong", "noise", "weak"]
    assert selection.select_features(df, names, max_features=3) == ["interval_indicator", "strong", "weak"]
    assert selection.select_features(df, names, max_features=3, n_bins=10) == ["interval_indicator", "strong", "weak"]


def test_check_suite_equals_the_single_checks(spark):
    i = F.col("id")
    df = spark.range(3000).select(
        F.when(i % 10 < 8, "A").when(i % 10 == 8, "B").otherwise("C").alias("symbol"), F.timestamp_micros(i * 3_600_000_000).alias("ts"),
        F.when(i % 10 == 9, 1).otherwise((i % 7 < 3).cast("int")).alias("y"), (i % 13).cast("double").alias("a"), F.lit(1.0).alias("flat"),
        F.when(i < 500, i.cast("double")).alias("ends"), (i % 7 < 3).cast("double").alias("copy"))
    end, features, clean = F.lit("1970-05-06").cast("timestamp"), ["a", "flat", "ends", "copy"], ["a", "flat", "copy"]
    single = integrity.combine([
        integrity.min_rows(df, ["symbol"]), integrity.constant_features(df, features, ["symbol"]), integrity.stale_tail(df, features, end, ["symbol"]),
        integrity.binary_class_balance(df, ["symbol"]), integrity.train_val_class_balance(df, 0.2, ["symbol"]), integrity.label_stationarity(df, ["symbol"]),
        integrity.label_leakage(integrity.leakage_pearson(df, clean, ["symbol"]), ["symbol"])])
    suite = integrity.check_suite(df, features, clean, end, 0.2, ["symbol"])
    key = lambda d: sorted((r.symbol, r.check, r.severity, None if r.actual is None else round(r.actual, 9)) for r in d.collect())
    assert key(suite) == key(single)
    plan = suite._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") <= 10
