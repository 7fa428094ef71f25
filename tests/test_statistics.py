import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions.stats import student_t_lower
from barlab.operators import calibration, folds, invariance, metrics, pnl, ranks, sharpe, splits
from barlab.operators.bootstrap import _fold_ranges, _POISSON, bootstrap_macro_auc, poisson_weights


def brute_auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


@pytest.mark.parametrize("digits,pick", [(1, 4096), (6, 3)])
def test_auc_and_prefix_sums_match_brute_force(spark, digits, pick, monkeypatch):
    monkeypatch.setattr(ranks, "_PICK", pick)
    rng = np.random.default_rng(3)
    score, y = np.round(rng.random(700), digits), rng.integers(0, 2, 700)
    df = spark.createDataFrame([("g", float(s), int(v)) for s, v in zip(score, y)] + [("one", 0.5, 1)], "k string, s double, y int")
    got = {r.k: r.auc for r in ranks.auc(df, ["k"], "s", F.col("y") == 1).collect()}
    assert got["g"] == pytest.approx(brute_auc(score, y), abs=1e-12) and got["one"] is None
    sums = ranks.prefix_sums(df.filter("k = 'g'"), ["k"], "s", {"n": F.lit(1)}).toPandas()
    for r in sums.itertuples():
        assert r.n_before == (score < r.s).sum() and r.n_total == 700


@pytest.mark.parametrize("pick", [4096, 2])
def test_quantiles_match_numpy(spark, pick, monkeypatch):
    monkeypatch.setattr(ranks, "_PICK", pick)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=501), 2)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("h", 7.0), ("h", None)], "k string, x double")
    probs = [0.0, 0.05, 1 / 3, 0.5, 0.99, 1.0]
    got = {r.k: r.q for r in ranks.quantiles(df, ["k"], "x", probs, "q").collect()}
    np.testing.assert_allclose(got["g"], np.quantile(x, probs), atol=1e-12)
    assert got["h"] == [7.0] * 6


def test_student_t_known_values():
    assert student_t_lower(0.0, 5) == pytest.approx(0.5)
    assert student_t_lower(-2.015048, 5) == pytest.approx(0.05, abs=1e-6)
    assert student_t_lower(1.96, 1e6) == pytest.approx(0.975, abs=1e-4)
    assert student_t_lower(-12.706205, 1) == pytest.approx(0.025, abs=1e-7)


def test_multiclass_edge_cases(spark):
    rows = [(0, [0.8, 0.1, 0.1]), (1, [0.4, 0.4, 0.2]), (1, [0.1, 0.7, 0.2])]
    df = spark.createDataFrame(rows, "y int, probs array<double>")
    r = metrics.eval_multiclass(df, 3).head()
    assert r.accuracy == pytest.approx(2 / 3)
    assert r.macro_auc_ovr is None and r.class_2_recall == 0.0 and r.class_2_precision == 0.0


def test_regression_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "actual double, predicted double")
    r = metrics.eval_regression(df).head()
    assert r.pearson_r is None and r.rmse == pytest.approx(math.sqrt(2.5))


def test_calibration_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.1000001, 0.5, 1.0, 1.1)], "p double")
    got = [r[0] for r in df.select(calibration.calibration_bin(F.col("p"))).collect()]
    assert got == [0, 0, 1, 4, 9, None]


def test_pnl_table_and_unknown_interval(spark):
    rows = [(y, p, True) for y in range(3) for p in range(3)] + [(2, 2, False)]
    df = spark.createDataFrame(rows, "y int, pred int, take boolean")
    got = {(r.y, r.pred): r.gross_bps for r in pnl.trade_pnl(df, F.lit("1h")).filter("traded").collect()}
    assert got == {(2, 2): 90.0, (0, 2): -60.0, (1, 2): 0.0, (0, 0): 60.0, (2, 0): -60.0, (1, 0): 0.0}
    with pytest.raises(Exception, match="no range estimate"):
        pnl.trade_pnl(df, F.lit("2h")).collect()


def test_regime_subcuts_degenerate_and_small_groups(spark):
    rows = [(10.0, True, False, True) for _ in range(12)] + [(50.0, False, True, False) for _ in range(3)]
    df = spark.createDataFrame(rows, "gross_bps double, a boolean, b boolean, c boolean").withColumn("traded", F.lit(True)).withColumn("k", F.lit(1)).withColumn("d", F.lit(False))
    got = {r.regime: r for r in pnl.regime_subcuts(df, ["k"], 20.0, ["a", "b", "d"]).collect()}
    assert got["a"].p_value == 0.0 and got["a"].failing == 1.0
    assert got["b"].p_value is None and got["b"].caveat == 1.0 and got["b"].failing == 0.0
    assert got["d"].n == 0 and got["d"].mean_net is None and got["d"].caveat == 1.0


def test_deflated_sharpe_short_cuts(spark):
    rows = [("up", 1.0), ("up", 1.0), ("down", -1.0), ("down", -1.0), ("one", 3.0)] + [("mix", float(v)) for v in (1, 2, 3, 1, 2)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in sharpe.deflated_sharpe(df, ["k"], "x").collect()}
    assert got["up"].dsr == 1.0 and got["down"].dsr == 0.0 and got["one"].dsr is None
    assert got["mix"].dsr > 0.95 and got["mix"].discount_active == 0.0
    more = sharpe.deflated_sharpe(df, ["k"], "x", n_trials=50, variance=1.0).filter("k = 'mix'").head()
    assert more.dsr < got["mix"].dsr


def test_invariance_finds_a_shift(spark):
    rng = np.random.default_rng(5)
    rows = []
    for role, flip in (("train", 1), ("test", -1)):
        for _ in range(400):
            a, b = rng.normal(size=2)
            rows.append((role, float(a), float(b), float(flip * a > 0)))
    df = spark.createDataFrame(rows, "role string, a double, b double, y double")
    worst = {r.feature: r.max_diff for r in invariance.per_feature_max(invariance.bin_shifts(df, [], ["a", "b"], "binary")).collect()}
    assert worst["a"] > 0.9 > worst["b"]
    assert not invariance.conditional_invariance(df, [], ["a", "b"], "binary").head().passes
    few = invariance.conditional_invariance(df.limit(30), [], ["a"], "binary").head()
    assert few.skipped_reason is not None


def test_fold_windows_do_not_overlap(spark):
    w = spark.createDataFrame([(datetime(2020, 1, 1), datetime(2022, 1, 1))], "start timestamp_ntz, end timestamp_ntz")
    got = folds.generate_folds(w, 365, 21, 7, 50).orderBy("fold").collect()
    assert len(got) == (731 - 372) // 21
    for a, b in zip(got, got[1:]):
        assert a.test_end == b.test_start
    for f in got:
        assert f.test_start - f.train_end == timedelta(days=7) and f.train_end - f.train_start == timedelta(days=365)
    with pytest.raises(ValueError):
        folds.generate_folds(w, test_days=0)


def test_split_roles(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(hours=i),) for i in range(1000)], "ts timestamp_ntz")
    role = splits.early_stopping_carve(df, 0.2, "1h").groupBy("role").count().collect()
    assert {r.role: r["count"] for r in role} == {"inner": 632, "embargo": 168, "es_val": 200}
    assert splits.early_stopping_carve(df.limit(180), 0.1, "1h").filter("role IS NOT NULL").count() == 0
    assert splits.stride_sample(df, 300).count() == 300
    with pytest.raises(ValueError):
        splits.split_chronological(df, 0.5)
    with pytest.raises(Exception, match="unknown class label"):
        spark.createDataFrame([(0.5,)], "y double").select(splits.encode_multiclass(F.col("y"))).collect()


def test_bootstrap_agrees_with_resampling(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 400)
    p = rng.random((400, 3)).round(2) + np.eye(3)[y] * 0.3
    p = p / p.sum(axis=1, keepdims=True)
    df = spark.createDataFrame([(i, int(v), [float(q) for q in row]) for i, (v, row) in enumerate(zip(y, p))], "id long, y int, probs array<double>").withColumn("k", F.lit(1))
    got = bootstrap_macro_auc(df, 3, ["k"], ["id"], replicates=300).head()
    draws = []
    for _ in range(300):
        i = rng.integers(0, 400, 400)
        draws.append(np.mean([brute_auc(p[i, c], (y[i] == c).astype(int)) for c in range(3)]))
    assert got.n_valid == 300
    assert got.auc_mean == pytest.approx(np.mean(draws), abs=0.005)
    assert got.auc_std == pytest.approx(np.std(draws), rel=0.25)
    w = poisson_weights(np.arange(2000), 50, 1)
    assert w.mean() == pytest.approx(1.0, abs=0.02) and w.var() == pytest.approx(1.0, abs=0.05)


def test_bootstrap_folds_a_range_as_plain_sums_do():
    rng = np.random.default_rng(8)
    for n, digits in ((3000, 1), (3000, 9), (1, 1), (700, 0)):  # long ties across pieces, none, one row, one score
        pdf = pd.DataFrame({"k": 1, "_class": 0, "_range": 0, "_score": np.sort(rng.random(n).round(digits)), "_id": rng.integers(-2**62, 2**62, n), "_pos": rng.random(n) < 0.3})
        got = pd.concat(_fold_ranges(["k"], 40, 42)([pdf.iloc[:1700], pdf.iloc[1700:]] if n > 1700 else [pdf]))
        assert len(got) == 1
        w = poisson_weights(pdf["_id"].to_numpy(), 40, 42).astype(float)
        pos, s = pdf["_pos"].to_numpy(), pdf["_score"].to_numpy()
        smaller = (s[None, ~pos] < s[pos][:, None]) + 0.5 * (s[None, ~pos] == s[pos][:, None])
        assert got.iloc[0]["pos"] == w[pos].sum(axis=0).tolist() and got.iloc[0]["neg"] == w[~pos].sum(axis=0).tolist()
        assert got.iloc[0]["u"] == np.einsum("ir,ij,jr->r", w[pos], smaller, w[~pos], optimize=True).tolist()


def test_poisson_draws_stay_small_and_exact():
    ids = np.random.default_rng(9).integers(-2**62, 2**62, 4000)
    w = poisson_weights(ids, 300, 42)
    assert w.dtype == np.uint8  # a byte a draw: a piece of rows and its sums stay in a core's cache
    with np.errstate(over="ignore"):
        z = ids.view(np.uint64)[:, None] ^ (np.arange(300, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(42))[None, :]
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(mult)
        z ^= z >> np.uint64(31)
    assert (w == np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right")).all()


def test_ensemble_statistics_shuffle_a_row_once(spark):
    rng = np.random.default_rng(10)
    long = [(i, m, c, float(rng.random()), i % 3) for i in range(60) for m in ("a", "b", "c") for c in range(3) if not (i == 7 and c == 2)]
    df = spark.createDataFrame(long, "id long, model string, class int, p double, y int")
    pdf = pd.DataFrame(long, columns=["id", "model", "class", "p", "y"])
    mean, sd = (pdf.groupby(["id", "class"])["p"].agg(f) for f in ("mean", lambda v: v.std(ddof=0)))
    got = {(r["id"], r["class"]): r.p for r in metrics.ensemble_mean(df, ["id"], 3).collect()}
    assert got == pytest.approx(mean.to_dict()) and got == pytest.approx({(r["id"], r["class"]): r.p for r in metrics.ensemble_mean(df, ["id"]).collect()})
    spread = {r["class"]: r.mean_disagreement for r in metrics.disagreement_summary(df, ["id"], 3).collect()}
    by_class = sd.groupby("class").mean()
    assert spread == pytest.approx({**by_class.to_dict(), -1: by_class.mean()})
    meta = metrics.meta_features(df, ["id"], 3, "y")
    for r in meta.collect():
        m = mean[r["id"]]
        assert r.confidence == pytest.approx(m.max()) and r.spread == pytest.approx(m.max() - m.min()) and r.direction == m.idxmax()
        assert r.disagreement == pytest.approx(sd[r["id"]].mean()) and r.meta_target == int(m.idxmax() == r.y)
    for out in (meta, metrics.ensemble_mean(df, ["id"], 3)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1  # and not a second one per class
