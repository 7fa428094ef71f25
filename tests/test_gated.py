"""From a data set to gates: the run's row against the single operators, and the guards before it."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators.folds import generate_folds
from barlab.operators.metrics import argmax
from barlab.operators.pnl import cost_regime_metrics, trade_pnl
from barlab.plans import models as mo
from barlab.plans.gated import run_to_gates
from barlab.plans.walkforward import run_walk_forward

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    out = []
    for i in range(1100):
        a, b, v = rng.normal(size=3)
        y = 2 if a > 0.6 else 0 if a < -0.6 else 1
        out.append(("x", START + timedelta(hours=i), float(a + rng.normal() * 0.2), float(b), float(abs(v)), float(y)))
    rows = spark.createDataFrame(out, "symbol string, ts timestamp_ntz, a double, b double, v double, y double").cache()
    window = spark.createDataFrame([(START, START + timedelta(days=45))], "start timestamp_ntz, end timestamp_ntz")
    return rows, generate_folds(window, 20, 10, 1, 2)




def end():
    return F.lit(START + timedelta(hours=1100)).cast("timestamp_ntz")


def test_three_classes_reach_the_directional_gates(spark, data):
    rows, folds = data
    spec = mo.ModelSpec("run", "multiclass", ("a", "b"), params={"maxIter": 4, "maxDepth": 2})
    got = run_to_gates(rows, folds, spec, end(), "directional", vol="v", trend="b", adversarial_iter=None, replicates=40)
    gates = {r.gate: r for r in got.gate_rows().collect()}
    assert len(gates) == 13 and gates["baseline_edge"].verdict == "PASS" and gates["pit_no_leak"].verdict == "PASS"
    assert gates["bootstrap_ci_lower"].verdict == "PASS" and gates["cost_regime_profitable"].verdict == "PASS"
    assert gates["dsr"].note == "no discount for the number of trials is active" and gates["baseline_edge"].note is None
    run = got.run.first()
    assert (run.n_folds_configured, run.n_folds_run, run.n_folds_valid) == (2, 2, 2)
    trades = trade_pnl(got.walk.oof.withColumn("pred", argmax(F.col("probs"))).withColumn("take", F.lit(True)), F.lit("1h"))
    want = {(r.fold, r.regime): r.net_mean for r in cost_regime_metrics(trades, ["fold"]).collect()}
    assert {(r.fold, r.regime): r.net_mean for r in got.trading.costs.collect()} == pytest.approx(want)
    assert run.realistic_profitable == max(r.profitable for r in cost_regime_metrics(trades, []).collect() if r.regime == "realistic")
    assert got.verdict().first().overall in ("CONDITIONAL_PASS", "FAIL")
    record = got.record.first()
    assert len(record.content_sha256) == 64 and record.deployment_ready


def test_a_binary_run_has_adversarial_scores_and_six_gates(spark, data):
    rows, folds = data
    binary = rows.withColumn("y", (F.col("y") == 2).cast("double"))
    spec = mo.ModelSpec("bin", "binary", ("a", "b"), params={"maxIter": 4, "maxDepth": 2})
    got = run_to_gates(binary, folds, spec, end(), adversarial_iter=2)
    gates = {r.gate: r.verdict for r in got.gate_rows().collect()}
    assert len(gates) == 6 and gates["generalization_edge"] == "PASS" and gates["walk_forward_complete"] == "PASS" and got.trading is None
    scores = [r.value for r in got.metrics.filter("metric = 'adversarial_auc'").collect()]
    assert len(scores) == 2 and all(0.3 < s < 0.7 for s in scores)
    assert {r.check for r in got.checks.collect()} >= {"min_rows", "label_leakage", "stale_tail"}


def test_a_run_without_a_usable_fold_fails_its_gates(spark, data):
    rows, folds = data
    spec = mo.ModelSpec("thin", "multiclass", ("a", "b"), params={"maxIter": 2, "maxDepth": 2})
    thin = rows.withColumn("y", F.least("y", F.lit(1.0)))  # a barrier that is never reached leaves two classes
    got = run_to_gates(thin, folds, spec, end(), "directional", vol="v", trend="b", adversarial_iter=2, replicates=40)
    gates = {r.gate: r for r in got.gate_rows().collect()}
    assert len(gates) == 13 and got.trading is None
    assert {g.verdict for g in gates.values()} <= {"FAIL", "SKIP"} | {gates["pit_no_leak"].verdict}
    assert gates["baseline_edge"].verdict == "FAIL" and gates["baseline_edge"].note == "no fold could be fitted: insufficient_classes_in_train_set"
    assert gates["dsr"].note is None  # nothing was judged
    run = got.run.first()
    assert (run.n_folds_configured, run.n_folds_generated, run.n_folds_run, run.n_folds_valid, run.primary_mean) == (2, 2, 0, 0, None)
    assert got.verdict().first().overall == "FAIL" and len(got.record.first().content_sha256) == 64
    with pytest.raises(ValueError, match="no usable fold"):  # a walk-forward run on its own stays an error
        run_walk_forward(thin, folds, spec)


def test_guards_before_the_run(spark, data):
    rows, folds = data
    spec = mo.ModelSpec("bin", "binary", ("a", "b"))
    with pytest.raises(ValueError, match="embargo"):
        run_to_gates(rows, folds, spec, end(), label="forward_return_24", embargo_days=0.5)
    with pytest.raises(ValueError, match="vol and trend"):
        run_to_gates(rows, folds, mo.ModelSpec("m", "multiclass", ("a", "b")), end())
