from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlab.operators import gates, integrity, selection
from barlab.sources import runs, signals
from barlab.streaming.upsert import upsert_sink

START = datetime(2024, 1, 1)
FULL = dict(purpose="regime", integrity_verdict="PASS", n_folds_configured=6, n_folds_generated=6, n_folds_run=6, n_folds_valid=6)


def run_frame(spark, rows):
    schema = ", ".join(f"{n} {t}" for n, t in gates.RUN_COLUMNS.items())
    return spark.createDataFrame([tuple(r.get(n) for n in gates.RUN_COLUMNS) for r in rows], schema)


def test_known_runs_fail_where_expected(spark):
    rows = [
        dict(FULL, run_id="a", objective="binary", primary_metric="auc", primary_mean=0.4566, primary_median=0.45, primary_std=0.0942, last_value=0.5371, ci_max_abs_diff=0.1),
        dict(FULL, run_id="b", objective="regression", primary_metric="pearson_r", primary_mean=-0.010, primary_median=0.0, primary_std=0.322, last_value=-0.221, ci_max_abs_diff=0.1),
        dict(FULL, run_id="c", objective="binary", primary_metric="auc", primary_mean=0.5338, primary_median=0.5109, primary_std=0.1142, last_value=0.6094, ci_max_abs_diff=0.2949),
        dict(FULL, run_id="d", objective="binary", primary_metric="auc", primary_mean=0.52, primary_median=0.52, primary_std=0.15, last_value=0.5, ci_max_abs_diff=0.1499),
        dict(FULL, run_id="e", objective="binary", primary_metric="auc", primary_mean=0.6, primary_std=0.1, last_value=0.6, ci_max_abs_diff=0.15),
        dict(FULL, run_id="f", objective="binary", primary_metric="rmse", primary_mean=0.6, primary_std=0.1, last_value=0.6, ci_max_abs_diff=0.1),
    ]
    out = gates.evaluate(run_frame(spark, rows), gates.modulator_gates()).collect()
    failed = {k: {r.gate for r in out if r.run_id == k and r.verdict != "PASS"} for k in "abcdef"}
    assert failed["a"] == {"generalization_edge"}
    assert failed["b"] == {"generalization_edge", "fold_stability", "saved_model_above_random"}
    assert failed["c"] == {"generalization_edge", "transferability"}
    assert failed["d"] == set()
    assert failed["e"] == {"transferability"}
    overall = {r.run_id: r.overall for r in gates.verdicts(run_frame(spark, rows)).collect()}
    assert overall["d"] == "PASS" and overall["f"] == "FAIL"


def test_directional_verdicts(spark):
    good = dict(FULL, run_id="g", objective="multiclass", purpose="directional", primary_metric="macro_auc_ovr", primary_mean=0.56, ci_lower_5=0.51,
                ci_max_abs_diff=0.1, realistic_profitable=1.0, conservative_profitable=1.0, regime_pass=1.0, regime_caveat=0.0, dsr_pass=1.0)
    rows = [good, dict(good, run_id="h", primary_mean=0.55), dict(good, run_id="i", regime_caveat=None), dict(good, run_id="j", ci_lower_5=float("nan"))]
    got = {r.run_id: r for r in gates.verdicts(run_frame(spark, rows)).collect()}
    assert got["g"].overall == "CONDITIONAL_PASS" and (got["g"].n_pass, got["g"].n_skip) == (7, 6)
    assert {got[k].overall for k in "hij"} == {"FAIL"}
    six, thirteen = gates.route(run_frame(spark, rows))
    assert six.count() == 0 and thirteen.count() == 4


def test_flatten_oof_checks_lengths(spark):
    schema = "fold int, train_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz, oof_predictions array<double>, oof_timestamps array<timestamp_ntz>"
    row = lambda p, t: (0, START, START, START, p, t)
    ok = spark.createDataFrame([row([0.1, None, float("nan")], [START + timedelta(hours=i) for i in range(3)]), row(None, None)], schema)
    assert [r.value for r in signals.flatten_oof(ok, "s", "x", "sha").collect()] == [0.1]
    bad = spark.createDataFrame([row([0.1], [START, START])], schema)
    with pytest.raises(Exception, match="counts differ"):
        signals.flatten_oof(bad, "s", "x", "sha").collect()


SIG = "signal_id string, symbol string, ts timestamp_ntz, value double"


def test_upsert_overwrites_by_key_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "sig")
    first = spark.createDataFrame([("s", "x", START + timedelta(days=20 * i), float(i)) for i in range(4)], SIG)
    second = spark.createDataFrame([("s", "x", START + timedelta(days=20), 9.0), ("s", "y", START, 5.0)], SIG)
    for batch in (first, second, second):
        signals.upsert(spark, batch, path)
    got = {(r.symbol, r.ts): r.value for r in spark.read.parquet(path).collect()}
    assert len(got) == 5 and got[("x", START + timedelta(days=20))] == 9.0 and got[("x", START)] == 0.0


def test_upsert_as_stream_sink(spark, tmp_path):
    spark.createDataFrame([("s", "x", START, 1.0)], SIG).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SIG).parquet(str(tmp_path / "in"))
    q = upsert_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_trials(spark):
    rows = [("s", 0, 0.5, "COMPLETE"), ("s", 1, 0.7, "COMPLETE"), ("s", 2, 0.7, "COMPLETE"), ("s", 3, 0.9, "PRUNED"), ("s", 4, None, "FAIL")]
    t = spark.createDataFrame(rows, "spec string, trial_number long, score double, state string")
    assert [r.trial_number for r in runs.top_k_trials(t, 2).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(Exception, match="too few complete"):
        runs.top_k_trials(t, 4).collect()
    assert runs.best_run(t.filter("trial_number < 3")).head().best_trial == 1
    with pytest.raises(Exception, match="NaN"):
        runs.best_run(t.filter("trial_number = 4")).collect()
    c = runs.sweep_counts(t).head()
    assert (c.n_complete, c.n_pruned, c.n_fail) == (3, 1, 1) and c.improvement == pytest.approx(0.2)


def test_prune_drops_less_informative(spark):
    corr = {("a", "b"): 0.9, ("b", "c"): 0.8, ("c", "d"): 0.2}
    assert selection.prune(["a", "b", "c", "d"], dict(a=0.1, b=0.3, c=0.2, d=0.0), corr, 0.7) == ["b", "d"]
    assert selection.prune(["b", "a"], dict(a=0.1, b=0.1), {("a", "b"): 0.9}, 0.7) == ["a"]


def test_integrity_checks(spark):
    rows = [(START + timedelta(hours=i), float(i % 2), float(i % 2), 1.0, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double, leak double, flat double, x double")
    assert integrity.min_rows(df).head().severity == "FAIL"
    assert integrity.constant_features(df, ["leak", "flat", "x"]).head().severity == "WARN"
    assert integrity.binary_class_balance(df).head().severity == "PASS"
    leak = integrity.label_leakage(integrity.leakage_pearson(df, ["leak", "flat", "x"]))
    assert leak.head().severity == "FAIL"
    assert integrity.worst_severity(leak).head().verdict == "FAIL"
    assert integrity.worst_severity(leak, allow_leakage=True).head().verdict == "WARN"
    a = integrity.data_fingerprint(df, ["y", "x"]).head().fingerprint
    assert a == integrity.data_fingerprint(df.repartition(7), ["y", "x"]).head().fingerprint
    changed = df.withColumn("x", F.when(F.col("x") == 7, 7.5).otherwise(F.col("x")))
    assert a != integrity.data_fingerprint(changed, ["y", "x"]).head().fingerprint
    assert integrity.dataset_sha(df, ["x"], [], "l", 1).head() == integrity.dataset_sha(changed, ["x"], [], "l", 1).head()
