from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators.folds import generate_folds
from barlab.plans import models as mo
from barlab.plans.stacking import oof_matrix, train_stacker
from barlab.plans.walkforward import run_walk_forward

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    out = []
    for i in range(600):
        a, b = rng.normal(size=2)
        out.append(("x", START + timedelta(hours=i), float(a), float(b), float(rng.random() < 1 / (1 + np.exp(-2 * a)))))
    return spark.createDataFrame(out, "symbol string, ts timestamp_ntz, a double, b double, y double").cache()


def test_walk_forward_learns_and_covers_test_windows(spark, rows):
    window = spark.createDataFrame([(START, START + timedelta(days=25))], "start timestamp_ntz, end timestamp_ntz")
    folds = generate_folds(window, 10, 5, 1, 3)
    wf = run_walk_forward(rows, folds, mo.ModelSpec("t", "binary", ("a", "b"), params={"maxIter": 4, "maxDepth": 2}))
    n = folds.count()
    assert n == 2 and wf.oof.count() == 2 * 120
    s = wf.summary().head()
    assert s.n_folds_valid == 2 and s.primary_mean > 0.65
    assert {r.metric for r in wf.metrics.select("metric").distinct().collect()} >= {"auc", "log_loss", "accuracy", "ci_max_abs_diff"}
    assert wf.last_model() is wf.models[1]


def test_adversarial_auc_sees_covariate_shift(spark, rows):
    half = START + timedelta(hours=300)
    a, b = rows.filter(F.col("ts") < half), rows.filter(F.col("ts") >= half)
    moved = b.withColumn("a", F.col("a") + 3)
    same = mo.adversarial_auc(a, b, ["a", "b"], ["ts"], max_iter=2).head().adversarial_auc
    far = mo.adversarial_auc(a, moved, ["a", "b"], ["ts"], max_iter=2).head().adversarial_auc
    assert abs(same - 0.5) < 0.12 < 0.4 < far - 0.5 + 0.01


def test_stacker_guards(spark):
    oof = spark.createDataFrame([("m", 0, START, 0.1), ("m", 1, START, 0.4), ("n", 0, START, 0.2), ("m", 0, START + timedelta(hours=1), 0.3)],
                                "model string, fold int, ts timestamp_ntz, prediction double")
    labels = spark.createDataFrame([(START, 1.0), (START + timedelta(hours=1), 0.0)], "ts timestamp_ntz, y double")
    got = oof_matrix(oof, labels, ["m", "n"]).collect()
    assert len(got) == 1 and got[0].m == 0.4
    with pytest.raises(ValueError, match="too few"):
        train_stacker(oof_matrix(oof, labels, ["m", "n"]), ["m", "n"], "binary")
    with pytest.raises(ValueError):
        train_stacker(labels, [], "multiclass")


def test_each_class_stops_on_its_own(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(1500):
        a, b = rng.normal(size=2)
        y = 2 if a > 0.8 else int(rng.random() < 0.5)  # class 2 is easy, 0 and 1 are noise
        out.append((START + timedelta(hours=i), float(a), float(b), float(y)))
    rows = spark.createDataFrame(out, "ts timestamp_ntz, a double, b double, y double")
    spec = mo.ModelSpec("t", "multiclass", ("a", "b"), params={"maxIter": 12, "maxDepth": 2}, early_stopping=0.2, interval="4h")
    model = mo.fit(rows, spec)
    trees = [m.getNumTrees for m in model.stages[-1].models]
    assert len(trees) == 3 and min(trees) < 12 and len(set(trees)) > 1
    got = mo.predict(model, rows, spec).select("y", "probs").collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 and len(r.probs) == 3 for r in got)
    assert np.mean([np.argmax(r.probs) == 2 for r in got if r.y == 2]) > 0.9
    few = mo.fit(rows.limit(30), spec)  # too few rows for the carve: all are used, no class stops
    assert [m.getNumTrees for m in few.stages[-1].models] == [12, 12, 12]


def test_fits_side_by_side_keep_their_own_local_properties(spark, monkeypatch):
    import threading

    from pyspark.ml import classification, tuning

    meet = threading.Barrier(3, timeout=60)

    def task(i):
        spark.sparkContext.setLocalProperty("mine", str(i))
        meet.wait()
        got = spark.sparkContext.getLocalProperty("mine")
        meet.wait()
        return got

    assert mo.concurrently(spark, [lambda i=i: task(i) for i in range(3)]) == ["0", "1", "2"]

    threads, pool = [], tuning.ThreadPool
    for module in (classification, tuning):  # Spark's own estimators share one set of properties between their threads
        monkeypatch.setattr(module, "ThreadPool", lambda processes: (threads.append(processes), pool(processes=processes))[1])
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, float(i % 3 + rng.normal()), float(rng.normal()), float(i % 3)) for i in range(240)], "id long, a double, b double, y double")
    models = mo.fit_ensemble(rows, mo.ModelSpec("e", "multiclass", ("a", "b"), params={"maxIter": 2, "maxDepth": 2}), folds=2)
    probas = mo.predict_ensemble(models, rows, ["id", "y"])
    assert probas.count() == 240 * 3 * 3
    assert mo.fit_meta_label(probas, ["id"], folds=2) is not None
    assert set(threads) == {1}
