"""The report against the single operators, with folds without predictions and groups without folds."""

import pytest
from pyspark.sql import functions as F

from barlab.operators import calibration as cal
from barlab.operators.metrics import binary_metrics
from barlab.operators.report import analysis_report, report_cells


@pytest.fixture(scope="module")
def inputs(spark):
    i = F.col("id")
    p = F.round(F.pmod(F.xxhash64("id"), F.lit(41)) / 40.0, 6)
    rows = spark.range(4000).select(
        F.when(i % 10 < 8, "A").otherwise("B").alias("symbol"), F.timestamp_micros(i * 3_600_000_000).cast("timestamp_ntz").alias("ts"),
        F.when(i % 97 != 0, p).alias("predicted"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > p * 2).cast("double").alias("actual"))
    folds = spark.createDataFrame(
        [("A", k, f"1970-01-{1 + 2 * k:02d}", f"1970-02-{1 + k:02d}", f"1970-02-{4 + 5 * k:02d}", f"1970-02-{9 + 5 * k:02d}") for k in range(3)] +
        [("B", 0, "1970-01-01", "1970-01-20", "1971-01-01", "1971-02-01")],
        "symbol string, fold int, train_start string, train_end string, test_start string, test_end string")
    stamps = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")]
    return rows.repartition(4).cache(), folds.select("symbol", "fold", *stamps)


def test_sections_equal_the_single_operators(spark, inputs):
    rows, folds = inputs
    own = spark.createDataFrame([("A", 0, 0.61), ("A", 2, 0.4)], "symbol string, fold int, own_auc double")
    report = {(r.symbol, r.part, r.section): r for r in analysis_report(rows, folds, own, ["symbol"]).collect()}
    valid = rows.filter("predicted is not null")
    near = lambda got, want: all(getattr(got, c) == pytest.approx(want[c]) for c in ("n", "brier", "log_loss", "accuracy", "auc"))
    for r in binary_metrics(valid, ["symbol"]).collect():
        assert near(report[r.symbol, "overall", "all"], r)
    for r in cal.per_month_metrics(valid, ["symbol"]).collect():
        assert near(report[r.symbol, "month", r.month], r)
    for r in cal.post_window_metrics(valid, folds, ["symbol"]).collect():
        assert near(report[r.symbol, r.zone, "all"], r)
        assert report[r.symbol, "ece", r.zone].ece == pytest.approx(r.ece)
    saved = cal.per_fold_saved_vs_own(valid, folds, own, ["symbol"]).collect()
    assert len(saved) == 4
    for r in saved:
        got = report[r.symbol, "fold", str(r.fold)]
        assert (got.n, got.note, got.own_auc) == (r.n, r.note, r.own_auc) and got.auc == pytest.approx(r.saved_auc)
    bins = cal.calibration_bins(valid, ["symbol"]).withColumn("section", F.concat(F.lit("overall "), cal.bin_label())).collect()
    for r in bins:
        got = report[r.symbol, "calibration", r.section]
        assert got.n == r["count"] and got.mean_pred == pytest.approx(r.mean_pred) and got.actual_rate == pytest.approx(r.actual_rate)
    assert {k[1] for k in report} == {"overall", "month", "fold", "last_fold", "post", "calibration", "ece"}


def test_cells_are_bounded_by_scores_not_rows(inputs):
    rows, folds = inputs
    cells = report_cells(rows, folds, ["symbol"])
    assert cells.agg(F.sum("_n")).first()[0] == rows.filter("predicted is not null").count()
    assert cells.count() < rows.count() / 3


def test_report_without_keys_and_without_rows(spark, inputs):
    rows, folds = inputs
    one = folds.filter("symbol = 'A'").drop("symbol")
    own = spark.createDataFrame([(0, 0.5)], "fold int, own_auc double")
    parts = {r.part for r in analysis_report(rows.drop("symbol"), one, own).collect()}
    assert parts == {"overall", "month", "fold", "last_fold", "post", "calibration", "ece"}
    empty = analysis_report(rows.limit(0), folds, own.withColumn("symbol", F.lit("A")), ["symbol"]).collect()
    assert {(r.part, r.n) for r in empty} == {("fold", 0)} and len(empty) == 4
