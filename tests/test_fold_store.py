"""Fold windows read by month, additive cells against direct statistics, guards against the row form."""

import pytest
from pyspark.sql import functions as F

from barlab.operators import folds as fo
from barlab.operators.calibration import calibration_bins, expected_calibration_error
from barlab.operators.metrics import binary_metrics
from barlab.plans.foldstore import FoldStore


@pytest.fixture(scope="module")
def stored(spark):
    i = F.col("id")
    p = F.round(F.pmod(F.xxhash64("id"), F.lit(101)) / 100.0, 6)
    rows = spark.range(6000).select(
        F.timestamp_micros(i * 3_600_000_000 + 1_500_000).cast("timestamp_ntz").alias("ts"), p.alias("p"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100 < p).cast("int").alias("y"), F.when(i % 3 == 0, 2.0).otherwise(1.0).alias("interval_indicator"))
    window = spark.range(1).select(F.lit("1970-01-02 07:30:00").cast("timestamp_ntz").alias("start"), F.lit("1970-09-01").cast("timestamp_ntz").alias("end"))
    folds = fo.generate_folds(window, train_days=60, test_days=20, embargo_days=3, n_folds=5)  # bounds at half past seven
    return rows, folds, FoldStore(rows, folds)


def test_a_window_reads_its_months_only(stored):
    rows, folds, store = stored
    test = store.window(1, "test")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan and ">= 1970-03" in plan
    placed = fo.assign_folds(rows, folds)
    for k in range(5):
        for role in ("train", "test"):
            want = placed.filter((F.col("fold") == k) & (F.col("role") == role))
            key = [F.count("*"), F.min("ts"), F.max("ts"), F.sum("p")]
            assert tuple(store.window(k, role).agg(*key).first())[:3] == tuple(want.agg(*key).first())[:3]
    assert sum(store.window(k, "test").count() for k in range(5)) == placed.filter("role = 'test'").count() > 0


def test_cell_statistics_equal_direct_ones(stored):
    rows, folds, store = stored
    got = {(r.fold, r.role): r for r in store.scores("y", "p").collect()}
    placed = fo.assign_folds(rows, folds)
    direct = binary_metrics(placed, ["fold", "role"], "y", "p").collect()
    ece = {(r.fold, r.role): r.ece for r in expected_calibration_error(calibration_bins(placed, ["fold", "role"], "y", "p"), ["fold", "role"]).collect()}
    assert len(direct) == len(got) == 10
    for r in direct:
        g = got[r.fold, r.role]
        for c in ("n", "class1_rate", "pred_mean", "brier", "log_loss", "accuracy"):
            assert g[c] == pytest.approx(r[c], rel=1e-9)
        assert g.ece == pytest.approx(ece[r.fold, r.role], rel=1e-9)


def test_guards_equal_the_row_form(spark, stored):
    rows, folds, store = stored
    columns = ["fold", "n_train", "n_test", "train_classes", "test_classes", "skipped_reason"]
    key = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    days = folds.select("fold", *[F.date_trunc("day", c).cast("timestamp_ntz").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")])
    some = rows.filter(F.col("ts") < F.lit("1970-04-20")).withColumn("y", F.when(F.col("ts") < F.lit("1970-03-20"), F.lit(0)).otherwise(F.col("y")))
    assert key(FoldStore(some, days).guard("binary")) == key(fo.class_guard(some, days, "binary"))
    assert key(FoldStore(rows.limit(0), days).guard("binary")) == key(fo.class_guard(rows.limit(0), days, "binary"))
    served = store.guard("binary", served=F.col("interval_indicator") == 9.0).collect()
    assert {r.skipped_reason for r in served} == {"empty_test_window_after_interval_filter"}


def test_cells_are_far_fewer_than_rows_and_no_row_is_expanded(stored):
    rows, folds, store = stored
    cells = store.cells("y", "p")
    assert cells.count() < rows.count()
    assert cells.agg(F.sum("n")).first()[0] == rows.count()
    plan = store.window(2, "train")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_names_of_the_store_are_refused(spark, stored):
    rows, folds, _ = stored
    with pytest.raises(ValueError):
        FoldStore(rows.withColumn("_month", F.lit(1)), folds)
