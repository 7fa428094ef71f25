from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.operators import align, asof
from barlab.operators.asof import asof_wide
from barlab.plans.dataset import check_embargo
from barlab.sources.bars import bar_grid, grid_between
from barlab.sources import store

START = datetime(2024, 1, 1)


def series(spark, name, n, seed, hours=240):
    rng = np.random.default_rng(seed)
    at = sorted(rng.choice(hours * 3600, n, replace=False))
    return [(name, START + timedelta(seconds=int(s)), float(rng.normal())) for s in at]


@pytest.mark.parametrize("block", [5, 4096])
@pytest.mark.parametrize("cap", [None, 1, 7.5, 48])
def test_asof_matches_merge_asof(spark, cap, block, monkeypatch):
    monkeypatch.setattr(asof, "BLOCK_SLOTS", block)
    rows = series(spark, "f", 60, 1) + series(spark, "g", 9, 2)
    df = spark.createDataFrame(rows, "feature_name string, ts timestamp_ntz, value double")
    grid = bar_grid(spark, START, START + timedelta(hours=240), "1h")
    got = asof_wide(grid, df, {"f": cap, "g": cap}, 3600, F.lit(START).cast("timestamp_ntz")).toPandas().sort_values("ts")
    slots = pd.DataFrame({"ts": pd.date_range(START, periods=240, freq="1h")}).astype("datetime64[us]")
    for name in ("f", "g"):
        src = pd.DataFrame([(t, v) for n, t, v in rows if n == name], columns=["ts", "value"]).astype({"ts": "datetime64[us]"})
        tol = pd.Timedelta(hours=cap) if cap else None
        want = pd.merge_asof(slots, src, on="ts", tolerance=tol)["value"].to_numpy()
        np.testing.assert_array_equal(got[name].to_numpy(float), want)


def test_asof_cap_is_inclusive_and_exact_needs_equal_stamp(spark):
    df = spark.createDataFrame([("f", START, 1.0), ("e", START, 2.0)], "feature_name string, ts timestamp_ntz, value double")
    grid = bar_grid(spark, START, START + timedelta(hours=4), "1h")
    got = asof_wide(grid, df, {"f": 2, "e": 2}, 3600, F.lit(START).cast("timestamp_ntz"), exact=["e"]).orderBy("ts").collect()
    assert [r.f for r in got] == [1.0, 1.0, 1.0, None]
    assert [r.e for r in got] == [2.0, None, None, None]


def test_grid_is_half_open(spark):
    assert bar_grid(spark, START, START + timedelta(hours=3), "15m").count() == 12
    assert bar_grid(spark, START, START + timedelta(minutes=50), "15m").count() == 4
    assert bar_grid(spark, START, START, "1h").count() == 0
    b = spark.createDataFrame([("a", START, START + timedelta(days=3))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    got = grid_between(b, "1m")
    assert got.count() == 4320 == got.distinct().count()
    with pytest.raises(ValueError):
        bar_grid(spark, START, START, "7m")


def test_bundle_fails_on_missing_symbol(spark):
    b = spark.createDataFrame([("a", "1h", START)], "symbol string, interval string, start_time timestamp_ntz")
    assert store.market_bundle(b, ["a"], "1h", START, START + timedelta(days=1)).count() == 1
    with pytest.raises(ValueError, match="no 1h bars for z"):
        store.market_bundle(b, ["a", "z"], "1h", START, START + timedelta(days=1))


def test_stack_rejects_different_columns(spark):
    a, b = spark.range(2).withColumn("x", F.lit(1)), spark.range(2).withColumn("z", F.lit(1))
    with pytest.raises(ValueError, match="extra=\\['z'\\]"):
        align.stack_intervals([("1h", a), ("15m", b)])
    assert align.stack_intervals([("1h", a), ("15m", a)]).groupBy("interval_indicator").count().count() == 2


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert store.clean(df).filter("v IS NULL").count() == 1


def test_store_round_trip_prunes_by_symbol(spark, tmp_path):
    rows = [("f", 1, s, "1h", START + timedelta(hours=i), float(i)) for s in ("a", "b") for i in range(5)]
    df = spark.createDataFrame(rows, "feature_name string, version int, symbol string, interval string, ts timestamp_ntz, value double")
    store.write_table(df, str(tmp_path / "s"))
    back = store.read_table(spark, str(tmp_path / "s"), "feature_values")
    one = store.read_feature(back, "f", 1, "a", "1h", START, START + timedelta(hours=3))
    assert [r.value for r in one.orderBy("ts").collect()] == [0.0, 1.0, 2.0]
    assert "PartitionFilters: [isnotnull(symbol" in one._jdf.queryExecution().toString()


def test_embargo_covers_label_horizon():
    check_embargo("long_win_tb", "1h", 1)
    with pytest.raises(ValueError):
        check_embargo("long_win_tb", "4h", 1)
