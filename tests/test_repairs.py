"""Upsert, fingerprints, groups without trades, missing features and grid bounds on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barlab.operators import integrity, pnl
from barlab.operators.metrics import balanced_weights
from barlab.plans.models import assembler
from barlab.sources import signals

SCHEMA = "signal_id string, symbol string, ts timestamp_ntz, value double, seq long"


def batch(spark, rows):
    return spark.createDataFrame([(i, "A", datetime(2024, m, d), v, s) for i, m, d, v, s in rows], SCHEMA)


def stored(spark, path):
    return sorted((r.signal_id, str(r.ts), r.value) for r in spark.read.schema("signal_id string, symbol string, ts timestamp_ntz, value double, period string").parquet(path).collect())


def files(path, part):
    return {p.name: p.read_bytes() for p in path.glob(f"{part}/*.parquet")}


def test_upsert_keeps_ids_that_look_like_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    signals.upsert(spark, batch(spark, [("007", 1, 1, 1.0, 0), ("7", 1, 1, 2.0, 0)]), path, order="seq")
    signals.upsert(spark, batch(spark, [("007", 1, 1, 3.0, 0)]), path, order="seq")
    assert stored(spark, path) == [("007", "2024-01-01 00:00:00", 3.0), ("7", "2024-01-01 00:00:00", 2.0)]


def test_upsert_takes_the_last_of_a_batch_and_leaves_other_partitions_alone(spark, tmp_path):
    path = tmp_path / "t"
    signals.upsert(spark, batch(spark, [("a", 1, 1, 1.0, 0), ("a", 2, 1, 1.0, 0), ("b", 1, 1, 1.0, 0)]), str(path), order="seq")
    before = files(path, "signal_id=a/period=2024-02"), files(path, "signal_id=b/period=2024-01")
    signals.upsert(spark, batch(spark, [("a", 1, 1, 5.0, 2), ("a", 1, 1, 4.0, 1), ("a", 1, 2, 9.0, 0)]), str(path), order="seq")
    assert (files(path, "signal_id=a/period=2024-02"), files(path, "signal_id=b/period=2024-01")) == before and all(before)
    assert [v for i, t, v in stored(spark, str(path)) if i == "a"] == [5.0, 9.0, 1.0]
    assert {p.name for p in tmp_path.iterdir()} == {"t"}


def test_upsert_raises_on_another_schema_and_changes_nothing(spark, tmp_path):
    path = tmp_path / "t"
    signals.upsert(spark, batch(spark, [("a", 1, 1, 1.0, 0), ("a", 1, 2, 2.0, 0)]), str(path), order="seq")
    before = files(path, "signal_id=a/period=2024-01")
    with pytest.raises(ValueError, match="columns differ"):
        signals.upsert(spark, batch(spark, [("a", 1, 1, 1.0, 0)]).withColumn("value", F.col("value").cast("string")), str(path), order="seq")
    assert files(path, "signal_id=a/period=2024-01") == before


def test_fingerprint_tells_separators_and_nulls_apart(spark):
    def mark(a, b):
        df = spark.createDataFrame([(datetime(2024, 1, 1), a, b)], "ts timestamp_ntz, a string, b string")
        return integrity.data_fingerprint(df, ["a", "b"]).first().fingerprint

    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("null", "c"), ("n", "c"), ("1:a", "c"), ("", "c")]
    assert len({mark(*r) for r in rows}) == len(rows)


def test_groups_without_trades_keep_their_rows(spark):
    rows = [(1, "2", True, 5.0), (1, "2", True, 90.0), (2, "1", False, 0.0)]
    trades = spark.createDataFrame(rows, "fold int, pred string, traded boolean, gross_bps double")
    out = {(r.fold, r.regime): r for r in pnl.cost_regime_metrics(trades, ["fold"]).collect()}
    assert len(out) == 6
    idle = out[2, "realistic"]
    assert (idle.n_trades, idle.gross_mean, idle.net_total, idle.profitable) == (0, None, 0.0, 0.0)
    assert out[1, "realistic"].profitable == 1.0
    flagged = trades.withColumns({r: F.lit(True) for r in pnl.REGIMES})
    cuts = pnl.regime_subcuts(flagged, ["fold"]).where("fold = 2").collect()
    assert len(cuts) == len(pnl.REGIMES) and all(r.n == 0 and r.caveat == 1.0 and r.failing == 0.0 for r in cuts)


def test_missing_features_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double")
    with pytest.raises(Exception, match="(?i)null"):
        assembler(["a", "b"]).transform(df).collect()


def test_class_weights_do_not_shuffle_rows_by_class(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    assert sorted({(r.y, round(r.weight, 4)) for r in balanced_weights(df, "y").collect()}) == [(0, round(100 / 180, 4)), (1, 5.0)]
    plan = balanced_weights(df, "y")._sc._jvm.PythonSQLUtils.explainString(balanced_weights(df, "y")._jdf.queryExecution(), "simple")
    assert "BroadcastHashJoin" in plan


def test_cut_points_reach_rows_without_a_shuffle_on_the_group_alone(spark):
    from barlab.operators.ranks import quantiles

    df = spark.range(4000).select((F.col("id") % 2).cast("string").alias("symbol"), (F.col("id") * 37 % 1009).cast("double").alias("x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        train = df.withColumn("role", F.lit("train")).withColumn("y", F.col("x"))
        rows = train.unionByName(train.withColumn("role", F.lit("test")))
        out = pnl.add_regimes(rows, ["symbol"], "x", "y")
        plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
        got = quantiles(df, ["symbol"], "x", [0.5], "q").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    top = plan[:plan.index("Filter")]
    assert "_salt" in top and out.count() == 4000
    assert {r.symbol for r in got} == {"0", "1"}


def test_per_model_metrics_count_every_row_and_gather_none_by_its_id(spark, tmp_path):
    """Line items that share all the columns of the id are rows of their own, as in the SQL."""
    from barlab.catalog import ORACLES, QUERIES
    from tests import oracle

    source = "/root/testdata/sf0.001/lineitem.parquet"
    li = spark.read.parquet(source)
    li.unionByName(li.withColumn("l_quantity", 51 - F.col("l_quantity"))).coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    query = QUERIES["g45_per_model_metrics"]
    same, note = oracle.compare(spark, oracle.connect(str(tmp_path)), query, ORACLES["g45_per_model_metrics"], str(tmp_path))
    assert same, note
    assert "l_linenumber" not in query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
