"""Upserts that become visible at once or not at all."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barlab.sources.published import PublishedSignals

SCHEMA = "signal_id string, symbol string, ts timestamp_ntz, value double, seq int"


def batch(spark, rows):
    return spark.createDataFrame([(s, "x", datetime(2024, m, d), v, q) for s, m, d, v, q in rows], SCHEMA)


def content(table, commit=None):
    return sorted((r.signal_id, r.ts.month, r.ts.day, r.value) for r in table.read(commit).collect())


@pytest.fixture
def table(spark, tmp_path):
    t = PublishedSignals(spark, str(tmp_path / "signals"))
    assert t.read() is None and t.commits() == []
    assert t.upsert(batch(spark, [("007", 1, 1, 1.0, 0), ("007", 2, 1, 2.0, 0), ("b", 1, 1, 3.0, 0)]), order="seq") == 1
    return t


def test_upsert_replaces_keys_and_keeps_the_rest(spark, table):
    assert table.upsert(batch(spark, [("007", 1, 1, 9.0, 1), ("007", 1, 1, 8.0, 0), ("7", 1, 1, 5.0, 0), ("007", 1, 2, 4.0, 0)]), order="seq") == 2
    assert content(table) == [("007", 1, 1, 9.0), ("007", 1, 2, 4.0), ("007", 2, 1, 2.0), ("7", 1, 1, 5.0), ("b", 1, 1, 3.0)]
    assert content(table, 1) == [("007", 1, 1, 1.0), ("007", 2, 1, 2.0), ("b", 1, 1, 3.0)]
    again = batch(spark, [("007", 1, 1, 9.0, 1)])
    table.upsert(again, order="seq")
    assert content(table) == content(table, 2)


def test_a_write_that_fails_in_its_second_partition_changes_nothing(spark, table):
    before = content(table)
    bad = batch(spark, [("007", 1, 1, 70.0, 0), ("b", 1, 1, 80.0, 0)]).drop("seq")
    real, table._write_versions = table._write_versions, None

    def first_then_fail(rows):
        real(rows.filter("signal_id = '007'"))
        real(rows.filter("signal_id = 'b'").withColumn("value", F.when(F.col("value") > 0, F.raise_error(F.lit("disk gone")).cast("double")).otherwise(0.0)))

    table._write_versions = first_then_fail
    with pytest.raises(Exception, match="disk gone"):
        table.upsert(bad)
    assert content(table) == before and content(PublishedSignals(spark, table.path)) == before and table.commits() == [1]
    table._write_versions = real
    table.upsert(bad)
    assert ("007", 1, 1, 70.0) in content(table) and ("b", 1, 1, 80.0) in content(table)


def test_a_failure_before_the_commit_changes_nothing_and_a_second_writer_is_refused(spark, table):
    before = content(table)
    other = PublishedSignals(spark, table.path)
    real = other._commit

    def slow_commit(number, version):
        table.upsert(batch(spark, [("c", 3, 1, 1.0, 0)]), order="seq")  # meanwhile another writer commits
        real(number, version)

    other._commit = slow_commit
    with pytest.raises(Exception):
        other.upsert(batch(spark, [("007", 1, 1, 66.0, 0)]), order="seq")
    assert content(table) == sorted(before + [("c", 3, 1, 1.0)])


def test_another_schema_is_refused_before_writing(spark, table):
    with pytest.raises(ValueError, match="differ"):
        table.upsert(batch(spark, [("b", 1, 1, 1.0, 0)]).withColumn("value", F.lit("x")), order="seq")
    assert table.commits() == [1]


def test_only_the_manifests_partitions_are_read(spark, table):
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "BroadcastHashJoin" in plan
