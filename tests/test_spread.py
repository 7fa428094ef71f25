"""Lookups that cost the logarithm of a table's length, and joins that spread the rows of one key."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barlab.operators.attach import below
from barlab.operators.calibration import zones
from barlab.operators.folds import assign_folds
from barlab.operators.frames import with_range


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8])
def test_below_counts_smaller_entries(spark, n):
    rows = spark.range(-1, 20).withColumn("cuts", F.array(*[F.lit(2 * i) for i in range(n)]).cast("array<bigint>"))
    got = below(rows, "cuts", F.col("id"), 9, "k").collect()
    assert [r.k for r in got] == [sum(2 * i < r.id for i in range(n)) for r in got]
    assert {r.k for r in below(rows.withColumn("cuts", F.lit(None).cast("array<bigint>")), "cuts", F.col("id"), 9, "k").collect()} == {0}


def test_range_lookups_read_the_bounds_in_place(spark):
    """A lambda function would copy all bounds with every row."""
    rows = spark.range(2000).select(F.lit("a").alias("key"), (F.col("id") % 100).alias("x"))
    sliced = with_range(rows, ["key", "x"], range_rows=64)
    assert "lambda" not in sliced.select("_slice").filter("_slice is not null")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert not sliced.schema["_slice"].nullable
    slices = sliced.groupBy("_slice").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_slice").collect()
    assert len(slices) > 1 and all(a.hi < b.lo for a, b in zip(slices, slices[1:]))


def test_rows_of_one_key_reach_their_folds_in_many_tasks(spark):
    day = lambda k: F.lit(datetime(2024, 1, k)).cast("timestamp_ntz")
    rows = spark.range(4000).select(F.when(F.col("id") % 2 < 2, "a").alias("symbol"), "id", day(12).alias("ts"))
    folds = spark.range(2).filter("id = 0").select(F.when(F.col("id") % 2 < 2, "a").alias("symbol"), F.lit(0).alias("fold"), day(1).alias("train_start"), day(9).alias("train_end"),
                                  day(10).alias("test_start"), day(20).alias("test_end"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for placed in (assign_folds(rows, folds, ["symbol"]), zones(rows, folds, ["symbol"])):
            sizes = placed.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in sizes) == 4000
            assert max(r["count"] for r in sizes) < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_maps_do_not_hinder_the_fold_join(spark):
    rows = spark.range(3).select(F.lit("a").alias("symbol"), F.create_map(F.lit("k"), "id").alias("m"), F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz").alias("ts"))
    day = lambda k: F.lit(datetime(2024, 1, k)).cast("timestamp_ntz")
    folds = spark.range(1).select(F.lit("a").alias("symbol"), F.lit(0).alias("fold"), day(1).alias("test_start"), day(3).alias("test_end"))
    assert assign_folds(rows, folds, ["symbol"], roles=("test",)).count() == 3
