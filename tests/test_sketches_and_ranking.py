"""Quantile sketches against exact ranks, and positions of rows however they cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import frames, ranks, sketch
from barlab.operators.frames import number_rows, with_range


def shapes(n=20000):
    rng = np.random.default_rng(3)
    return {
        "skewed": rng.lognormal(0, 3, n), "tied": rng.integers(0, 7, n).astype(float), "one": np.full(n, 4.5),
        "heavy": np.where(rng.random(n) < 0.9, 1.0, rng.normal(size=n)), "sorted": np.arange(n, dtype=float),
    }


@pytest.fixture(scope="module")
def samples(spark):
    data = shapes()
    rows = [(g, float(v)) for g, values in data.items() for v in values] + [("few", 3.0), ("few", 1.0), ("none", None)]
    return data, spark.createDataFrame(rows, "g string, v double").repartition(6).cache()


def rank_distance(values, got, p):
    """How far p lies from the ranks that ``got`` has in ``values``."""
    low, high = np.mean(values < got), np.mean(values <= got)
    return max(0.0, low - p, p - high)


@pytest.mark.parametrize("k", [50, 400])
def test_sketch_quantiles_stay_within_the_stated_rank_error(samples, k):
    data, df = samples
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = {r.g: r.q for r in ranks.approx_quantiles(df, ["g"], "v", probs, "q", k).collect()}
    assert set(got) == {*data, "few"}
    for g, values in data.items():
        assert max(rank_distance(values, x, p) for x, p in zip(got[g], probs)) <= 2 * sketch.rank_error(k)
        assert set(got[g]) <= set(values.tolist())


def test_sketches_merge_to_coarser_groups(samples):
    data, df = samples
    parts = sketch.quantile_sketch(df.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(5))), ["g", "part"], "v")
    merged = sketch.merge_sketches(parts, ["g"]).select("g", sketch.sketch_quantiles(F.col("sketch"), [0.3]).alias("q"),
                                                        sketch.sketch_rank(F.col("sketch"), F.lit(1.0)).alias("r"))
    for row in merged.collect():
        if row.g in data:
            assert rank_distance(data[row.g], row.q[0], 0.3) <= 2 * sketch.rank_error()
            assert abs(row.r - np.mean(data[row.g] <= 1.0)) <= 2 * sketch.rank_error()


def test_slot_sample_depends_on_the_values_alone(spark):
    df = spark.range(50000).select((F.col("id") % 2).alias("g"), (F.col("id") / 7).alias("v"))
    key = lambda d: sorted(map(tuple, d.collect()))
    a = key(sketch.slot_sample(df.repartition(2), ["g"], ["v"], 64).drop("_seen"))
    b = key(sketch.slot_sample(df.union(df).repartition(7, "v"), ["g"], ["v"], 64).drop("_seen"))
    assert a == b and len(a) == 128
    assert abs(np.mean([v for g, v in a]) * 7 / 25000 - 1) < 0.25


def test_exact_quantiles_do_not_depend_on_the_cuts(samples, monkeypatch):
    data, df = samples
    monkeypatch.setattr(ranks, "_PICK", 2)
    probs = [0.05, 0.5, 0.937]
    got = {r.g: r.q for r in ranks.quantiles(df, ["g"], "v", probs, "q").collect()}
    for g, values in data.items():
        assert got[g] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)


def positions(df, keys, order, **kw):
    return sorted(tuple(r) for r in number_rows(df, keys, order, "rn", "total", **kw).select(*df.columns, "rn", "total").collect())


def busy_day(spark, n=20000):
    """90 % of the rows have one symbol and lie within one second of one day."""
    i = F.col("id")
    busy = i % 10 < 9
    ts = F.when(busy, F.lit(1_700_000_000_000_000) + i).otherwise(F.lit(1_700_000_000_000_000) + (i - n) * 3_600_000_000)
    return spark.range(n).select(F.when(busy, "A").otherwise(F.concat(F.lit("B"), i % 3)).alias("symbol"), F.timestamp_micros(ts).alias("ts"), i.alias("id")).repartition(5)


def test_positions_when_most_rows_share_a_day(spark):
    df = busy_day(spark)
    want, at = [], {}
    rows = sorted(map(tuple, df.collect()))
    total = {s: sum(r[0] == s for r in rows) for s in {r[0] for r in rows}}
    for s, ts, i in rows:
        want.append((s, ts, i, at.get(s, 0), total[s]))
        at[s] = at.get(s, 0) + 1
    assert positions(df, ["symbol"], ["ts", "id"], range_rows=500) == want
    assert positions(df, ["symbol"], ["ts", "id"]) == want


def test_ranges_follow_the_rows(spark):
    """No range holds more than a few times its share, though one day has 90 % of all rows."""
    df = with_range(busy_day(spark), ["symbol", "ts", "id"], "part", range_rows=500)
    sizes = [r["count"] for r in df.groupBy("part").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 8 * 500
    order = [r.part for r in df.orderBy("symbol", "ts", "id").collect()]
    assert order == sorted(order)


def test_positions_without_keys_with_ties_and_without_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (0, None), (None, "z"), (1, "x")], "a int, b string")
    got = sorted((r.rn, r.a, r.b) for r in number_rows(df, [], ["a", "b"], "rn").collect())
    assert [g[1:] for g in got] == [(None, "z"), (0, None), (1, "x"), (1, "x"), (1, "y")]
    assert number_rows(df.limit(0), ["a"], ["b"], "rn", "t").collect() == []
    many = spark.range(3000).select((F.col("id") % 2).alias("a"), F.lit(1).alias("b"))
    got = number_rows(many, ["a"], ["b"], "rn", range_rows=10)
    assert sorted((r.a, r.rn) for r in got.collect()) == [(a, i) for a in (0, 1) for i in range(1500)]


def test_windows_do_not_span_a_day(spark):
    plan = number_rows(busy_day(spark), ["symbol"], ["ts", "id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("_slice" in w for w in windows) and "to_date" not in plan
