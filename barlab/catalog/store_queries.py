"""Store scans, alignment, as-of joins, grids and stacking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from barlab.catalog.inputs import (
    GLOBAL_FEATURES, REGISTRY_CTE, STORE_FEATURES, barrier_cte, atr_cte, event_bars, event_bars_cte, registry,
    rounded, store_cte, store_values, table,
)
from barlab.catalog.bars_queries import PAIR_SQL, pctrank_sql
from barlab.catalog.registry import query
from barlab.functions.times import to_naive_utc
from barlab.operators import align
from barlab.operators.asof import asof_wide
from barlab.operators.features import pctrank_label
from barlab.plans.dataset import DatasetSpec, coverage, load_dataset, load_matrix, load_stacked
from barlab.sources import store as st
from barlab.sources.bars import bar_grid, grid_between

START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)
SQL_RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'"
USABLE = "status = 'registered' AND (label_direction IS NULL OR label_direction <> 'forward')"


@query("s01_list_input_features", f"""WITH {REGISTRY_CTE}
    SELECT feature_name, version, family, max_ffill_age_hours, ffill_policy FROM registry
    WHERE {USABLE} AND feature_name NOT IN (SELECT p_brand || ' ' || p_name FROM part WHERE p_size = 50)""")
def s01(spark, d):
    reg = registry(spark, d)
    excluded = table(spark, d, "part").filter("p_size = 50").select(F.concat_ws(" ", "p_brand", "p_name").alias("feature_name"))
    return st.list_input_features(reg, excluded).select(
        "feature_name", "version", "family", "max_ffill_age_hours", "ffill_policy")


@query("s01_latest_versions", f"""WITH {REGISTRY_CTE}
    SELECT feature_name, max(version) AS version, arg_max(family, version) AS family,
           arg_max(ffill_policy, version) AS ffill_policy
    FROM registry WHERE {USABLE} GROUP BY 1""")
def s01_latest(spark, d):
    return st.latest_versions(st.list_input_features(registry(spark, d))).select(
        "feature_name", "version", "family", "ffill_policy")


@query("s02_read_feature", f"""WITH {event_bars_cte()}, {store_cte()}
    SELECT ts, round(value, 6) AS value FROM store
    WHERE feature_name = 'atr_14' AND version = 1 AND symbol = 'click' AND interval = '1h' AND {SQL_RANGE}""")
def s02(spark, d):
    one = st.read_feature(store_values(spark, d), "atr_14", 1, "click", "1h", START, END)
    return one.select("ts", rounded("value").alias("value"))


@query("s03_read_features_batch", f"""WITH {event_bars_cte()}, {store_cte()}
    SELECT feature_name, symbol, ts, round(value, 6) AS value FROM store
    WHERE symbol IN ('click', 'view') AND interval = '1h' AND {SQL_RANGE}""")
def s03(spark, d):
    rows = st.read_features(store_values(spark, d), {n: 1 for n in STORE_FEATURES}, ["click", "view"], "1h", START, END)
    return rows.select("feature_name", "symbol", "ts", rounded("value").alias("value"))


@query("s04_read_global_features", f"""WITH {event_bars_cte()}, {store_cte()}
    SELECT feature_name, ts, value FROM store WHERE symbol = '' AND interval = '' AND {SQL_RANGE}""")
def s04(spark, d):
    rows = st.read_global_features(store_values(spark, d), {n: 1 for n in GLOBAL_FEATURES}, START, END)
    return rows.select("feature_name", "ts", "value")


@query("s05_read_market_data", f"""WITH {event_bars_cte()}
    SELECT symbol, ts, close_price, trade_count FROM bars WHERE symbol = 'view' AND {SQL_RANGE}""")
def s05(spark, d):
    return st.read_market_data(event_bars(spark, d), "view", "1h", START, END).select(
        "symbol", F.col("start_time").alias("ts"), "close_price", "trade_count")


@query("s06_market_bundle", f"""WITH {event_bars_cte()}
    SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars
    WHERE symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' - INTERVAL 8 DAY
      AND ts < TIMESTAMP '2024-01-15' + INTERVAL 8 DAY GROUP BY 1""")
def s06(spark, d):
    bundle = st.market_bundle(event_bars(spark, d), ["click", "view"], "1h", datetime(2024, 1, 10), datetime(2024, 1, 15))
    return bundle.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first_ts"),
                                        F.max("start_time").alias("last_ts"))


@query("p01_classify_features", f"""WITH {REGISTRY_CTE}
    SELECT feature_name, version,
      CASE WHEN coalesce(len(symbols), 0) > 0 AND coalesce(len(intervals), 0) > 0
           THEN CASE WHEN list_contains(symbols, 'click') AND list_contains(intervals, '1h') THEN 'per_bar' ELSE 'skip' END
           ELSE 'global' END AS scope
    FROM registry""")
def p01(spark, d):
    return align.classify_features(registry(spark, d), "click", "1h").select("feature_name", "version", "scope")


GRID_SQL = """grid AS (SELECT symbol, unnest(generate_series(lo, hi - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts
      FROM (SELECT symbol, min(ts) AS lo, max(ts) + INTERVAL 1 HOUR AS hi FROM bars GROUP BY 1))"""


def _grid(bars):
    bounds = bars.groupBy("symbol").agg(
        F.min("start_time").alias("start"), (F.max("start_time") + F.expr("INTERVAL 1 HOUR")).alias("end"))
    return grid_between(bounds, "1h")


@query("p02_bar_grid", f"WITH {event_bars_cte()}, {GRID_SQL} SELECT symbol, ts FROM grid")
def p02(spark, d):
    return _grid(event_bars(spark, d)).select("symbol", "ts")


@query("p03_long_to_wide", f"""WITH {event_bars_cte()}, {store_cte()}
    SELECT symbol, ts, round(max(value) FILTER (feature_name = 'log_return_24'), 6) AS log_return_24,
      round(max(value) FILTER (feature_name = 'volume_zscore_24'), 6) AS volume_zscore_24,
      round(max(value) FILTER (feature_name = 'atr_14'), 6) AS atr_14
    FROM store WHERE interval = '1h' GROUP BY 1, 2""")
def p03(spark, d):
    wide = align.long_to_wide(store_values(spark, d).filter("interval = '1h'"), STORE_FEATURES)
    return wide.select("symbol", "ts", *[rounded(c).alias(c) for c in STORE_FEATURES])


@query("p04_align_exact", f"""WITH {event_bars_cte()}, {GRID_SQL}
    SELECT symbol, ts, close_price FROM grid LEFT JOIN bars USING (symbol, ts)""")
def p04(spark, d):
    bars = event_bars(spark, d)
    wide = bars.select("symbol", F.col("start_time").alias("ts"), "close_price")
    return align.align_exact(_grid(bars), wide)


WIDE_SQL = f"""{event_bars_cte()}, {GRID_SQL}, {store_cte()}, w AS (
      SELECT symbol, ts, max(value) FILTER (feature_name = 'log_return_24') AS log_return_24,
        max(value) FILTER (feature_name = 'volume_zscore_24') AS volume_zscore_24,
        max(value) FILTER (feature_name = 'atr_14') AS atr_14, CAST(NULL AS DOUBLE) AS never
      FROM store WHERE interval = '1h' GROUP BY 1, 2),
    m AS (SELECT symbol, ts, log_return_24, volume_zscore_24, atr_14, never FROM grid LEFT JOIN w USING (symbol, ts))"""


def _matrix(spark, d):
    bars = event_bars(spark, d)
    wide = align.long_to_wide(store_values(spark, d, bars).filter("interval = '1h'"), STORE_FEATURES)
    return align.align_exact(_grid(bars), wide).withColumn("never", F.lit(None).cast("double"))


COVERAGE_SQL = """cov AS (
      SELECT symbol, feature_name, n_slots, n_non_null, round(n_non_null / n_slots, 4) AS pct_non_null FROM (
        SELECT symbol, count(*) AS n_slots, count(log_return_24) AS log_return_24, count(volume_zscore_24) AS volume_zscore_24,
               count(atr_14) AS atr_14, count(never) AS never FROM m GROUP BY 1)
      UNPIVOT (n_non_null FOR feature_name IN (log_return_24, volume_zscore_24, atr_14, never)))"""


@query("p05_drop_incomplete", f"""WITH {WIDE_SQL}
    SELECT symbol, count(*) AS n_slots, count(*) FILTER (ok) AS n_kept, count(*) FILTER (NOT ok) AS n_dropped
    FROM (SELECT *, log_return_24 IS NOT NULL AND volume_zscore_24 IS NOT NULL AND atr_14 IS NOT NULL AS ok FROM m)
    GROUP BY 1""")
def p05(spark, d):
    return align.drop_report(_matrix(spark, d), STORE_FEATURES, ["symbol"])


@query("p06_feature_coverage", f"WITH {WIDE_SQL}, {COVERAGE_SQL} SELECT * FROM cov")
def p06(spark, d):
    return align.feature_coverage(_matrix(spark, d), [*STORE_FEATURES, "never"], ["symbol"])


@query("p07_prune_all_null", f"WITH {WIDE_SQL}, {COVERAGE_SQL} SELECT symbol, feature_name FROM cov WHERE n_non_null > 0")
def p07(spark, d):
    cov = align.feature_coverage(_matrix(spark, d), [*STORE_FEATURES, "never"], ["symbol"])
    return align.prune_all_null(cov).select("symbol", "feature_name")


@query("p16_to_naive_utc", """
    SELECT event_id, timezone('UTC', timezone('America/New_York', ts)) AS ts_utc FROM events""")
def p16(spark, d):
    return table(spark, d, "events").select(
        "event_id", to_naive_utc(F.col("ts").cast("timestamp"), "America/New_York").alias("ts_utc"))


SPAN_CTE = """span AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS first_day, (date_trunc('day', max(ts)) + INTERVAL 1 DAY)::TIMESTAMP AS last_day FROM events)"""
ASOF_GRID = f"""{SPAN_CTE}, grid AS (SELECT unnest(generate_series(first_day, last_day - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM span)"""


def event_span(spark, d):
    """First day with an event, and the day after the last one."""
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    first, last = table(spark, d, "events").agg(day(F.min("ts")), day(F.max("ts")) + F.expr("INTERVAL 1 DAY")).first()
    return first, last


def _asof_sql(event_type: str, name: str, cap_hours: float | None) -> str:
    age = f"WHEN epoch_us(g.ts) - epoch_us(s.ts) > {int(cap_hours * 3_600_000_000)} THEN NULL" if cap_hours else ""
    return f"""{name} AS (SELECT g.ts, CASE WHEN s.ts IS NULL THEN NULL {age} ELSE s.value END AS {name}
      FROM grid g ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = '{event_type}') s ON g.ts >= s.ts)"""


@query("c01_asof_cap", f"""WITH {ASOF_GRID}, {_asof_sql('signup', 'g_signup', 0.5)}, {_asof_sql('error', 'g_error', 2)},
      {_asof_sql('view', 'g_view', None)}
    SELECT ts, g_signup, g_error, g_view FROM g_signup JOIN g_error USING (ts) JOIN g_view USING (ts)""")
def c01(spark, d):
    series = table(spark, d, "events").filter(F.col("event_type").isin("signup", "error", "view")).select(
        F.concat(F.lit("g_"), "event_type").alias("feature_name"), "ts", "value")
    start, end = event_span(spark, d)
    grid = bar_grid(spark, start, end, "1h")
    return asof_wide(grid, series, {"g_signup": 0.5, "g_error": 2, "g_view": None}, 3600,
                     F.lit(start).cast("timestamp_ntz"))


@query("c01_asof_exact_policy", f"""WITH {event_bars_cte()}, {ASOF_GRID},
      s AS (SELECT ts, close_price AS v FROM bars WHERE symbol = 'signup' AND close_price > 50)
    SELECT grid.ts, s.v AS x FROM grid LEFT JOIN s ON grid.ts = s.ts""")
def c01_exact(spark, d):
    bars = event_bars(spark, d).filter("symbol = 'signup' AND close_price > 50")
    series = bars.select(F.lit("x").alias("feature_name"), F.col("start_time").alias("ts"), F.col("close_price").alias("value"))
    start, end = event_span(spark, d)
    grid = bar_grid(spark, start, end, "1h")
    return asof_wide(grid, series, {"x": 24}, 3600, F.lit(start).cast("timestamp_ntz"), exact=["x"])


@query("c02_project_to_finer_grid", f"""WITH {event_bars_cte("4h")}, {SPAN_CTE}, b15 AS (
      SELECT symbol, unnest(generate_series(first_day, last_day - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS ts
      FROM (SELECT DISTINCT symbol FROM bars), span)
    SELECT g.symbol, g.ts, CASE WHEN epoch_us(g.ts) - epoch_us(b.ts) <= 14400000000 THEN b.close_price END AS close_4h
    FROM b15 g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts >= b.ts""")
def c02(spark, d):
    bars = event_bars(spark, d, "4h")
    series = bars.select("symbol", F.lit("close_4h").alias("feature_name"), F.col("start_time").alias("ts"),
                         F.col("close_price").alias("value"))
    start, end = (F.lit(t).cast("timestamp_ntz") for t in event_span(spark, d))
    bounds = bars.select("symbol").distinct().select("symbol", start.alias("start"), end.alias("end"))
    return asof_wide(grid_between(bounds, "15m"), series, {"close_4h": 4}, 900, start, keys=["symbol"])


@query("c04_paired_returns", f"""WITH {event_bars_cte()}
    SELECT a.ts, a.close_price AS left_close, b.close_price AS right_close
    FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'""")
def c04(spark, d):
    bars = event_bars(spark, d).filter(F.col("symbol").isin("click", "view"))
    side = lambda s: F.max(F.when(F.col("symbol") == s, F.col("close_price")))
    return bars.groupBy(F.col("start_time").alias("ts")).agg(
        side("click").alias("left_close"), side("view").alias("right_close")).dropna()


@query("u05_schema_difference", f"""WITH a AS (SELECT DISTINCT p_name AS feature_name FROM part WHERE p_size < 3),
      b AS (SELECT DISTINCT p_name AS feature_name FROM part WHERE p_size > 48)
    SELECT coalesce(a.feature_name, b.feature_name) AS feature_name,
           CASE WHEN a.feature_name IS NULL THEN 'extra' ELSE 'missing' END AS side
    FROM a FULL JOIN b ON a.feature_name = b.feature_name WHERE a.feature_name IS NULL OR b.feature_name IS NULL""")
def u05(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_name", "feature_name")
    return align.schema_difference(p.filter("p_size < 3"), p.filter("p_size > 48"))


SPEC = DatasetSpec(
    symbols=("click", "view"), interval="1h", start=START, end=END, label="long_win_tb_short",
    per_bar={"volume_zscore_24": 1, "atr_14": 1}, shared={"g_signup": 1}, caps={"g_signup": 1.0},
    derived=("log_return_24",), training_intervals=("1h", "15m"),
)


def _label_sql(interval: str, name: str) -> str:
    """Label and derived return at one interval over the bundle window (range +- 8 days)."""
    key = "PARTITION BY symbol, interval ORDER BY ts"
    return f"""{event_bars_cte(interval, name + "_all")}, {name}_b AS (
      SELECT * FROM {name}_all WHERE symbol IN ('click', 'view')
        AND ts >= TIMESTAMP '2024-01-05' - INTERVAL 8 DAY AND ts < TIMESTAMP '2024-01-25' + INTERVAL 8 DAY),
    {atr_cte(name + "_b", name + "_a")}, {barrier_cte(name + "_a", name + "_l", 2.0, 0.75, 6, classes="win")},
    {name} AS (SELECT symbol, ts, label::DOUBLE AS y, CASE WHEN close_price > 0 AND lag(close_price, 24) OVER k > 0
                 THEN ln(close_price / lag(close_price, 24) OVER k) END AS log_return_24
               FROM {name}_l WINDOW k AS ({key}))"""


def _stacked_sql() -> str:
    def piece(interval, lab, step):
        feats = lambda n: (
            f"(SELECT symbol, ts, value FROM store WHERE feature_name = '{n}' AND interval = '1h' AND {SQL_RANGE})")
        def local(n):
            if interval == "1h":
                return f"LEFT JOIN {feats(n)} {n}_s ON g.symbol = {n}_s.symbol AND g.ts = {n}_s.ts"
            return f"ASOF LEFT JOIN {feats(n)} {n}_s ON g.symbol = {n}_s.symbol AND g.ts >= {n}_s.ts"
        pick = lambda n, cap: f"CASE WHEN epoch_us(g.ts) - epoch_us({n}_s.ts) <= {cap} * 3600000000 THEN {n}_s.value END AS {n}"
        return f"""(SELECT g.symbol, g.ts, {pick("volume_zscore_24", 1)}, {pick("atr_14", 1)}, {pick("g_signup", 1)},
               l.log_return_24, l.y, {2 if interval == "1h" else 1} AS interval_indicator
          FROM (SELECT symbol, unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25' - INTERVAL {step} MINUTE,
                  INTERVAL {step} MINUTE)) AS ts FROM (SELECT unnest(['click', 'view']) AS symbol)) g
          {local("volume_zscore_24")} {local("atr_14")}
          ASOF LEFT JOIN (SELECT ts, value FROM store WHERE feature_name = 'g_signup' AND {SQL_RANGE}) g_signup_s ON g.ts >= g_signup_s.ts
          LEFT JOIN {lab} l ON g.symbol = l.symbol AND g.ts = l.ts)"""
    return f"""{event_bars_cte()}, {store_cte()}, {_label_sql("1h", "l1h")}, {_label_sql("15m", "l15")},
    m1h AS {piece("1h", "l1h", 60)}, m15 AS {piece("15m", "l15", 15)}, pieces AS (SELECT * FROM m1h UNION ALL SELECT * FROM m15),
    stacked AS (SELECT * FROM pieces WHERE volume_zscore_24 IS NOT NULL AND atr_14 IS NOT NULL AND g_signup IS NOT NULL
                  AND log_return_24 IS NOT NULL AND y IS NOT NULL)"""


STACK_COLUMNS = ("volume_zscore_24", "atr_14", "g_signup", "log_return_24")
STACK_OUT = "symbol, ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in STACK_COLUMNS) + ", y"


def _stack_out(df, *extra):
    return df.select("symbol", "ts", *[rounded(c).alias(c) for c in STACK_COLUMNS], "y", *extra)


@query("d01_load_dataset", f"WITH {_stacked_sql()} SELECT {STACK_OUT} FROM stacked WHERE interval_indicator = 2")
def d01(spark, d):
    bars = event_bars(spark, d)
    return _stack_out(load_dataset(store_values(spark, d, bars), bars, SPEC))


@query("d01_pctrank_and_pair_dataset", f"""WITH lab AS ({pctrank_sql(event_bars_cte(), 168, 48)}), pair AS ({PAIR_SQL}), {event_bars_cte()},
    lr AS (SELECT symbol, ts, CASE WHEN close_price > 0 AND lag(close_price, 24) OVER k > 0 THEN ln(close_price / lag(close_price, 24) OVER k) END AS x
           FROM bars WINDOW k AS (PARTITION BY symbol, interval ORDER BY ts))
    SELECT lab.symbol, lab.ts, round(x, 6) AS log_return_24, pair.value AS pair_corr, lab.value AS y
    FROM lab JOIN lr USING (symbol, ts) JOIN pair ON pair.ts = lab.ts
    WHERE lab.symbol IN ('click', 'view') AND lab.{SQL_RANGE.replace("ts <", "lab.ts <")} AND x IS NOT NULL AND pair.value IS NOT NULL AND lab.value IS NOT NULL""")
def d01_pctrank(spark, d):
    """A percentile-rank label and a pair correlation as dataset columns, with a feature that has no value at all."""
    bars = event_bars(spark, d)
    spec = DatasetSpec(symbols=("click", "view"), interval="1h", start=START, end=END, label=pctrank_label(24, 168, 48), per_bar={"never_stored": 1},
                       derived=("log_return_24",), pairs={"pair_corr": ("click", "purchase")})
    out = load_dataset(store_values(spark, d, bars), bars, spec)
    return out.select("symbol", "ts", rounded("log_return_24").alias("log_return_24"), rounded("pair_corr").alias("pair_corr"), "y")


@query("d01_dataset_coverage", f"""WITH {_stacked_sql()}, m AS (SELECT * FROM m1h)
    SELECT feature_name, n_slots, n_non_null, round(n_non_null / n_slots, 4) AS pct_non_null FROM (
      SELECT count(*) AS n_slots, count(volume_zscore_24) AS volume_zscore_24, count(atr_14) AS atr_14,
             count(g_signup) AS g_signup, count(log_return_24) AS log_return_24, count(y) AS y FROM m)
    UNPIVOT (n_non_null FOR feature_name IN (volume_zscore_24, atr_14, g_signup, log_return_24, y))""")
def d01_coverage(spark, d):
    bars = event_bars(spark, d)
    return coverage(load_matrix(store_values(spark, d, bars), bars, SPEC), SPEC)


@query("u02_aux_interval_dataset", f"WITH {_stacked_sql()} SELECT {STACK_OUT} FROM stacked WHERE interval_indicator = 1")
def u02(spark, d):
    return _stack_out(load_dataset(store_values(spark, d), event_bars(spark, d, "15m"), SPEC, "15m"))


@query("u01_stack_intervals", f"WITH {_stacked_sql()} SELECT {STACK_OUT}, CAST(interval_indicator AS INTEGER) AS interval_indicator FROM stacked")
def u01(spark, d):
    h = event_bars(spark, d)
    stacked = load_stacked(store_values(spark, d, h), {"1h": h, "15m": event_bars(spark, d, "15m")}, SPEC)
    return _stack_out(stacked, "interval_indicator")


@query("p10_filter_serving_interval", f"WITH {_stacked_sql()} SELECT symbol, count(*) AS n, round(avg(y), 6) AS y_mean FROM stacked WHERE interval_indicator = 2 GROUP BY 1")
def p10(spark, d):
    h = event_bars(spark, d)
    stacked = load_stacked(store_values(spark, d, h), {"1h": h, "15m": event_bars(spark, d, "15m")}, SPEC)
    return align.filter_serving_interval(stacked, "1h").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("y")).alias("y_mean"))


@query("p09_interval_indicator", f"""WITH {event_bars_cte("15m", "a")}, {event_bars_cte("1h", "b")}, {event_bars_cte("4h", "c")}
    SELECT interval, CAST(CASE interval WHEN '5m' THEN 0 WHEN '15m' THEN 1 WHEN '1h' THEN 2 WHEN '4h' THEN 3 END AS INTEGER) AS code, count(*) AS n
    FROM (SELECT interval FROM a UNION ALL SELECT interval FROM b UNION ALL SELECT interval FROM c) GROUP BY 1, 2""")
def p09(spark, d):
    parts = [event_bars(spark, d, i).select("interval") for i in ("15m", "1h", "4h")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(
        "interval", align.interval_indicator(F.col("interval")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("u03_common_timestamps", f"""WITH {event_bars_cte()}
    SELECT ts FROM bars WHERE symbol = 'click' INTERSECT SELECT ts FROM bars WHERE symbol = 'view'""")
def u03(spark, d):
    bars = event_bars(spark, d)
    at = lambda s: bars.filter(F.col("symbol") == s).select(F.col("start_time").alias("ts"))
    return at("click").intersect(at("view"))


@query("u04_union_of_name_sets", """SELECT DISTINCT p_name AS feature_name FROM part WHERE p_size = 50
    UNION SELECT DISTINCT p_name FROM part WHERE p_retailprice < 905""")
def u04(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("feature_name"), "p_size", "p_retailprice")
    return p.filter("p_size = 50").select("feature_name").union(p.filter("p_retailprice < 905").select("feature_name")).distinct()


@query("u01_stacked_coverage", f"""WITH {_stacked_sql()}, c AS (
      SELECT feature_name, n_slots, n FROM (
        SELECT count(*) AS n_slots, count(volume_zscore_24) AS volume_zscore_24, count(atr_14) AS atr_14, count(g_signup) AS g_signup,
               count(log_return_24) AS log_return_24, count(y) AS y FROM pieces)
      UNPIVOT (n FOR feature_name IN (volume_zscore_24, atr_14, g_signup, log_return_24, y)))
    SELECT feature_name, CAST(n_slots AS BIGINT) AS n_slots, CAST(n AS BIGINT) AS n_non_null, round(n / n_slots, 4) AS pct_non_null FROM c""")
def u01_coverage(spark, d):
    h = event_bars(spark, d)
    store = store_values(spark, d, h)
    parts = [coverage(load_matrix(store, b, SPEC, i), SPEC) for i, b in (("1h", h), ("15m", event_bars(spark, d, "15m")))]
    return align.sum_coverage(parts[0].unionByName(parts[1]))
