"""Prediction store, run records, trials and gates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from barlab.catalog.eval_queries import FOLD_AGG_CTE, FOLD_METRICS_SQL, FOLD_ROWS_CTE, auc_sql, binary_sql, bins_sql, fold_metric_rows, own_fold_auc
from barlab.catalog.inputs import FOLDS_CTE, SCORES_CTE, rounded, score_folds, scores, table
from barlab.catalog.registry import ORACLES, query
from barlab.operators.frames import stable_sort
from barlab.operators import calibration as cal
from barlab.operators import folds as fo
from barlab.operators import gates as ga
from barlab.operators.metrics import binary_metrics
from barlab.operators.report import analysis_report
from barlab.sources import runs as ru
from barlab.sources import signals as sg
from barlab.sources.published import PublishedSignals
from barlab.session import shared_folder


def signal_rows(spark, d):
    """Predictions per (customer segment, order status, day) from orders; source by priority."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.select(
        F.col("c_mktsegment").alias("signal_id"), F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts"),
        (F.floor(F.col("o_totalprice") / 500) / 1000.0).alias("value"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") < "3", "live").otherwise("backfill").alias("source"),
    )


SIGNALS_CTE = """sig AS (
      SELECT c_mktsegment AS signal_id, o_orderstatus AS symbol, o_orderdate AS ts, floor(o_totalprice / 500) / 1000.0::DOUBLE AS value, o_orderkey AS seq,
             CASE WHEN o_orderpriority < '3' THEN 'live' ELSE 'backfill' END AS source
      FROM orders JOIN customer ON c_custkey = o_custkey)"""
KEYED_CTE = f"""{SIGNALS_CTE}, keyed AS (
      SELECT signal_id, symbol, ts, arg_max(value, seq) AS value, arg_max(source, seq) AS source, max(seq) AS seq FROM sig GROUP BY 1, 2, 3)"""


def keyed(spark, d):
    return sg.latest_per_key(signal_rows(spark, d), F.col("seq"))


@query("s08_upsert_predictions", f"""WITH {SIGNALS_CTE},
      pri AS (SELECT *, CASE WHEN source = 'live' THEN 1 ELSE 0 END AS gen FROM sig)
    SELECT signal_id, symbol, ts, arg_max(value, (gen, seq)) AS value, arg_max(source, (gen, seq)) AS source FROM pri GROUP BY 1, 2, 3""")
def s08(spark, d):
    """Backfill rows first, then live rows overwrite them, through the Parquet writer."""
    rows = signal_rows(spark, d)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = f"{shared}/signals-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/signals"
    pick = lambda s: sg.latest_per_key(rows.filter(F.col("source") == s), F.col("seq")).drop("seq")
    sg.upsert(spark, pick("backfill"), path, period="yyyy")
    sg.upsert(spark, pick("live"), path, period="yyyy")
    return spark.read.parquet(path).select("signal_id", "symbol", "ts", "value", "source")


@query("s08_published_upsert", ORACLES["s08_upsert_predictions"])
def s08_published(spark, d):
    """The same two upserts, each visible at once through its commit."""
    rows = signal_rows(spark, d)
    table_ = PublishedSignals(spark, f"{shared_folder(spark)}/published-{uuid.uuid4().hex}", "yyyy")
    for source in ("backfill", "live"):
        table_.upsert(rows.filter(F.col("source") == source), order="seq")
    return table_.read().select("signal_id", "symbol", "ts", "value", "source")


@query("s08_merge", f"""WITH {SIGNALS_CTE}, pri AS (SELECT *, CASE WHEN source = 'live' THEN 1 ELSE 0 END AS gen FROM sig)
    SELECT signal_id, symbol, ts, arg_max(value, (gen, seq)) AS value, arg_max(source, (gen, seq)) AS source FROM pri GROUP BY 1, 2, 3""")
def s08_merge(spark, d):
    rows = signal_rows(spark, d)
    pick = lambda s: sg.latest_per_key(rows.filter(F.col("source") == s), F.col("seq")).drop("seq")
    return sg.merge(pick("backfill"), pick("live"))


LABEL_SQL = """lab AS (SELECT o_orderstatus AS symbol, o_orderdate AS ts, CASE WHEN avg(o_totalprice) > 150000 THEN 1.0 ELSE 0.0 END::DOUBLE AS actual
      FROM orders GROUP BY 1, 2)"""


def _labels(spark, d):
    o = table(spark, d, "orders")
    daily = o.groupBy(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("p"))
    label = daily.select(F.lit("label_high").alias("feature_name"), F.lit(1).alias("version"), "symbol", F.lit("1d").alias("interval"), "ts",
                         (F.col("p") > 150000).cast("double").alias("value"))
    return label.unionByName(label.withColumn("interval", F.lit("4h")).withColumn("value", F.lit(0.0)))


@query("c05_predictions_with_labels", f"""WITH {KEYED_CTE}, {LABEL_SQL}
    SELECT signal_id, symbol, ts, value AS predicted, actual FROM keyed JOIN lab USING (symbol, ts)""")
def c05(spark, d):
    return sg.predictions_with_labels(keyed(spark, d), _labels(spark, d), "label_high", 1, "1d")


@query("c06_definition_registry_join", """SELECT 'signal ' || CAST(c_custkey AS VARCHAR) AS name, CAST(c_nationkey AS VARCHAR) AS model_id,
      n_name AS model_symbol, c_mktsegment AS status, CAST(n_regionkey AS VARCHAR) AS model_purpose FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def c06(spark, d):
    definitions = table(spark, d, "customer").select(
        F.concat(F.lit("signal "), F.col("c_custkey").cast("string")).alias("name"), F.col("c_nationkey").cast("string").alias("model_id"),
        F.col("c_mktsegment").alias("status"))
    models = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("symbol"),
                                              F.col("n_regionkey").cast("string").alias("purpose"))
    return sg.definitions_with_models(definitions, models).select("name", "model_id", "model_symbol", "status", "model_purpose")


def oof_folds(spark, d):
    """Chunks of out-of-fold arrays, a fold per symbol and month; deep discounts have no prediction."""
    s = scores(spark, d).withColumn("test_start", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    p = F.when(F.col("l_discount") < 0.095, F.col("predicted"))
    chunks = sg.chunk_folds(s, ["symbol", "test_start"], p, ["ts", "l_extendedprice", "predicted"])
    return chunks.select(
        "symbol", ((F.year("test_start") - 1995) * 12 + F.month("test_start")).alias("fold"), "chunk", "start",
        (F.col("test_start") - F.expr("INTERVAL 7 DAYS")).alias("train_end"), "test_start",
        F.add_months("test_start", 1).cast("timestamp_ntz").alias("test_end"), "n_test", "oof_predictions", "oof_timestamps",
        F.lit(None).cast("string").alias("skipped_reason"),
    )


@query("p20_flatten_oof", f"""WITH {SCORES_CTE}
    SELECT 'sig-1' AS signal_id, symbol, ts, predicted AS value, predicted AS confidence,
      CAST((year(ts) - 1995) * 12 + month(ts) AS INTEGER) AS fold, strftime(date_trunc('month', ts), '%Y-%m-%dT%H:%M:%S') AS test_start
    FROM scores WHERE l_discount < 0.095""")
def p20(spark, d):
    flat = sg.flatten_oof(oof_folds(spark, d), "sig-1", F.col("symbol"), "abc")
    return flat.select("signal_id", "symbol", "ts", "value", "confidence",
                       F.get_json_object("meta", "$.fold").cast("int").alias("fold"), F.get_json_object("meta", "$.test_start").alias("test_start"))


@query("p22_backfill_summary", f"""WITH {SCORES_CTE}
    SELECT symbol, CAST((year(ts) - 1995) * 12 + month(ts) AS INTEGER) AS fold, CAST(count(*) AS INTEGER) AS n_preds, CAST(count(*) AS INTEGER) AS n_timestamps,
      CAST(count(*) FILTER (l_discount >= 0.095) AS INTEGER) AS n_nan_skipped, CAST(count(*) FILTER (l_discount < 0.095) AS INTEGER) AS n_to_upsert, CAST(NULL AS VARCHAR) AS skipped_reason
    FROM scores GROUP BY 1, 2""")
def p22(spark, d):
    counts = ("n_preds", "n_timestamps", "n_nan_skipped", "n_to_upsert")
    return sg.backfill_summary(oof_folds(spark, d), ["symbol"]).select("symbol", "fold", *[F.col(c).cast("int").alias(c) for c in counts], "skipped_reason")


@query("p22_backfill_windows", f"""WITH {SCORES_CTE}
    SELECT symbol, CAST((year(ts) - 1995) * 12 + month(ts) AS INTEGER) AS fold, CAST(date_trunc('month', min(ts)) AS TIMESTAMP) AS test_start,
      CAST(date_trunc('month', min(ts)) + INTERVAL 1 MONTH AS TIMESTAMP) AS test_end, count(*) AS n_test FROM scores GROUP BY 1, 2""")
def p22_windows(spark, d):
    return sg.backfill_summary(oof_folds(spark, d), ["symbol"]).select("symbol", "fold", "test_start", "test_end", "n_test")


@query("p22_backfill_totals", f"""WITH {SCORES_CTE}
    SELECT symbol, count(DISTINCT date_trunc('month', ts)) AS n_folds, CAST(0 AS BIGINT) AS n_folds_skipped, count(*) FILTER (l_discount < 0.095) AS total_rows,
      count(*) FILTER (l_discount >= 0.095) AS total_skipped_nan FROM scores GROUP BY 1""")
def p22_totals(spark, d):
    return sg.backfill_totals(sg.backfill_summary(oof_folds(spark, d), ["symbol"]), ["symbol"])


@query("p24_signal_band", f"""WITH {KEYED_CTE}
    SELECT signal_id, CASE WHEN value < 0.30 THEN 'risk-off' WHEN value > 0.70 THEN 'risk-on' ELSE 'neutral' END AS band, count(*) AS n FROM keyed GROUP BY 1, 2""")
def p24(spark, d):
    return keyed(spark, d).groupBy("signal_id", sg.signal_band(F.col("value")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("g51_signal_profile", f"""WITH {KEYED_CTE}
    SELECT signal_id, symbol, count(*) AS n, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM keyed GROUP BY 1, 2""")
def g51(spark, d):
    return sg.profile(keyed(spark, d))


@query("g51_recent_profile", f"""WITH {KEYED_CTE}
    SELECT signal_id, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*) FILTER (value < 0.30) AS n_low,
      count(*) FILTER (value > 0.70) AS n_high FROM keyed WHERE ts >= (SELECT max(ts) FROM keyed) - INTERVAL 90 DAY GROUP BY 1""")
def g51_recent(spark, d):
    rows = keyed(spark, d)
    now = rows.agg(F.max("ts").alias("now"))
    return sg.recent_profile(rows.join(F.broadcast(now)), F.col("now")).withColumn("mean", rounded("mean"))


@query("g51_source_profile", f"""WITH {KEYED_CTE}
    SELECT source, count(*) AS n, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM keyed GROUP BY 1""")
def g51_source(spark, d):
    return sg.profile(keyed(spark, d), ["source"])


@query("k07_latest_predictions", f"""WITH {KEYED_CTE} SELECT signal_id, symbol, ts, value FROM keyed ORDER BY ts DESC, signal_id, symbol LIMIT 10""")
def k07(spark, d):
    return sg.latest(keyed(spark, d), 10).select("signal_id", "symbol", "ts", "value")


@query("k01_stable_sort", """SELECT symbol, ts, piece_order, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, piece_order, id) AS pos FROM (
      SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, CAST(user_id % 2 AS INTEGER) AS piece_order, event_id AS id FROM events)""")
def k01(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
                                         (F.col("user_id") % 2).cast("int").alias("piece_order"), F.col("event_id").alias("id"))
    days = e.withColumn("day", F.to_date("ts"))
    return stable_sort(days, ["symbol", "day"], ["ts", "piece_order"], ["id"]).select("symbol", "ts", "piece_order", "pos")


# --- runs ------------------------------------------------------------------------------------------------

RUN_IDENTITY = ("run_id", "objective", "label", "n_features")


def run_rows(spark, d):
    """One run per supplier; its settings come from the supplier row."""
    s = table(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("run_id"),
        F.when(F.col("s_nationkey") < 8, "multiclass").when(F.col("s_nationkey") < 15, "regression").otherwise("binary").alias("objective"),
        F.when(F.col("s_nationkey") >= 22, "directional").otherwise("regime").alias("purpose"),
        F.lit("label_1").alias("label"), F.col("s_nationkey").alias("n_features"),
        (F.col("s_nationkey") / 6).cast("int").alias("n_derived_inputs"), (F.col("s_acctbal") < 5000).alias("label_is_derived"),
        F.when(F.col("s_nationkey") > 12, 3).otherwise(1).alias("n_base_models"), (F.col("s_acctbal") > 8000).alias("meta_label"), "s_acctbal",
    )


RUNS_CTE = """runs AS (
      SELECT 's' || CAST(s_suppkey AS VARCHAR) AS run_id,
        CASE WHEN s_nationkey < 8 THEN 'multiclass' WHEN s_nationkey < 15 THEN 'regression' ELSE 'binary' END AS objective,
        CASE WHEN s_nationkey >= 22 THEN 'directional' ELSE 'regime' END AS purpose, 'label_1' AS label, s_nationkey AS n_features,
        CAST(s_nationkey // 6 AS INTEGER) AS n_derived_inputs, s_acctbal < 5000 AS label_is_derived,
        CASE WHEN s_nationkey > 12 THEN 3 ELSE 1 END AS n_base_models, s_acctbal > 8000 AS meta_label, s_acctbal
      FROM supplier)"""
READY_SQL = "NOT (n_derived_inputs > 0 OR label_is_derived OR (n_base_models > 1 AND meta_label))"
SHA_SQL = """sha256('{"label":"' || label || '","n_features":' || CAST(n_features AS VARCHAR) || ',"objective":"' || objective || '","run_id":"' || run_id || '"}')"""


@query("s12_run_manifest", f"""WITH {RUNS_CTE}
    SELECT run_id, objective, {SHA_SQL} AS content_sha256, {READY_SQL} AS deployment_ready, CAST(2 AS INTEGER) AS payload_version FROM runs""")
def s12(spark, d):
    return ru.run_manifest(run_rows(spark, d), RUN_IDENTITY).select("run_id", "objective", "content_sha256", "deployment_ready", "payload_version")


@query("s13_deployment_readiness", f"""WITH {RUNS_CTE} SELECT objective, count(*) FILTER ({READY_SQL}) AS n_ready, count(*) AS n FROM runs GROUP BY 1""")
def s13(spark, d):
    m = ru.run_manifest(run_rows(spark, d), RUN_IDENTITY)
    return m.groupBy("objective").agg(F.count_if("deployment_ready").alias("n_ready"), F.count(F.lit(1)).alias("n"))


@query("s14_content_sha", f"WITH {RUNS_CTE} SELECT run_id, {SHA_SQL} AS sha FROM runs")
def s14(spark, d):
    return run_rows(spark, d).select("run_id", ru.content_sha(RUN_IDENTITY).alias("sha"))


@query("s15_register_idempotent", f"""WITH {RUNS_CTE} SELECT run_id, {SHA_SQL} AS content_sha256 FROM runs WHERE s_acctbal >= 2000""")
def s15(spark, d):
    m = ru.run_manifest(run_rows(spark, d), RUN_IDENTITY).select("content_sha256", "run_id", "s_acctbal")
    fresh = ru.register_idempotent(m.filter("s_acctbal < 2000"), m.unionByName(m))
    return fresh.select("run_id", "content_sha256")


def nested_runs(spark, d):
    """Runs with nested metrics built from the per-supplier fold rows."""
    rows = fold_metric_rows(spark, d)
    agg = fo.fold_aggregate(rows, "auc").select("run_id", F.round("primary_mean", 11).alias("primary_mean"), F.round("primary_median", 11).alias("primary_median"),
                                                      F.round("primary_std", 9).alias("primary_std"), "last_value")
    means = fo.metric_means(rows, "auc").groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.round("mean_value", 11)))).alias("metric_means"))
    per_fold = rows.groupBy("run_id", "fold").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    folds = per_fold.groupBy("run_id").agg(F.collect_list(F.struct("fold", "metrics")).alias("folds"))
    return agg.join(means, "run_id").join(folds, "run_id").withColumn("metrics", F.create_map(F.lit("auc"), F.col("last_value")))


FLAT_SQL = f"""{FOLD_ROWS_CTE}, {FOLD_AGG_CTE}, mm AS (
      SELECT run_id, metric, round(avg(value), 11) AS v FROM fm WHERE (run_id, fold) IN (SELECT (run_id, fold) FROM fm WHERE metric = 'auc' AND value IS NOT NULL) GROUP BY 1, 2),
    flat AS (
      SELECT run_id, 'auc' AS name, last_value AS value, CAST(NULL AS INTEGER) AS fold_idx FROM fa
      UNION ALL SELECT run_id, 'wf_primary_mean', primary_mean, NULL FROM fa UNION ALL SELECT run_id, 'wf_primary_median', primary_median, NULL FROM fa
      UNION ALL SELECT run_id, 'wf_primary_std', primary_std, NULL FROM fa UNION ALL SELECT run_id, 'wf_mean_' || metric, v, NULL FROM mm
      UNION ALL SELECT f.run_id, metric, value, fold FROM fm f JOIN fa USING (run_id))"""


@query("s16_flatten_run_metrics", f"WITH {FLAT_SQL} SELECT run_id, name, value, fold_idx FROM flat")
def s16(spark, d):
    return ru.flatten_run_metrics(nested_runs(spark, d))


@query("s17_drop_non_finite", f"WITH {FLAT_SQL} SELECT run_id, count(*) FILTER (value IS NOT NULL) AS n_logged, count(*) FILTER (value IS NULL) AS n_dropped FROM flat GROUP BY 1")
def s17(spark, d):
    return ru.dropped_counts(ru.flatten_run_metrics(nested_runs(spark, d)))


@query("s18_summary_tags", f"""WITH {RUNS_CTE}
    SELECT run_id, CASE WHEN objective = 'binary' THEN 'PASS' END AS gauntlet_verdict, CAST({READY_SQL} AS VARCHAR) AS deployment_ready,
      CASE WHEN purpose = 'regime' THEN 'walk_forward_aggregate' END AS eval_kind, CAST(1 + CASE WHEN objective = 'binary' THEN 1 ELSE 0 END + CASE WHEN purpose = 'regime' THEN 1 ELSE 0 END AS INTEGER) AS n_tags
    FROM runs""")
def s18(spark, d):
    m = ru.run_manifest(run_rows(spark, d), RUN_IDENTITY)
    tags = ru.summary_tags(F.when(F.col("objective") == "binary", "PASS"), F.col("deployment_ready"),
                           F.when(F.col("purpose") == "regime", "walk_forward_aggregate"))
    at = lambda k: F.try_element_at("t", F.lit(k)).alias(k)
    return m.select("run_id", tags.alias("t")).select("run_id", at("gauntlet_verdict"), at("deployment_ready"), at("eval_kind"), F.size("t").alias("n_tags"))


@query("s20_analysis_report", f"""WITH {SCORES_CTE}, {FOLDS_CTE}, o AS (SELECT *, 'overall' AS section FROM scores), {binary_sql('o', 'section', name='ov')},
      ms AS (SELECT *, strftime(ts, '%Y-%m') AS section FROM scores), {binary_sql('ms', 'section', name='mo')}
    SELECT 'overall' AS part, section, n, brier, log_loss, accuracy, auc FROM ov UNION ALL SELECT 'month', section, n, brier, log_loss, accuracy, auc FROM mo""")
def s20(spark, d):
    s = scores(spark, d)
    names = ("brier", "log_loss", "accuracy", "auc")
    pick = lambda df, part, key: df.select(F.lit(part).alias("part"), key.alias("section"), F.col("n").cast("long").alias("n"), *[rounded(c).alias(c) for c in names])
    whole = pick(binary_metrics(s), "overall", F.lit("overall"))
    return whole.unionByName(pick(cal.per_month_metrics(s), "month", F.col("month")))


REPORT_SQL = f"""WITH {FOLD_METRICS_SQL}, b AS (SELECT symbol, arg_max(test_start, fold) AS lo, arg_max(test_end, fold) AS hi, max(fold) AS last, arg_max(train_end, fold) AS saved_end FROM folds GROUP BY 1),
      z AS (SELECT s.symbol, CASE WHEN ts >= hi THEN 'post' ELSE 'last_fold' END AS part, 'all' AS section, predicted, actual FROM scores s JOIN b USING (symbol) WHERE ts >= lo),
      sec AS (SELECT symbol, 'overall' AS part, 'all' AS section, predicted, actual FROM scores
        UNION ALL SELECT symbol, 'month', strftime(ts, '%Y-%m'), predicted, actual FROM scores
        UNION ALL SELECT symbol, 'fold', CAST(fold AS VARCHAR), predicted, actual FROM tst UNION ALL SELECT * FROM z),
      {binary_sql('sec', 'symbol, part, section')}, cal AS (SELECT * FROM sec WHERE part IN ('overall', 'last_fold', 'post')), {bins_sql('cal', 'symbol, part')}
    SELECT symbol, part, section, n, brier, log_loss, accuracy, auc, CAST(NULL AS DOUBLE) AS own_auc, CAST(NULL AS VARCHAR) AS note,
      CAST(NULL AS DOUBLE) AS ece, CAST(NULL AS DOUBLE) AS mean_pred, CAST(NULL AS DOUBLE) AS actual_rate FROM bm WHERE part <> 'fold'
    UNION ALL SELECT symbol, 'fold', CAST(f.fold AS VARCHAR), coalesce(n, 0), brier, log_loss, accuracy, auc, own_auc,
      CASE WHEN test_end <= saved_end THEN 'inside_train' WHEN f.fold = last THEN 'last_fold' ELSE 'overlap' END, NULL, NULL, NULL
      FROM folds f JOIN b USING (symbol) LEFT JOIN (SELECT *, CAST(section AS INTEGER) AS fold FROM bm WHERE part = 'fold') m USING (symbol, fold) LEFT JOIN own USING (symbol, fold)
    UNION ALL SELECT symbol, 'calibration', part || ' ' || CASE WHEN bin = 0 THEN '[' ELSE '(' END || printf('%.2f, %.2f]', bin / 10.0, (bin + 1) / 10.0), count, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      round(mean_pred, 4), round(actual_rate, 6) FROM bins
    UNION ALL SELECT symbol, 'ece', part, CAST(sum(count) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, round(sum(abs_gap * count) / sum(count), 6), NULL, NULL FROM bins GROUP BY symbol, part"""


@query("s20_report_sections", REPORT_SQL)
def s20_sections(spark, d):
    folds = score_folds(spark, d)
    out = analysis_report(scores(spark, d), folds, own_fold_auc(spark, d, folds), ["symbol"])
    exact = ("symbol", "part", "section", "n", "own_auc", "note")
    return out.select(*[c if c in exact else rounded(c, 4 if c == "mean_pred" else 6).alias(c) for c in out.columns])


# --- trials ------------------------------------------------------------------------------------------------

def trial_rows(spark, d):
    """Trials per order clerk group: spec by priority and year, one trial per order, score from its total."""
    o = table(spark, d, "orders")
    return o.select(
        F.concat_ws("-", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("spec"), F.col("o_orderkey").alias("trial_number"),
        F.when(F.col("o_totalprice") > 5000, F.floor(F.col("o_totalprice") / 5000) / 100.0).otherwise(float("nan")).alias("score"),
        F.when(F.col("o_orderstatus") == "O", "COMPLETE").when(F.col("o_orderstatus") == "P", "PRUNED").otherwise("FAIL").alias("state"))


TRIALS_CTE = """trials AS (
      SELECT o_orderpriority || '-' || CAST(year(o_orderdate) AS VARCHAR) AS spec, o_orderkey AS trial_number,
        CASE WHEN o_totalprice > 5000 THEN floor(o_totalprice / 5000) / 100.0 END AS score,
        CASE o_orderstatus WHEN 'O' THEN 'COMPLETE' WHEN 'P' THEN 'PRUNED' ELSE 'FAIL' END AS state FROM orders)"""


@query("k02_top_k_trials", f"""WITH {TRIALS_CTE} SELECT spec, trial_number, score, row_number() OVER (PARTITION BY spec ORDER BY score DESC NULLS LAST, trial_number) AS rank
    FROM trials WHERE state = 'COMPLETE' QUALIFY row_number() OVER (PARTITION BY spec ORDER BY score DESC NULLS LAST, trial_number) <= 3""")
def k02(spark, d):
    trials = trial_rows(spark, d).withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    return ru.top_k_trials(trials, 3).select("spec", "trial_number", "score", F.col("rank").cast("long").alias("rank"))


@query("k03_best_run", f"""WITH {TRIALS_CTE} SELECT spec, max(score) AS best_value, arg_max(trial_number, (score, -trial_number)) AS best_trial
    FROM trials WHERE score IS NOT NULL GROUP BY 1""")
def k03(spark, d):
    return ru.best_run(trial_rows(spark, d)).select("spec", "best_value", "best_trial")


@query("g50_sweep_counts", f"""WITH {TRIALS_CTE}, b AS (SELECT spec, min(trial_number) AS bt FROM trials GROUP BY 1)
    SELECT spec, count(*) FILTER (state = 'COMPLETE') AS n_complete, count(*) FILTER (state = 'PRUNED') AS n_pruned, count(*) FILTER (state = 'FAIL') AS n_fail,
      max(score) FILTER (state = 'COMPLETE') AS best_score, max(score) FILTER (state = 'COMPLETE' AND trial_number = 0) AS baseline_score,
      round(max(score) FILTER (state = 'COMPLETE') - max(score) FILTER (state = 'COMPLETE' AND trial_number = 0), 6) AS improvement FROM trials GROUP BY 1""")
def g50(spark, d):
    return ru.sweep_counts(trial_rows(spark, d)).select("spec", "n_complete", "n_pruned", "n_fail", "best_score", "baseline_score", "improvement")


# --- gates -------------------------------------------------------------------------------------------------

def gate_runs(spark, d):
    """Runs with aggregated metrics: fold statistics per supplier, other metrics from its account row."""
    agg = fo.fold_aggregate(fold_metric_rows(spark, d), "auc")
    r = run_rows(spark, d)
    frac = F.pmod(F.col("s_acctbal"), F.lit(10.0)) / 10.0
    two = lambda c: F.round(c, 6)
    return r.join(agg, "run_id").select(
        "run_id", "objective", "purpose",
        F.when(F.col("objective") == "regression", "pearson_r").when(F.col("s_acctbal") > 9800, "rmse").otherwise("auc").alias("primary_metric"),
        F.when(F.col("s_acctbal") < 500, "FAIL").when(F.col("s_acctbal") < 4000, "WARN").when(F.col("s_acctbal") < 9900, "PASS").alias("integrity_verdict"),
        F.lit(7).alias("n_folds_configured"), F.lit(7).alias("n_folds_generated"), F.lit(7).alias("n_folds_run"), F.col("n_folds_valid"),
        F.round(F.col("primary_mean") + F.lit(0.02), 11).alias("primary_mean"), F.round(F.col("primary_median") + F.lit(0.02), 11).alias("primary_median"),
        F.round("primary_std", 9).alias("primary_std"), "last_value", two(frac * 0.3).alias("ci_max_abs_diff"), two(frac * 0.4 + 0.4).alias("ci_lower_5"),
        F.when(frac > 0.3, 1.0).otherwise(0.5).alias("realistic_profitable"), F.when(frac > 0.4, 1.0).otherwise(0.5).alias("conservative_profitable"),
        F.when(frac > 0.2, 1.0).otherwise(0.8).alias("regime_pass"), F.when(frac > 0.9, 0.2).otherwise(0.0).alias("regime_caveat"),
        F.when(frac > 0.25, 1.0).otherwise(0.0).alias("dsr_pass"), F.lit(1.0).alias("dsr_discount"),
    )


GATE_RUNS_CTE = f"""{FOLD_ROWS_CTE}, {FOLD_AGG_CTE}, {RUNS_CTE}, gr AS (
      SELECT run_id, objective, purpose, CASE WHEN objective = 'regression' THEN 'pearson_r' WHEN s_acctbal > 9800 THEN 'rmse' ELSE 'auc' END AS pm,
        CASE WHEN s_acctbal < 500 THEN 'FAIL' WHEN s_acctbal < 4000 THEN 'WARN' WHEN s_acctbal < 9900 THEN 'PASS' END AS iv,
        n_folds_valid AS nv, round(primary_mean + 0.02, 11) AS mean, round(primary_median + 0.02, 11) AS med, primary_std AS sd, last_value AS lv, frac,
        round(frac * 0.3, 6) AS ci, round(frac * 0.4 + 0.4, 6) AS lo
      FROM (SELECT *, (s_acctbal - 10.0::DOUBLE * floor(s_acctbal / 10.0::DOUBLE)) / 10.0 AS frac FROM runs) JOIN fa USING (run_id)),
    six AS (SELECT * FROM gr WHERE NOT (objective = 'multiclass' OR purpose = 'directional')),
    thirteen AS (SELECT * FROM gr WHERE objective = 'multiclass' OR purpose = 'directional')"""

_PF = "CASE WHEN coalesce({0}, false) THEN 'PASS' ELSE 'FAIL' END"
_CI = "ci < CASE objective WHEN 'regression' THEN 0.5 ELSE 0.15 END"
SIX_SQL = [
    ("integrity_passed", _PF.format("iv <> 'FAIL'")), ("walk_forward_complete", _PF.format("nv = 7")),
    ("generalization_edge", "CASE WHEN pm = 'rmse' THEN 'SKIP' ELSE " + _PF.format("mean >= CASE pm WHEN 'auc' THEN 0.52 ELSE 0.05 END AND med >= CASE pm WHEN 'auc' THEN 0.52 ELSE 0.05 END") + " END"),
    ("fold_stability", "CASE WHEN pm = 'rmse' THEN 'SKIP' ELSE " + _PF.format("sd <= CASE pm WHEN 'auc' THEN 0.15 ELSE 0.20 END") + " END"),
    ("saved_model_above_random", "CASE WHEN pm = 'rmse' THEN 'SKIP' ELSE " + _PF.format("lv >= CASE pm WHEN 'auc' THEN 0.5 ELSE 0.0 END") + " END"),
    ("transferability", _PF.format(_CI)),
]
THIRTEEN_SQL = [
    ("baseline_edge", _PF.format("mean > 0.55")), ("pit_no_leak", _PF.format("iv <> 'FAIL'")), ("bootstrap_ci_lower", _PF.format("lo > 0.50")),
    ("transferability", _PF.format(_CI)), ("cost_regime_profitable", _PF.format("frac > 0.3 AND frac > 0.4")),
    ("regime_subcut", _PF.format("frac > 0.2 AND frac <= 0.9")), ("dsr", _PF.format("frac > 0.25")),
    *[(g, "'SKIP'") for g in ("capacity_stress", "retraining_stability", "shadow_validation", "reviewer_approval", "operator_approval", "cross_asset_sanity")],
]


def _gates_cte(name: str, source: str, rules) -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT run_id, {i} AS gate_number, '{g}' AS gate, {v} AS verdict FROM {source}" for i, (g, v) in enumerate(rules, 1)) + ")"


BOTH_GATES = f"{GATE_RUNS_CTE}, {_gates_cte('g6', 'six', SIX_SQL)}, {_gates_cte('g13', 'thirteen', THIRTEEN_SQL)}"
_COUNTS = "count(*) FILTER (verdict = 'PASS') AS n_pass, count(*) FILTER (verdict = 'FAIL') AS n_fail, count(*) FILTER (verdict = 'SKIP') AS n_skip"


@query("v01_v06_modulator_gates", f"WITH {BOTH_GATES} SELECT * FROM g6")
def v01(spark, d):
    six, _ = ga.route(gate_runs(spark, d))
    return ga.evaluate(six, ga.modulator_gates())


@query("v07_modulator_overall", f"WITH {BOTH_GATES} SELECT run_id, CASE WHEN bool_and(verdict = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS overall, {_COUNTS} FROM g6 GROUP BY 1")
def v07(spark, d):
    six, _ = ga.route(gate_runs(spark, d))
    return ga.overall_modulator(ga.evaluate(six, ga.modulator_gates()))


@query("v08_v14_directional_gates", f"WITH {BOTH_GATES} SELECT * FROM g13")
def v08(spark, d):
    _, thirteen = ga.route(gate_runs(spark, d))
    return ga.evaluate(thirteen, ga.directional_gates())


_D_OVERALL = f"SELECT run_id, CASE WHEN count(*) FILTER (gate_number <= 7 AND verdict = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (verdict <> 'PASS') = 0 THEN 'PASS' ELSE 'CONDITIONAL_PASS' END AS overall, {_COUNTS} FROM g13 GROUP BY 1"


@query("v16_directional_overall", f"WITH {BOTH_GATES} {_D_OVERALL}")
def v16(spark, d):
    _, thirteen = ga.route(gate_runs(spark, d))
    return ga.overall_directional(ga.evaluate(thirteen, ga.directional_gates()))


@query("v17_route_and_verdict", f"""WITH {BOTH_GATES}
    SELECT *, 'modulator' AS gate_set FROM (SELECT run_id, CASE WHEN bool_and(verdict = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS overall, {_COUNTS} FROM g6 GROUP BY 1)
    UNION ALL SELECT *, 'directional' FROM ({_D_OVERALL})""")
def v17(spark, d):
    return ga.verdicts(gate_runs(spark, d))
