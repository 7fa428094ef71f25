"""Model fits, walk-forward, search and stacking over the embedding matrix and hourly bars.

Spark's tree kernels differ from single-machine boosters, so these have no SQL; tests check structure
and statistical properties.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barlab.catalog.eval_queries import bins_sql
from barlab.catalog.inputs import (
    EMBED_FEATURES, FOLD_PARAMS, SCORES_CTE, check_matrix, embedding_cte, embedding_matrix, rounded, scores, table,
)
from barlab.catalog.registry import query
from barlab.operators.folds import generate_folds
from barlab.operators.metrics import gating_metrics, per_model_metrics
from barlab.operators.splits import encode_multiclass, meta_split
from barlab.plans import models as mo
from barlab.plans.foldstore import FoldStore
from barlab.plans.gated import run_to_gates
from barlab.plans.search import grid_search
from barlab.plans.stacking import oof_matrix, predict_stacked, train_stacker
from barlab.plans.walkforward import holdout, long_metrics, run_walk_forward
from barlab.session import cut_lineage

FEATURES = tuple(EMBED_FEATURES)
BAR_FEATURES = ("log_return_24", "volume_zscore_24", "atr_14")
SMALL = {}  # the operators' defaults


def vectors(spark, d, objective):
    """Embedding rows on an hourly clock (one row per id), with a label of the given kind."""
    e = embedding_matrix(spark, d)
    y = {"binary": (F.col("y") >= 5).cast("double"), "multiclass": F.least(F.col("y") / 4, F.lit(2)).cast("int").cast("double"),
         "regression": F.col("y").cast("double")}[objective]
    ts = F.timestamp_micros(F.lit(1704067200000000) + F.col("vec_id") * 3600000000).cast("timestamp_ntz")
    return e.select("vec_id", ts.alias("ts"), *FEATURES, y.alias("y"))


def _spec(objective, **kw):
    return mo.ModelSpec(f"emb_{objective}", objective, FEATURES, params=SMALL, **kw)


def _holdout(spark, d, objective, **kw):
    _, metrics = holdout(vectors(spark, d, objective), _spec(objective, **kw))
    return long_metrics(metrics, [])


@query("m01_fit_binary")
def m01(spark, d):
    return _holdout(spark, d, "binary")


@query("m01_fit_multiclass")
def m01_multi(spark, d):
    return _holdout(spark, d, "multiclass")


@query("m01_fit_regression")
def m01_reg(spark, d):
    return _holdout(spark, d, "regression")


@query("m02_early_stopping")
def m02(spark, d):
    return _holdout(spark, d, "binary", early_stopping=0.15, interval="4h")


@query("m02_early_stopping_multiclass")
def m02_multi(spark, d):
    """Each class stops on its own."""
    return _holdout(spark, d, "multiclass", early_stopping=0.15, interval="4h")


@query("m03_fit_ensemble")
def m03(spark, d):
    rows = meta_split(vectors(spark, d, "multiclass"))
    models = mo.fit_ensemble(rows.filter("role = 'primary'"), _spec("multiclass"))
    return per_model_metrics(mo.predict_ensemble(models, rows.filter("role = 'meta'"), ["vec_id", "y"]), ["vec_id"], list(models), mo.N_CLASSES)


@query("m04_meta_label_gating")
def m04(spark, d):
    """Primary models on the first 80 %, meta model on half of the rest (by hash), gating measured on the other half."""
    rows = meta_split(vectors(spark, d, "multiclass"))
    models = mo.fit_ensemble(rows.filter("role = 'primary'"), _spec("multiclass"))
    probas = cut_lineage(mo.predict_ensemble(models, rows.filter("role = 'meta'"), ["vec_id", "y"]))
    later = F.pmod(F.xxhash64("vec_id"), F.lit(2)) == 1
    meta = mo.fit_meta_label(probas.filter(~later), ["vec_id"])
    if meta is None:
        raise ValueError("meta rows hold a single outcome")
    return gating_metrics(mo.predict_pwin(meta, probas.filter(later), ["vec_id"]), (), "direction")


@query("m05_adversarial_auc")
def m05(spark, d):
    rows = vectors(spark, d, "binary")
    half = rows.count() // 2
    return mo.adversarial_auc(rows.filter(F.col("vec_id") < half), rows.filter(F.col("vec_id") >= half), FEATURES, ["vec_id"])


def bar_rows(spark, d):
    return check_matrix(spark, d).select("symbol", "ts", *BAR_FEATURES, "y")


def bar_folds(spark, d):
    """Folds up to the day after the last event; the first day is left to the rolling features."""
    day = F.date_trunc("day", F.min("ts")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    last = F.date_trunc("day", F.max("ts")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    window = table(spark, d, "events").agg(day.alias("start"), last.alias("end"))
    return generate_folds(window, train_days=10, test_days=6, embargo_days=1, n_folds=3)


def bar_walk(spark, d):
    return run_walk_forward(bar_rows(spark, d), bar_folds(spark, d), mo.ModelSpec("bars", "binary", BAR_FEATURES, params=SMALL))


def cell_folds(spark, d):
    """Folds over all line items together."""
    return generate_folds(scores(spark, d).agg(F.min("ts").cast("timestamp_ntz").alias("start"), F.max("ts").cast("timestamp_ntz").alias("end")), **FOLD_PARAMS)


CELL_FOLDS_SQL = """f AS (SELECT fold, test_start - INTERVAL 372 DAY AS train_start, test_start - INTERVAL 7 DAY AS train_end, test_start, test_start + INTERVAL 120 DAY AS test_end
        FROM (SELECT CAST(k AS INTEGER) AS fold, s + INTERVAL 372 DAY + INTERVAL (k * 120) DAY AS test_start, e
              FROM (SELECT min(ts) AS s, max(ts) AS e FROM scores), range(12) r(k)) WHERE test_start + INTERVAL 120 DAY <= e),
      w AS (SELECT fold, 'train' AS role, train_start AS lo, train_end AS hi FROM f UNION ALL SELECT fold, 'test', test_start, test_end FROM f),
      x AS (SELECT fold, role, least(1 - 1e-15::DOUBLE, greatest(1e-15::DOUBLE, predicted)) AS q, predicted, actual FROM scores JOIN w ON ts >= lo AND ts < hi)"""


@query("m06_fold_cells", f"""WITH {SCORES_CTE}, {CELL_FOLDS_SQL}, {bins_sql('x', 'fold, role')}, e AS (SELECT fold, role, sum(abs_gap * count) / sum(count) AS ece FROM bins GROUP BY 1, 2)
    SELECT fold, role, count(*) AS n, round(avg(actual), 6) AS class1_rate, round(avg(predicted), 4) AS pred_mean, round(avg(pow(actual - predicted, 2)), 6) AS brier,
      round(avg(-(actual * ln(q) + (1 - actual) * ln(1 - q))), 6) AS log_loss, round(avg(CASE WHEN (predicted >= 0.5) = (actual >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
      round(any_value(ece), 6) AS ece FROM x JOIN e USING (fold, role) GROUP BY 1, 2""")
def m06_cells(spark, d):
    """Statistics of every fold window from additive cells."""
    store = FoldStore(scores(spark, d).select("ts", "predicted", "actual"), cell_folds(spark, d))
    out = store.scores("actual", "predicted")
    return out.select("fold", "role", "n", rounded("pred_mean", 4).alias("pred_mean"), *[rounded(c).alias(c) for c in ("class1_rate", "brier", "log_loss", "accuracy", "ece")])


@query("m06_fold_guards", f"""WITH {SCORES_CTE}, {CELL_FOLDS_SQL}
    SELECT fold, n_train, n_test, train_classes, test_classes, CASE WHEN n_train = 0 THEN 'empty_train_window' WHEN n_test = 0 THEN 'empty_test_window'
      WHEN train_classes < 2 THEN 'single_class_train_set' WHEN test_classes < 2 THEN 'single_class_test_set' END AS skipped_reason
    FROM (SELECT f.fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, count(DISTINCT actual) FILTER (role = 'train') AS train_classes,
            count(DISTINCT actual) FILTER (role = 'test') AS test_classes FROM f LEFT JOIN x USING (fold) GROUP BY 1)""")
def m06_guards(spark, d):
    """The guards of a walk-forward run from additive cells."""
    return FoldStore(scores(spark, d).select("ts", "actual"), cell_folds(spark, d)).guard("binary", "actual")


@query("m06_walk_forward")
def m06(spark, d):
    return bar_walk(spark, d).metrics


@query("m07_capture_oof")
def m07(spark, d):
    return bar_walk(spark, d).oof.select("fold", "symbol", "ts", rounded("predicted").alias("prediction"))


@query("m08_walk_forward_headline")
def m08(spark, d):
    return bar_walk(spark, d).summary()


def gated_bars(spark, d):
    """Three-class barrier labels of all bars, from checks to gates."""
    rows = check_matrix(spark, d).select("symbol", "ts", *BAR_FEATURES, encode_multiclass(F.col("y3")).cast("double").alias("y")).filter("y is not null")
    spec = mo.ModelSpec("bars3", "multiclass", BAR_FEATURES)
    return run_to_gates(rows, bar_folds(spark, d), spec, F.max("ts").over(Window.partitionBy("symbol")), "directional", vol="volume_zscore_24", trend="log_return_24",
                        n_trials=10, trial_variance=0.002, adversarial_iter=None)


@query("m08_run_to_gates")
def m08_gates(spark, d):
    return gated_bars(spark, d).gate_rows()


@query("m09_holdout_80_20")
def m09(spark, d):
    rows = bar_rows(spark, d)
    return long_metrics(holdout(rows, mo.ModelSpec("bars", "binary", BAR_FEATURES, params=SMALL), order=("ts", "symbol"))[1], [])


@query("m10_grid_search")
def m10(spark, d):
    rows = meta_split(vectors(spark, d, "binary"))
    return grid_search(rows.filter("role = 'primary'"), rows.filter("role = 'meta'"), _spec("binary"), {"maxDepth": [2, 3], "maxIter": [3, 5]})


@query("g49_importance_top10")
def g49(spark, d):
    rows = vectors(spark, d, "binary")
    spec = _spec("binary")
    top = mo.importances({"a": mo.fit(rows, spec), "b": mo.fit(rows, mo.ModelSpec("c", "binary", FEATURES, params={**SMALL, "maxDepth": 2}))}, FEATURES)
    return spark.createDataFrame(top, "feature string, importance double")


@query("m11_assemble_oof_matrix")
def m11(spark, d):
    rows, oof = _two_walks(spark, d)
    return oof_matrix(oof, rows, ["deep", "shallow"], ["symbol", "ts"])


def _two_walks(spark, d):
    rows = cut_lineage(bar_rows(spark, d))
    deep = run_walk_forward(rows, bar_folds(spark, d), mo.ModelSpec("deep", "binary", BAR_FEATURES, params=SMALL))
    flat = run_walk_forward(rows, bar_folds(spark, d), mo.ModelSpec("shallow", "binary", BAR_FEATURES, params={"maxIter": 3, "maxDepth": 1}))
    tag = lambda w: w.oof.select(F.lit(w.spec.name).alias("model"), "fold", "symbol", "ts", F.col("predicted").alias("prediction"))
    return rows.select("symbol", "ts", "y"), tag(deep).unionByName(tag(flat))


@query("m12_train_stacker")
def m12(spark, d):
    rows, oof = _two_walks(spark, d)
    matrix = cut_lineage(oof_matrix(oof, rows, ["deep", "shallow"], ["symbol", "ts"]))
    lo, hi = matrix.agg(F.min("ts"), F.max("ts")).first()
    held = F.col("ts") >= F.lit(lo + (hi - lo) / 2).cast("timestamp_ntz")  # fitted on the earlier half, scored on the later
    model = train_stacker(matrix.filter(~held), ["deep", "shallow"], "binary")
    scored = predict_stacked(model, matrix.filter(held), ["deep", "shallow"]).withColumn("predicted", F.col("stacked"))
    return mo.eval_binary(scored, (), "y")


@query("u07_adversarial_union", f"""WITH {embedding_cte()}, h AS (SELECT *, CASE WHEN vec_id < (SELECT count(*) // 2 FROM emb) THEN 0.0 ELSE 1.0 END::DOUBLE AS side FROM emb)
    SELECT side AS y, count(*) AS n, {", ".join(f"round(avg({f}), 6) AS {f}" for f in EMBED_FEATURES)} FROM h GROUP BY 1""")
def u07(spark, d):
    """The union that adversarial validation learns from, summed up per side."""
    e = vectors(spark, d, "binary").drop("y")
    half = e.count() // 2
    both = mo.labelled_union(e.filter(F.col("vec_id") < half), e.filter(F.col("vec_id") >= half), ["vec_id", *FEATURES])
    return both.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[rounded(F.avg(f)).alias(f) for f in FEATURES])
