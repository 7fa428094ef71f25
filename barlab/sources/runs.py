"""Run records, their registry projection and metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def deployment_ready(n_derived_inputs: Column, label_is_derived: Column, n_base_models: Column, meta_label: Column) -> Column:
    return ~((n_derived_inputs > 0) | label_is_derived | ((n_base_models > 1) & meta_label))


def content_sha(identity: Sequence[str]) -> Column:
    """SHA-256 of the identity columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(identity)])), 256)


def run_manifest(runs: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Stamps each run row with its content hash, readiness and record version."""
    ready = deployment_ready(
        F.col("n_derived_inputs"), F.col("label_is_derived"), F.col("n_base_models"), F.col("meta_label")
    )
    return runs.withColumn("content_sha256", content_sha(identity)).withColumn(
        "deployment_ready", ready).withColumn("payload_version", F.lit(2))


def register_idempotent(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: one per new content hash; a replay of a known hash adds nothing."""
    fresh = incoming.join(existing.select("content_sha256").distinct(), "content_sha256", "left_anti")
    rest = [c for c in fresh.columns if c != "content_sha256"]
    one = fresh.groupBy("content_sha256").agg(F.min(F.struct(*rest)).alias("_r"))
    return one.select("content_sha256", *[F.col(f"_r.{c}").alias(c) for c in rest])


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def flatten_run_metrics(runs: DataFrame) -> DataFrame:
    """Nested run metrics to (run_id, name, value, fold_idx).

    ``runs``: run_id, metrics MAP, primary_mean, primary_median, primary_std, metric_means MAP,
    folds ARRAY<STRUCT<fold, metrics MAP>>.
    """
    no_fold = F.lit(None).cast("int").alias("fold_idx")
    scalars = F.create_map(*[x for c in ("primary_mean", "primary_median", "primary_std")
                             for x in (F.lit(f"wf_{c}"), F.col(c))])
    means = F.transform_keys("metric_means", lambda k, v: F.concat(F.lit("wf_mean_"), k))
    run_level = F.array(*[F.coalesce(m, F.create_map().cast("map<string,double>"))
                          for m in (F.col("metrics"), scalars, means)])
    entries = F.flatten(F.transform(run_level, F.map_entries))
    top = runs.select("run_id", F.explode(entries).alias("e")).select(
        "run_id", F.col("e.key").alias("name"), F.col("e.value").alias("value"), no_fold)
    per_fold = runs.select("run_id", F.explode("folds").alias("f")).filter(F.col("f.fold").isNotNull()).select(
        "run_id", F.explode("f.metrics").alias("name", "value"), F.col("f.fold").cast("int").alias("fold_idx"))
    return top.filter(F.col("value").isNotNull()).unionByName(per_fold.select("run_id", "name", "value", "fold_idx"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def drop_non_finite(metrics: DataFrame) -> DataFrame:
    return metrics.filter(finite(F.col("value")))


def dropped_counts(metrics: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.count_if(finite(F.col("value"))).alias("n_logged"), F.count_if(~finite(F.col("value"))).alias("n_dropped"))


def summary_tags(verdict: Column, ready: Column, eval_kind: Column) -> Column:
    tags = F.create_map(
        F.lit("gauntlet_verdict"), verdict, F.lit("deployment_ready"), ready.cast("string"), F.lit("eval_kind"), eval_kind
    )
    return F.map_filter(tags, lambda k, v: v.isNotNull())


def top_k_trials(trials: DataFrame, k: int, keys: Sequence[str] = ("spec",)) -> DataFrame:
    """Best complete trials, earlier trial first on a tie; a spec with fewer than ``k`` fails the query."""
    complete = trials.filter(F.col("state") == "COMPLETE")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "trial_number"))
    best = complete.withColumn("rank", rank).filter(F.col("rank") <= k)
    counts = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = F.raise_error(F.concat(F.lit("too few complete trials: "), F.col("_n").cast("string"))).cast("boolean")
    return best.join(counts, list(keys)).filter(F.when(F.col("_n") < k, short).otherwise(F.lit(True))).drop("_n")


def best_run(trials: DataFrame, metric: str = "score", keys: Sequence[str] = ("spec",)) -> DataFrame:
    """First trial with the largest metric; NaN never wins and all-NaN fails the query."""
    value = F.when(F.col(metric).isNull() | F.isnan(metric), float("-inf")).otherwise(F.col(metric))
    best = trials.groupBy(*keys).agg(
        F.max(value).alias("best_value"), F.max_by("trial_number", F.struct(value, -F.col("trial_number"))).alias("best_trial"))
    none = F.raise_error("every trial of a spec is NaN").cast("double")
    return best.withColumn("best_value", F.when(F.col("best_value") == float("-inf"), none).otherwise(F.col("best_value")))


def sweep_counts(trials: DataFrame, keys: Sequence[str] = ("spec",), baseline_trial: int = 0) -> DataFrame:
    """Trials per end state, best complete score and its gain over the baseline trial."""
    done = F.col("state") == "COMPLETE"
    score = F.when(done & finite(F.col("score")), F.col("score"))
    base = F.max(F.when(F.col("trial_number") == baseline_trial, score))
    counts = trials.groupBy(*keys).agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in ("COMPLETE", "PRUNED", "FAIL")],
        F.max(score).alias("best_score"), base.alias("baseline_score"),
    )
    none = F.raise_error("no complete trial has a finite score").cast("double")
    return counts.withColumn("best_score", F.coalesce(F.col("best_score"), none)).withColumn(
        "improvement", F.round(F.col("best_score") - F.col("baseline_score"), 6))
