"""Walk-forward evaluation: guards and statistics for all folds in one job each, then one distributed
fit per usable fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from barlab.operators.align import INTERVAL_CODES, filter_serving_interval
from barlab.operators.folds import fold_aggregate, metric_means
from barlab.operators.invariance import bin_shifts, summarize
from barlab.operators.selection import select_features
from barlab.operators.splits import split_chronological
from barlab.plans.foldstore import FoldStore
from barlab.plans.models import PRIMARY, ModelSpec, evaluate, fit, predict
from barlab.session import cut_lineage


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), names, "metric", "value")


class WalkForward:
    """Result tables of one run: ``guards``, ``oof``, ``metrics`` (long), ``models``, ``selected``, ``configured``, the
    number of folds that were asked for, and ``store``, the rows by fold window."""

    def __init__(self, spec, guards, oof, metrics, models, selected, configured, store):
        self.spec, self.guards, self.oof, self.metrics, self.store = spec, guards, oof, metrics, store
        self.models, self.selected, self.configured = models, selected, configured

    @property
    def primary(self) -> str:
        return PRIMARY[self.spec.objective]

    def summary(self) -> DataFrame:
        """One row, also where no fold has a finite primary metric; its statistics are null then."""
        counts = self.guards.agg(
            F.lit(self.configured).cast("long").alias("n_folds_configured"), F.count(F.lit(1)).alias("n_folds_generated"), F.count_if(F.col("skipped_reason").isNull()).alias("n_folds_run"))
        found = fold_aggregate(self.metrics, self.primary)
        run = counts.withColumn("run_id", F.lit(self.spec.name)).join(F.broadcast(found), "run_id", "left").fillna(0, ["n_folds_valid"])
        return run.select(*found.columns, *counts.columns)

    def headline(self) -> DataFrame:
        return metric_means(self.metrics, self.primary)

    def last_model(self) -> PipelineModel:
        return self.models[max(self.models)]


def run_walk_forward(
    rows: DataFrame, folds: DataFrame, spec: ModelSpec, row: Sequence[str] = ("symbol", "ts"), select: int | None = None,
    ts: str = "ts", carry: Sequence[str] = (), n_configured: int | None = None, must_run: bool = True,
) -> WalkForward:
    """``rows``: row key, ts, features, y. ``folds``: one fold table (a few rows).

    The rows are written once by month (``FoldStore``); a fold reads the months of its windows and the guards add up cells, so
    no row is copied into the folds that hold it. Test rows are those at the serving interval, for the guards and for
    the invariance statistics as well, which look at the features a fold selected. Fold fits run one after another, each
    distributed; predictions are cut from the models' lineage by a reliable checkpoint, so losing an executor does not
    refit anything. A run without a finite primary metric in any fold is an error, unless ``must_run`` is off: then its tables
    hold what there is, ``guards`` the reasons.
    """
    store = FoldStore(rows, folds, ts)
    serves = None if "interval_indicator" not in rows.columns else F.col("interval_indicator") == INTERVAL_CODES[spec.interval]
    guards = cut_lineage(store.guard(spec.objective, served=serves))
    usable = [r.fold for r in guards.filter(F.col("skipped_reason").isNull()).select("fold").orderBy("fold").collect()]
    configured = folds.count() if n_configured is None else n_configured
    out = "probs" if spec.objective == "multiclass" else "predicted"
    if not usable:
        if must_run:
            raise ValueError(f"no usable fold for {spec.name}")
        score = F.lit(None).cast("array<double>" if out == "probs" else "double").alias(out)
        oof = store.rows.limit(0).select(F.lit(0).alias("fold"), *row, *carry, "y", score)
        metrics = rows.sparkSession.createDataFrame([], "fold int, metric string, value double, run_id string")
        return WalkForward(spec, guards, oof, metrics, {}, {}, configured, store)
    parts, models, selected = [], {}, {}
    for k in usable:
        train, test = store.window(k, "train"), filter_serving_interval(store.window(k, "test"), spec.interval)
        chosen = spec
        if select:
            from dataclasses import replace

            chosen = replace(spec, features=tuple(select_features(train, spec.features, max_features=select)))
        models[k], selected[k] = fit(train.drop("role"), chosen, (ts,)), chosen.features
        parts.append(predict(models[k], test, chosen).select("fold", *row, *carry, "y", out))
    oof = cut_lineage(reduce(DataFrame.unionByName, parts))
    scored = long_metrics(evaluate(oof, spec, ["fold"]), ["fold"])
    own = [bin_shifts(store.window(k, "train").unionByName(filter_serving_interval(store.window(k, "test"), spec.interval)),
                      ["fold"], selected[k], spec.objective) for k in usable]
    shifts = summarize(reduce(DataFrame.unionByName, own), ["fold"])
    invariance = long_metrics(shifts.withColumn("n_pairs", F.col("n_pairs").cast("double")), ["fold"])
    metrics = scored.unionByName(invariance).withColumn("run_id", F.lit(spec.name))
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    if must_run and scored.filter((F.col("metric") == PRIMARY[spec.objective]) & finite).isEmpty():
        raise ValueError(f"no fold of {spec.name} has a finite {PRIMARY[spec.objective]}")
    return WalkForward(spec, guards, oof, metrics, models, selected, configured, store)


def holdout(rows: DataFrame, spec: ModelSpec, val_fraction: float = 0.2, order: Sequence[str] = ("ts",)) -> tuple[PipelineModel, DataFrame]:
    """Chronological split, fit on the head, metrics of the tail at the serving interval."""
    split = cut_lineage(split_chronological(rows, val_fraction, (), order))
    model = fit(split.filter("role = 'train'").drop("role"), spec, order)
    val = filter_serving_interval(split.filter("role = 'val'"), spec.interval)
    return model, evaluate(predict(model, val, spec), spec)
