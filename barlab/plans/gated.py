"""From a data set to a verdict: checks, walk-forward, trading statistics of the out-of-fold rows, gates, run record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barlab.operators import gates
from barlab.operators import integrity as it
from barlab.operators.bootstrap import bootstrap_macro_auc
from barlab.operators.metrics import argmax
from barlab.operators.neighbours import neighbour_information
from barlab.operators.pnl import add_regimes, cost_regime_metrics, regime_gate, regime_subcuts, round_trip_cost, trade_pnl
from barlab.operators.sharpe import deflated_sharpe
from barlab.plans.dataset import check_embargo
from barlab.plans.models import N_CLASSES, ModelSpec, adversarial_auc
from barlab.plans.walkforward import WalkForward, run_walk_forward
from barlab.session import cut_lineage
from barlab.sources.runs import run_manifest

VAL_FRACTION = 0.2
IDENTITY = ("run_id", "objective", "purpose", "features", "data_fingerprint")


@dataclass
class TradingTables:
    """Per-fold cost regimes, regime subcuts and deflated Sharpe of one run, and the numbers its gates ask for (one row)."""

    costs: DataFrame
    subcuts: DataFrame
    sharpe: DataFrame
    summary: DataFrame


@dataclass
class GatedRun:
    """All tables of a run; ``run`` is its one row of gate inputs, ``record`` the same with content hash and readiness."""

    walk: WalkForward
    checks: DataFrame
    metrics: DataFrame
    trading: TradingTables | None
    run: DataFrame
    record: DataFrame

    def gate_rows(self) -> DataFrame:
        """(run_id, gate_number, gate, verdict, note); the note says where a Sharpe ratio was judged without a discount for trials,
        and at the first gate on fold metrics why no fold could be fitted."""
        six, thirteen = gates.route(self.run)
        rows = gates.evaluate(six, gates.modulator_gates()).unionByName(gates.evaluate(thirteen, gates.directional_gates()))
        plain = gates.with_run_columns(self.run).select("run_id", (F.coalesce("dsr_discount", F.lit(0.0)) == 0).alias("_plain"))
        idle = self.walk.guards.agg(F.when(F.every(F.col("skipped_reason").isNotNull()), F.concat(
            F.lit("no fold could be fitted: "), F.array_join(F.array_sort(F.collect_set("skipped_reason")), ", "))).alias("_idle"))  # one row
        note = F.when((F.col("gate") == "dsr") & F.col("_plain") & F.col("_idle").isNull(), "no discount for the number of trials is active").when(
            F.col("gate").isin("baseline_edge", "walk_forward_complete"), F.col("_idle"))
        return rows.join(plain, "run_id").join(F.broadcast(idle)).withColumn("note", note).drop("_plain", "_idle")

    def verdict(self) -> DataFrame:
        return gates.verdicts(self.run)


def dataset_checks(rows: DataFrame, spec: ModelSpec, end: Column, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The checks that suit the objective, as (check, severity, actual)."""
    features = list(spec.features)
    if spec.objective == "binary":
        return it.check_suite(rows, features, features, end, VAL_FRACTION, (), order)
    common = [it.min_rows(rows), it.constant_features(rows, features), it.stale_tail(rows.withColumn("_end", end), features, F.col("_end"))]
    if spec.objective == "multiclass":
        return it.combine([*common, it.multiclass_class_balance(rows), it.label_leakage(neighbour_information(rows, features))])
    return it.combine([*common, it.regression_label_distribution(rows), it.label_leakage(it.leakage_pearson(rows, features))])


def trading_statistics(
    oof: DataFrame, train: DataFrame, interval: str, vol: str, trend: str, n_trials: int = 1, trial_variance: float = 1.0,
    take: Column | None = None, replicates: int = 1000, row: Sequence[str] = ("symbol", "ts"),
) -> TradingTables:
    """What trading the out-of-fold classes would have earned. ``oof``: run_id, fold, row, y, probs, vol, trend; ``train``: run_id, vol, trend of
    the rows before the first test window, whose quantiles cut the regimes.

    The rows are judged by cost regime per fold and over the run, by market regime, by deflated Sharpe and by the bootstrap of
    the macro AUC; each is one grouped aggregate over the same stored trades.
    """
    picked = oof.withColumn("pred", argmax(F.col("probs"))).withColumn("take", F.lit(True) if take is None else take)
    trades = cut_lineage(trade_pnl(picked, F.lit(interval)))
    costs = cost_regime_metrics(trades, ["run_id", "fold"])
    profitable = lambda regime: F.max(F.when(F.col("regime") == regime, F.col("profitable")))
    whole = cost_regime_metrics(trades, ["run_id"]).groupBy("run_id").agg(
        profitable("realistic").alias("realistic_profitable"), profitable("conservative").alias("conservative_profitable"))
    sides = train.select("run_id", F.col(vol), F.col(trend), F.lit("train").alias("role")).unionByName(
        trades.withColumn("role", F.lit("test")), allowMissingColumns=True)
    subcuts = regime_subcuts(add_regimes(sides, ["run_id"], vol, trend), ["run_id"])
    regimes = regime_gate(subcuts, ["run_id"]).select("run_id", F.col("gate_pass").alias("regime_pass"), F.col("gate_caveat").alias("regime_caveat"))
    net = trades.filter("traded").withColumn("net_bps", F.col("gross_bps") - round_trip_cost())
    sharpe = deflated_sharpe(net, ["run_id"], "net_bps", n_trials, trial_variance)
    boot = bootstrap_macro_auc(oof, N_CLASSES, ["run_id"], ["fold", *row], replicates=replicates)
    summary = whole.join(regimes, "run_id", "left").join(
        sharpe.select("run_id", "dsr", F.col("gate_pass").alias("dsr_pass"), F.col("discount_active").alias("dsr_discount")), "run_id", "left").join(
        boot.select("run_id", "ci_lower_5"), "run_id", "left")
    return TradingTables(costs, subcuts, sharpe, summary)


def run_to_gates(
    rows: DataFrame, folds: DataFrame, spec: ModelSpec, end: Column, purpose: str = "regime", row: Sequence[str] = ("symbol", "ts"), ts: str = "ts",
    label: str | None = None, embargo_days: float | None = None, vol: str | None = None, trend: str | None = None, n_trials: int = 1,
    trial_variance: float = 1.0, select: int | None = None, adversarial_iter: int | None = 50, replicates: int = 1000,
) -> GatedRun:
    """One call from a data set to a verdict. ``rows``: row key, features, y; ``end``: when the data should reach to.

    With ``label`` and ``embargo_days`` an embargo shorter than the label's reach is refused first. Then the checks, the walk-forward run,
    per fold the adversarial AUC of test against train rows, for three classes the trading statistics by ``vol`` and ``trend``, and the run's row
    for the gates with its record. Every table is a Spark job over all rows; the driver holds fold numbers only. Where no fold can be
    fitted, as when the data holds fewer classes than the objective, the gates on fold metrics fail and a note tells the reason.
    """
    if label is not None and embargo_days is not None:
        check_embargo(label, spec.interval, embargo_days)
    trades = spec.objective == "multiclass"
    if trades and not (vol and trend):
        raise ValueError("three classes need the vol and trend columns")
    rows = cut_lineage(rows)
    order = [ts, *[c for c in row if c != ts]]
    checks = cut_lineage(dataset_checks(rows, spec, end, order))
    carry = [c for c in (vol, trend) if c and trades]
    walk = run_walk_forward(rows, folds, spec, row, select, ts, carry, must_run=False)
    metrics = walk.metrics
    if adversarial_iter and walk.models:
        found = []
        for k in walk.models:
            a = adversarial_auc(walk.store.window(k, "train"), walk.store.window(k, "test"), walk.selected[k], row, max_iter=adversarial_iter)
            found.append(a.select(F.lit(k).alias("fold"), F.lit("adversarial_auc").alias("metric"), F.col("adversarial_auc").alias("value")))
        metrics = metrics.unionByName(reduce(DataFrame.unionByName, found).withColumn("run_id", F.lit(spec.name)))
    metrics = cut_lineage(metrics)
    means = metrics.groupBy("run_id").pivot("metric", ["ci_max_abs_diff", "adversarial_auc"]).agg(F.avg("value"))
    run = walk.summary().join(means, "run_id", "left").withColumns({
        "objective": F.lit(spec.objective), "purpose": F.lit(purpose), "primary_metric": F.lit(walk.primary)})
    run = run.crossJoin(F.broadcast(it.worst_severity(checks).select(F.col("verdict").alias("integrity_verdict"))))  # one row
    tables = None
    if trades and walk.models:
        first = min(w["test_start"] for w in walk.store.windows)
        train = rows.filter(F.col(ts) < F.lit(first).cast("timestamp_ntz")).withColumn("run_id", F.lit(spec.name))
        tables = trading_statistics(walk.oof.withColumn("run_id", F.lit(spec.name)), train, spec.interval, vol, trend, n_trials, trial_variance,
                                    replicates=replicates, row=row)
        run = run.join(tables.summary, "run_id", "left")
    run = cut_lineage(run)
    print_of = it.data_fingerprint(rows, [*row, *spec.features, "y"], (), ts).select(F.col("fingerprint").alias("data_fingerprint"))
    stamped = run.crossJoin(F.broadcast(print_of)).withColumns({  # one row
        "features": F.lit(",".join(spec.features)), "n_derived_inputs": F.lit(0), "label_is_derived": F.lit(False), "n_base_models": F.lit(1), "meta_label": F.lit(False)})
    return GatedRun(walk, checks, metrics, tables, run, run_manifest(stamped, IDENTITY))
