"""Pass/fail gates over one row of aggregated metrics per run.

A gate is a column expression; all gates of a run are evaluated together and unfolded to rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlab.operators.invariance import PASS_THRESHOLD

# Thresholds per primary metric, and the directional gates' bounds.
EDGE = {"auc": 0.52, "pearson_r": 0.05}
STABILITY = {"auc": 0.15, "pearson_r": 0.20}
BASELINE = {"auc": 0.5, "pearson_r": 0.0}
DIRECTIONAL_EDGE = 0.55
CI_LOWER = 0.50

RUN_COLUMNS = {
    "run_id": "string", "objective": "string", "purpose": "string", "primary_metric": "string",
    "integrity_verdict": "string", "n_folds_configured": "long", "n_folds_generated": "long", "n_folds_run": "long",
    "n_folds_valid": "long", "primary_mean": "double", "primary_median": "double", "primary_std": "double",
    "last_value": "double", "ci_max_abs_diff": "double", "ci_lower_5": "double", "realistic_profitable": "double",
    "conservative_profitable": "double", "regime_pass": "double", "regime_caveat": "double", "dsr_pass": "double",
    "dsr_discount": "double",
}

# Checks a person or another system performs; always SKIP.
MANUAL_GATES = (
    "capacity_stress", "retraining_stability", "shadow_validation", "reviewer_approval", "operator_approval",
    "cross_asset_sanity",
)


def with_run_columns(runs: DataFrame) -> DataFrame:
    """Adds missing metric columns as null and turns NaN and infinities into null."""
    out = []
    for name, kind in RUN_COLUMNS.items():
        c = F.col(name) if name in runs.columns else F.lit(None)
        c = c.cast(kind)
        out.append((F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) if kind == "double" else c).alias(name))
    return runs.select(*out)


def _lookup(table: dict[str, float], key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(key))


def _verdict(passed: Column, skip: Column | None = None) -> Column:
    verdict = F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")
    return verdict if skip is None else F.when(skip, "SKIP").otherwise(verdict)


def _integrity() -> Column:
    return _verdict(F.col("integrity_verdict") != "FAIL")


def _transferability() -> Column:
    return _verdict(F.col("ci_max_abs_diff") < _lookup(PASS_THRESHOLD, "objective"))


def modulator_gates() -> dict[str, Column]:
    """Six gates for binary and regression models. A median that is absent does not count against a run."""
    edge, stable, base = (_lookup(t, "primary_metric") for t in (EDGE, STABILITY, BASELINE))
    n = F.col("n_folds_configured")
    complete = (n > 0) & (n == F.col("n_folds_generated")) & (n == F.col("n_folds_run")) & (n == F.col("n_folds_valid"))
    median_ok = F.col("primary_median").isNull() | (F.col("primary_median") >= edge)
    return {
        "integrity_passed": _integrity(),
        "walk_forward_complete": _verdict(complete),
        "generalization_edge": _verdict((F.col("primary_mean") >= edge) & median_ok, edge.isNull()),
        "fold_stability": _verdict(F.col("primary_std") <= stable, stable.isNull()),
        "saved_model_above_random": _verdict(F.col("last_value") >= base, base.isNull()),
        "transferability": _transferability(),
    }


def directional_gates() -> dict[str, Column]:
    """Seven computed gates plus six manual ones for directional and multiclass models."""
    computed = {
        "baseline_edge": _verdict(F.col("primary_mean") > DIRECTIONAL_EDGE),
        "pit_no_leak": _integrity(),
        "bootstrap_ci_lower": _verdict(F.col("ci_lower_5") > CI_LOWER),
        "transferability": _transferability(),
        "cost_regime_profitable": _verdict(
            (F.col("realistic_profitable") >= 1.0) & (F.col("conservative_profitable") >= 1.0)
        ),
        "regime_subcut": _verdict((F.col("regime_pass") >= 1.0) & (F.col("regime_caveat") <= 0.0)),
        "dsr": _verdict(F.col("dsr_pass") >= 1.0),
    }
    return {**computed, **{g: F.lit("SKIP") for g in MANUAL_GATES}}


def evaluate(runs: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(run_id, gate_number, gate, verdict)."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("gate_number"), F.lit(g).alias("gate"), v.alias("verdict"))
        for i, (g, v) in enumerate(gates.items(), 1)
    ])
    return with_run_columns(runs).select("run_id", F.explode(rows).alias("g")).select("run_id", "g.*")


def is_directional() -> Column:
    return (F.col("objective") == "multiclass") | (F.coalesce(F.col("purpose"), F.lit("")) == "directional")


def route(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs for the six-gate set, runs for the directional set)."""
    directional = F.coalesce(is_directional(), F.lit(False))
    return runs.filter(~directional), runs.filter(directional)


def _counts(gates: DataFrame) -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("PASS", "FAIL", "SKIP")]


def overall_modulator(gates: DataFrame) -> DataFrame:
    """PASS only if every gate passes; a skipped gate fails the run."""
    return gates.groupBy("run_id").agg(
        F.when(F.every(F.col("verdict") == "PASS"), "PASS").otherwise("FAIL").alias("overall"), *_counts(gates)
    )


def overall_directional(gates: DataFrame) -> DataFrame:
    manual = F.col("gate").isin(list(MANUAL_GATES))
    failed = F.count_if(~manual & (F.col("verdict") == "FAIL")) > 0
    clean = F.every(manual | (F.col("verdict") == "PASS")) & (F.count_if(F.col("verdict") == "SKIP") == 0)
    return gates.groupBy("run_id").agg(
        F.when(failed, "FAIL").when(clean, "PASS").otherwise("CONDITIONAL_PASS").alias("overall"), *_counts(gates)
    )


def verdicts(runs: DataFrame) -> DataFrame:
    """Overall verdict of every run under the gate set its specification calls for."""
    six, thirteen = route(runs)
    a = overall_modulator(evaluate(six, modulator_gates())).withColumn("gate_set", F.lit("modulator"))
    b = overall_directional(evaluate(thirteen, directional_gates())).withColumn("gate_set", F.lit("directional"))
    return a.unionByName(b)
