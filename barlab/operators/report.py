"""The report on stored predictions: every section is a roll-up of one cell table, so the predictions are read once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from barlab.operators.attach import attach
from barlab.operators.calibration import bin_label, calibration_bin, fold_window_note
from barlab.operators.metrics import binary_metrics
from barlab.session import cut_lineage

ZONES = ("last_fold", "post")


def fold_windows(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``_tests``, its test windows, the bounds of the last one and the end of the saved model's training."""
    window = F.struct(F.col("fold"), F.col("test_start").alias("lo"), F.col("test_end").alias("hi"))
    return folds.groupBy(*keys).agg(
        F.array_sort(F.collect_list(window)).alias("_tests"), F.max("fold").alias("_last"), F.max_by("test_start", "fold").alias("_lo"),
        F.max_by("test_end", "fold").alias("_hi"), F.max_by("train_end", "fold").alias("_saved_end"))


def report_cells(predictions: DataFrame, folds: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "actual", p: str = "predicted") -> DataFrame:
    """(keys, month, folds, zone, score, label, n): how many predictions agree in all that any section asks for.

    The fold windows reach the rows as one array per key, through a salted join or, without keys, as a single row; a row is never
    multiplied. Rows without a score or a label do not count.
    """
    rows = predictions.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(ts).alias("_ts"), F.col(p).alias("_p"), (F.col(y) >= 0.5).cast("int").alias("_y"))
    rows = attach(rows, fold_windows(folds, keys), keys, F.col("_ts"), "left")
    inside = F.transform(F.filter("_tests", lambda w: (w["lo"] <= F.col("_ts")) & (F.col("_ts") < w["hi"])), lambda w: w["fold"])
    zone = F.when(F.col("_ts") >= F.col("_hi"), "post").when(F.col("_ts") >= F.col("_lo"), "last_fold")
    return rows.groupBy(*keys, F.date_format("_ts", "yyyy-MM").alias("month"), inside.alias("folds"), zone.alias("zone"), "_p", "_y").agg(F.count(F.lit(1)).alias("_n"))


def analysis_report(
    predictions: DataFrame, folds: DataFrame, own: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "actual", p: str = "predicted"
) -> DataFrame:
    """(keys, part, section, n, brier, log_loss, accuracy, auc, own_auc, note, ece, mean_pred, actual_rate), unused columns null.

    Parts: ``overall``; ``month``; ``fold``, the saved model in every fold's test window beside the fold's own AUC (``own``: keys, fold,
    own_auc) with a note on its training data, folds without predictions included; ``last_fold`` and ``post``, the
    honest windows; ``calibration`` and ``ece`` for all three. A group without predictions has only its ``fold`` rows.
    """
    cells = cut_lineage(report_cells(predictions, folds, keys, ts, y, p))
    section = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("section"))
    all_ = F.array(section("overall", F.lit("all")), section("month", F.col("month")), section("zone", F.col("zone")))
    per_fold = F.transform(F.coalesce("folds", F.array().cast("array<int>")), lambda k: section("fold", k.cast("string")))
    parts = cells.withColumn("_s", F.explode(F.concat(F.filter(all_, lambda s: s["section"].isNotNull()), per_fold)))
    parts = parts.select(*keys, F.col("_s.part").alias("part"), F.col("_s.section").alias("section"), "_p", "_y", "_n")
    by = [*keys, "part", "section"]
    measured = binary_metrics(parts, by, "_y", "_p", weight=F.col("_n")).select(*by, F.col("n").cast("long").alias("n"), "brier", "log_loss", "accuracy", "auc")
    fold_rows = measured.filter("part = 'fold'").select(*keys, F.col("section").cast("int").alias("fold"), "n", "brier", "log_loss", "accuracy", "auc")
    windows = fold_windows(folds, keys).drop("_tests")
    noted = folds.join(windows, list(keys)) if keys else folds.crossJoin(F.broadcast(windows))  # one row
    noted = noted.select(*keys, "fold", fold_window_note(F.col("_saved_end"), F.col("_last")).alias("note"))
    fold_rows = noted.join(fold_rows, [*keys, "fold"], "left").join(own.select(*keys, "fold", "own_auc"), [*keys, "fold"], "left").select(
        *keys, F.lit("fold").alias("part"), F.col("fold").cast("string").alias("section"), F.coalesce("n", F.lit(0)).alias("n"), "brier", "log_loss", "accuracy", "auc", "own_auc", "note")
    zone = F.when(F.col("part") == "zone", F.col("section")).otherwise(F.col("part"))
    rest = measured.filter("part <> 'fold'").select(
        *keys, zone.alias("part"), F.when(F.col("part") == "zone", "all").otherwise(F.col("section")).alias("section"), "n", "brier", "log_loss", "accuracy", "auc")
    n = F.sum("_n")
    bins = parts.filter("part in ('overall', 'zone')").withColumn("bin", calibration_bin(F.col("_p"))).filter("bin is not null").groupBy(*keys, zone.alias("_of"), "bin").agg(
        n.alias("n"), (F.sum(F.col("_p") * F.col("_n")) / n).alias("mean_pred"), (F.sum(F.col("_y") * F.col("_n")) / n).alias("actual_rate"))
    gap = F.abs(F.col("mean_pred") - F.col("actual_rate"))
    ece = bins.groupBy(*keys, "_of").agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    tables = [
        fold_rows, rest, bins.select(*keys, F.lit("calibration").alias("part"), F.concat_ws(" ", "_of", bin_label()).alias("section"), "n", "mean_pred", "actual_rate"),
        ece.select(*keys, F.lit("ece").alias("part"), F.col("_of").alias("section"), "n", "ece"),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
