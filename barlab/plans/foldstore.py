"""Rows of a walk-forward run, written once by month, and additive cells for statistics of its windows."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from barlab.operators.calibration import calibration_bin
from barlab.session import cut_lineage, shared_folder

WINDOW_COLUMNS = ("train_start", "train_end", "test_start", "test_end")


class FoldStore:
    """``rows`` in a Parquet table partitioned by month. A window is read by partition and row-group pruning; rows are never copied
    into the folds that hold them.

    ``folds`` is one fold table, a few rows by construction. The cells (class, score range and the stretch of a day between two
    fold bounds) lie wholly inside or outside every window whatever hour a fold begins, so windows add them up exactly.
    """

    def __init__(self, rows: DataFrame, folds: DataFrame, ts: str = "ts", files_per_month: int = 16):
        spark = rows.sparkSession
        if {"_month", "_cell"} & set(rows.columns):
            raise ValueError("_month and _cell are names of the store")
        self.ts, self.folds = ts, folds
        self.windows: list[Row] = folds.select("fold", *WINDOW_COLUMNS).orderBy("fold").collect()
        self.path = f"{shared_folder(spark)}/folds-{uuid.uuid4().hex}"
        monthly = rows.withColumn("_month", F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("none")))
        dealt = monthly.repartition("_month", F.pmod(F.xxhash64(ts), F.lit(files_per_month)))
        dealt.write.partitionBy("_month").option("compression", "zstd").parquet(self.path)
        self._table = spark.read.schema(monthly.schema).parquet(self.path)
        self._cells: dict = {}

    @property
    def rows(self) -> DataFrame:
        return self._table.drop("_month")

    def between(self, start, end) -> DataFrame:
        """The rows of [start, end): only the partitions of its months are listed and read."""
        low, high = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
        months = (F.col("_month") >= F.lit(f"{start:%Y-%m}")) & (F.col("_month") <= F.lit(f"{end:%Y-%m}"))
        return self._table.filter(months & (F.col(self.ts) >= low) & (F.col(self.ts) < high)).drop("_month")

    def window(self, fold: int, role: str) -> DataFrame:
        """The train or test rows of a fold, with ``fold`` and ``role``."""
        w = next(w for w in self.windows if w.fold == fold)
        return self.between(w[f"{role}_start"], w[f"{role}_end"]).withColumn("fold", F.lit(fold)).withColumn("role", F.lit(role))

    def cells(self, y: str = "y", score: str | None = None, n_bins: int = 10, served: Column | None = None) -> DataFrame:
        """(_cell, class, bin): rows, served rows and score sums, from one pass over the store; kept for further calls."""
        key = (y, score, n_bins)
        if key not in self._cells:
            bounds = sorted({w[c] for w in self.windows for c in WINDOW_COLUMNS})
            stamp = F.col(self.ts).cast("timestamp_ntz")
            day = F.date_trunc("day", stamp).cast("timestamp_ntz")
            crossed = F.array_max(F.filter(F.array(*[F.lit(b).cast("timestamp_ntz") for b in bounds]), lambda b: b <= stamp))
            p = F.col(score) if score else F.lit(None).cast("double")
            clip = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
            hit = F.col(y).cast("double") >= 0.5
            self._cells[key] = cut_lineage(self.rows.groupBy(
                F.greatest(day, crossed).alias("_cell"), F.col(y).alias("class"), calibration_bin(p, n_bins).alias("bin")).agg(
                F.count(F.lit(1)).alias("n"), F.count_if(F.lit(True) if served is None else served).alias("n_served"), F.count(p).alias("n_scored"), F.sum(p).alias("p"),
                F.sum((p - F.col(y)) * (p - F.col(y))).alias("square"), F.sum(-F.when(hit, F.log(clip)).otherwise(F.log(1 - clip))).alias("loss"),
                F.count_if((p >= 0.5) == hit).alias("hits")))
        return self._cells[key]

    def sums(self, cells: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
        """(fold, role, by): ``aggs`` over the cells of every window. The windows are literals; a cell meets those that hold it."""
        spans = [(w.fold, role, w[f"{role}_start"], w[f"{role}_end"]) for w in self.windows for role in ("train", "test")]
        at = F.col("_cell")
        holding = [F.when((at >= F.lit(lo).cast("timestamp_ntz")) & (at < F.lit(hi).cast("timestamp_ntz")), F.struct(F.lit(k).alias("fold"), F.lit(role).alias("role")))
                   for k, role, lo, hi in spans]
        placed = cells.withColumn("_w", F.explode(F.array_compact(F.array(*holding))))
        return placed.groupBy(F.col("_w.fold").alias("fold"), F.col("_w.role").alias("role"), *by).agg(*[c.alias(n) for n, c in aggs.items()])

    def scores(self, y: str, score: str, n_bins: int = 10) -> DataFrame:
        """(fold, role): n, class1_rate, pred_mean, brier, log_loss, accuracy and ece of a stored score, from cells alone. Rows without a score do not count."""
        cells = self.cells(y, score, n_bins).filter("n_scored > 0")
        positives = F.sum(F.when(F.col("class").cast("double") >= 0.5, F.col("n_scored")).otherwise(0))
        total = ("n_scored", "p", "square", "loss", "hits")
        bins = self.sums(cells, ["bin"], {**{c: F.sum(c) for c in total}, "positives": positives})
        gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("p") - F.col("positives"))))
        binned = F.sum(F.when(F.col("bin").isNotNull(), F.col("n_scored")))
        n = F.sum("n_scored")
        return bins.groupBy("fold", "role").agg(
            n.alias("n"), (F.sum("positives") / n).alias("class1_rate"), (F.sum("p") / n).alias("pred_mean"), (F.sum("square") / n).alias("brier"),
            (F.sum("loss") / n).alias("log_loss"), (F.sum("hits") / n).alias("accuracy"), (gap / binned).alias("ece"))

    def guard(self, objective: str, y: str = "y", n_classes: int = 3, served: Column | None = None) -> DataFrame:
        """Rows and classes of every fold side and the reason a fold cannot be fitted (null: it can), from cells alone."""
        sides = self.sums(self.cells(y, served=served), ["class"], {"n": F.sum("n"), "n_served": F.sum("n_served")})
        side = lambda role, c: F.when(F.col("role") == role, c)
        counts = sides.groupBy("fold").agg(
            F.sum(side("train", F.col("n"))).alias("n_train"), F.sum(side("test", F.col("n"))).alias("n_test"),
            F.count_distinct(side("train", F.col("class"))).alias("train_classes"), F.count_distinct(side("test", F.col("class"))).alias("test_classes"),
            F.sum(side("test", F.col("n_served"))).alias("_served"))
        full = self.folds.select("fold").join(counts, "fold", "left").fillna(0)
        reason = F.when(F.col("n_train") == 0, "empty_train_window").when(F.col("n_test") == 0, "empty_test_window")
        if objective in ("binary", "multiclass"):
            need, why = (2, "single_class_train_set") if objective == "binary" else (n_classes, "insufficient_classes_in_train_set")
            reason = reason.when(F.col("train_classes") < need, why).when(F.col("test_classes") < 2, "single_class_test_set")
        reason = reason.when(F.col("_served") == 0, "empty_test_window_after_interval_filter")
        return full.withColumn("skipped_reason", reason).drop("_served")
