"""Prediction store: flattening out-of-fold rows, keyed upsert, label joins and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from barlab.operators.frames import number_rows
from barlab.session import cut_lineage

SIGNAL_KEY = ("signal_id", "symbol", "ts")
BACKFILL_SOURCE = "oof_backfill"
CHUNK_ROWS = 4096


def chunk_folds(
    rows: DataFrame, keys: Sequence[str], prediction: Column, order: Sequence[str] = ("ts",), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Predictions of each fold (``keys``) as chunks of arrays in the order given, at most ``chunk_rows`` values long.

    Columns: keys, chunk, start (place of its first value in the fold), n_test (rows of the fold), oof_timestamps, oof_predictions.
    However large a fold is, one task gathers one chunk.
    """
    placed = number_rows(rows.withColumn("_p", prediction), keys, order, "_rn", "n_test")
    value = F.struct(F.col("_rn"), F.col(order[0]).alias("ts"), F.col("_p").alias("p"))
    chunks = placed.groupBy(*keys, F.floor(F.col("_rn") / chunk_rows).alias("chunk")).agg(F.max("n_test").alias("n_test"), F.sort_array(F.collect_list(value)).alias("_r"))
    return chunks.select(
        *keys, "chunk", (F.col("chunk") * chunk_rows).alias("start"), "n_test", F.transform("_r", lambda r: r["ts"]).alias("oof_timestamps"),
        F.transform("_r", lambda r: r["p"]).alias("oof_predictions"))


def _lengths() -> tuple[Column, Column]:
    return F.coalesce(F.size("oof_predictions"), F.lit(0)), F.coalesce(F.size("oof_timestamps"), F.lit(0))


def flatten_oof(folds: DataFrame, signal_id: Column | str, symbol: Column | str, sha: Column | str) -> DataFrame:
    """Per-fold prediction and timestamp arrays to keyed rows.

    ``folds``: fold, train_end, test_start, test_end, oof_predictions, oof_timestamps; a fold may come in several chunks. Missing
    predictions are skipped, unequal array lengths fail the query, and so does a chunk that reaches past its fold's n_test.
    """
    col = lambda c: F.lit(c) if isinstance(c, str) else c
    n_preds, n_stamps = _lengths()
    uneven = n_preds != n_stamps
    if "chunk" in folds.columns:
        uneven = uneven | (F.col("start") + n_preds > F.col("n_test"))
    checked = F.when(uneven, F.raise_error("prediction and timestamp counts differ").cast("boolean")).otherwise(n_preds > 0)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    meta = F.to_json(F.named_struct(
        F.lit("fold"), F.col("fold"), F.lit("test_start"), iso("test_start"), F.lit("test_end"), iso("test_end"),
        F.lit("train_end"), iso("train_end"), F.lit("content_sha256"), col(sha),
        F.lit("source_run"), F.lit(BACKFILL_SOURCE),
    ))
    rows = folds.filter(checked).select(
        col(signal_id).alias("signal_id"), col(symbol).alias("symbol"), meta.alias("meta"),
        F.explode(F.arrays_zip(F.col("oof_timestamps").alias("ts"), F.col("oof_predictions").alias("value"))).alias("p"),
    )
    return rows.select("signal_id", "symbol", F.col("p.ts").alias("ts"), F.col("p.value").alias("value"),
                       F.col("p.value").alias("confidence"), "meta").filter(
        F.col("value").isNotNull() & ~F.isnan("value"))


def backfill_summary(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What a backfill would write per fold, with the fold's window where it is given; nothing is written (dry run).

    Chunks of a fold are added up. Their starts and lengths must chain without a gap to n_test, or the query fails.
    """
    n_preds, n_stamps = _lengths()
    missing = F.coalesce(F.size(F.filter("oof_predictions", lambda p: p.isNull() | F.isnan(p))), F.lit(0))
    window = [c for c in ("test_start", "test_end", "n_test") if c in folds.columns]
    sums = folds.groupBy(*keys, "fold").agg(
        *[F.max(c).alias(c) for c in window], F.sum(n_preds).alias("n_preds"), F.sum(n_stamps).alias("n_timestamps"), F.sum(missing).alias("n_nan_skipped"),
        F.sum(n_preds - missing).alias("n_to_upsert"), F.max("skipped_reason").alias("skipped_reason"), *(
            [F.sum("start").alias("_starts"), F.count(F.lit(1)).alias("_chunks"), F.max(n_preds).alias("_step")] if "chunk" in folds.columns else []))
    if "chunk" in folds.columns:
        chained = (F.col("n_preds") == F.col("n_test")) & (2 * F.col("_starts") == F.col("_step") * F.col("_chunks") * (F.col("_chunks") - 1))
        broken = F.raise_error(F.concat(F.lit("chunks of fold "), F.col("fold").cast("string"), F.lit(" do not add up"))).cast("bigint")
        sums = sums.withColumn("n_preds", F.when(chained, F.col("n_preds")).otherwise(broken)).drop("_starts", "_chunks", "_step")
    return sums


def backfill_totals(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Folds, rows to write and missing predictions of a whole backfill, from ``backfill_summary``."""
    return summary.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("skipped_reason").isNotNull()).alias("n_folds_skipped"),
        F.sum("n_to_upsert").alias("total_rows"), F.sum("n_nan_skipped").alias("total_skipped_nan"))


def latest_per_key(rows: DataFrame, order: Column, keys: Sequence[str] = SIGNAL_KEY) -> DataFrame:
    """Newest row per key (last write wins). Rows that tie in ``order`` are told apart by their values."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order.alias("_o"), F.xxhash64(*rest).alias("_h"))).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = SIGNAL_KEY, order: str | None = None) -> DataFrame:
    """Existing rows overwritten by incoming ones with the same key; of several incoming ones the last by ``order`` stays."""
    if order:
        incoming = latest_per_key(incoming, F.col(order), keys).drop(order)
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, F.col("_new"), keys).drop("_new")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is no such path; any other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def upsert(spark: SparkSession, incoming: DataFrame, path: str, period: str = "yyyy-MM", order: str | None = None) -> None:
    """Keyed overwrite of a Parquet table partitioned by (signal_id, period).

    Only the partitions present in ``incoming`` are read, merged and replaced; their list comes to the driver and prunes
    the read. The table is read with the declared types, so an id such as '007' stays a string. Columns or types
    that differ from the table's raise before anything is written. Of several incoming rows with one key the last by
    ``order`` stays. The merged rows are checkpointed first, because a job cannot overwrite the files it reads.
    """
    part = ["signal_id", "period"]
    new = incoming.withColumn("signal_id", F.col("signal_id").cast("string")).withColumn("period", F.date_format("ts", period))
    new = latest_per_key(new, F.col(order) if order else F.lit(1))
    if order:
        new = new.drop(order)
    table = _stored(spark, path)
    if table is not None:
        stored = {f.name: f.dataType for f in table.schema.fields if f.name not in part}
        given = {f.name: f.dataType for f in new.schema.fields if f.name not in part}
        if stored != given:
            raise ValueError(f"columns differ from the table's: {given} instead of {stored}")
        touched = [(r.signal_id, r.period) for r in new.select(*part).distinct().collect()]
        old = spark.read.schema(new.schema).parquet(path)
        periods = {}
        for signal, when in touched:
            periods.setdefault(when, []).append(signal)
        wanted = F.lit(False)
        for when, signals in periods.items():
            wanted = wanted | ((F.col("period") == when) & F.col("signal_id").isin(signals))
        merged = merge(old.filter(wanted).select(*new.columns), new, SIGNAL_KEY)
    else:
        merged = new
    merged = cut_lineage(merged.repartition(*part, F.to_date("ts")))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def predictions_with_labels(
    signals: DataFrame, store: DataFrame, label: str, version: int, interval: str
) -> DataFrame:
    """Realised labels beside predictions; the interval is part of the match, so a label stored at two
    intervals does not duplicate rows."""
    labels = store.filter(
        (F.col("feature_name") == label) & (F.col("version") == version) & (F.col("interval") == interval)
    ).select("symbol", "ts", F.col("value").alias("actual"))
    return signals.join(labels, ["symbol", "ts"]).select(
        "signal_id", "symbol", "ts", F.col("value").alias("predicted"), "actual"
    )


def definitions_with_models(definitions: DataFrame, models: DataFrame) -> DataFrame:
    named = models.select(*[F.col(c).alias("model_id" if c == "id" else f"model_{c}") for c in models.columns])
    return definitions.join(named, "model_id")


def signal_band(value: Column) -> Column:
    return F.when(value < 0.30, "risk-off").when(value > 0.70, "risk-on").when(value.isNotNull(), "neutral")


def profile(signals: DataFrame, keys: Sequence[str] = ("signal_id", "symbol")) -> DataFrame:
    return signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day")
    )


def recent_profile(signals: DataFrame, now: datetime | Column, days: int = 90, keys: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Distribution over the last ``days``; ``now`` is a literal or a column of ``signals``."""
    now = F.lit(now).cast("timestamp_ntz") if isinstance(now, datetime) else now
    return signals.filter(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count_if(F.col("value") < 0.30).alias("n_low"),
        F.count_if(F.col("value") > 0.70).alias("n_high"),
    )


def latest(signals: DataFrame, n: int, tiebreak: Sequence[str] = ("signal_id", "symbol")) -> DataFrame:
    return signals.orderBy(F.desc("ts"), *tiebreak).limit(n)
