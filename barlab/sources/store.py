"""Scans of the feature store, its registry and the bar table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlab.schema import FEATURE_REGISTRY, FEATURE_VALUES, MARKET_DATA

BUNDLE_HALO = timedelta(days=8)


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Parquet table of the store; ``kind`` is feature_values, market_data or feature_registry."""
    schema = {"feature_values": FEATURE_VALUES, "market_data": MARKET_DATA, "feature_registry": FEATURE_REGISTRY}
    return clean(spark.read.schema(schema[kind]).parquet(path))


def read_jdbc(
    spark: SparkSession, url: str, name: str, ts: str, lower: datetime, upper: datetime, partitions: int, **options: str
) -> DataFrame:
    """The same tables over JDBC, read in parallel slices of the timestamp column."""
    return clean(
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=ts, lowerBound=str(lower), upperBound=str(upper),
                 numPartitions=str(partitions), preferTimestampNTZ="true", **options)
        .load()
    )


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet laid out by (symbol, interval), so symbol and interval predicates prune folders."""
    df.repartition("symbol", "interval", F.to_date("ts" if "ts" in df.columns else "start_time")).write.mode(
        mode
    ).partitionBy("symbol", "interval").parquet(path)


def clean(df: DataFrame) -> DataFrame:
    """NaN means missing: Spark sorts it above every number, so it becomes null on the way in."""
    floats = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def _between(ts: str, start, end) -> Column:
    return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))


def list_input_features(registry: DataFrame, excluded: DataFrame | Iterable[str] = ()) -> DataFrame:
    """Registered features usable as inputs, minus exclusions and forward-looking labels."""
    usable = registry.filter(
        (F.col("status") == "registered")
        & (F.col("label_direction").isNull() | (F.col("label_direction") != "forward"))
    )
    if isinstance(excluded, DataFrame):
        usable = usable.join(excluded.select("feature_name").distinct(), "feature_name", "left_anti")
    elif excluded := list(excluded):
        usable = usable.filter(~F.col("feature_name").isin(excluded))
    return usable.orderBy("feature_name", "version")


def latest_versions(registry: DataFrame) -> DataFrame:
    """Of several registered versions of one feature only the highest is loaded."""
    names = [c for c in registry.columns if c not in ("feature_name", "version")]
    return registry.groupBy("feature_name").agg(
        F.max("version").alias("version"), *[F.max_by(c, "version").alias(c) for c in names]
    )


def read_feature(store: DataFrame, name: str, version: int, symbol: str, interval: str, start, end) -> DataFrame:
    return store.filter(
        (F.col("feature_name") == name) & (F.col("version") == version)
        & (F.col("symbol") == symbol) & (F.col("interval") == interval) & _between("ts", start, end)
    ).select("ts", "value")


def read_features(
    store: DataFrame, features: Mapping[str, int] | DataFrame, symbols: Sequence[str], interval: str, start, end
) -> DataFrame:
    """All per-bar features of some symbols in one scan; ``features`` maps name to version."""
    rows = store.filter(
        F.col("symbol").isin(list(symbols)) & (F.col("interval") == interval) & _between("ts", start, end)
    )
    if isinstance(features, DataFrame):
        return rows.join(features.select("feature_name", "version"), ["feature_name", "version"], "left_semi")
    pinned = F.create_map(*[F.lit(x) for kv in features.items() for x in kv])
    return rows.filter(
        F.col("feature_name").isin(list(features)) & (F.col("version") == F.element_at(pinned, F.col("feature_name")))
    )


def read_global_features(store: DataFrame, features: Mapping[str, int] | DataFrame, start, end, lookback: timedelta = timedelta()) -> DataFrame:
    """Features published once for all symbols; ``lookback`` also reads values before ``start``."""
    return read_features(store, features, [""], "", start - lookback, end)


def read_market_data(bars: DataFrame, symbol: str, interval: str, start, end) -> DataFrame:
    return bars.filter(
        (F.col("symbol") == symbol) & (F.col("interval") == interval) & _between("start_time", start, end)
    )


def market_bundle(
    bars: DataFrame, symbols: Sequence[str], interval: str, start, end, halo: timedelta = BUNDLE_HALO
) -> DataFrame:
    """Bars of all required symbols, widened by the halo on both sides; fails if a symbol has none."""
    found = bars.filter(
        F.col("symbol").isin(list(symbols)) & (F.col("interval") == interval)
        & _between("start_time", start - halo, end + halo)
    )
    present = {r.symbol for r in found.select("symbol").distinct().limit(len(set(symbols))).collect()}
    if missing := sorted(set(symbols) - present):
        raise ValueError(f"no {interval} bars for {', '.join(missing)} in [{start - halo}, {end + halo})")
    return found
