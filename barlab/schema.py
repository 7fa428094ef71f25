"""Column layouts of the store tables."""

from __future__ import annotations

from pyspark.sql import types as T

NTZ = T.TimestampNTZType()

MARKET_DATA = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("interval", T.StringType(), False),
    T.StructField("start_time", NTZ, False),
    T.StructField("open_price", T.DoubleType()),
    T.StructField("high_price", T.DoubleType()),
    T.StructField("low_price", T.DoubleType()),
    T.StructField("close_price", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("quote_asset_volume", T.DoubleType()),
    T.StructField("taker_buy_base_volume", T.DoubleType()),
    T.StructField("taker_buy_quote_volume", T.DoubleType()),
    T.StructField("trade_count", T.LongType()),
])

FEATURE_VALUES = T.StructType([
    T.StructField("feature_name", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("interval", T.StringType(), False),
    T.StructField("ts", NTZ, False),
    T.StructField("value", T.DoubleType()),
])

FEATURE_REGISTRY = T.StructType([
    T.StructField("feature_name", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("family", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("label_direction", T.StringType()),
    T.StructField("max_ffill_age_hours", T.IntegerType()),
    T.StructField("ffill_policy", T.StringType()),
    T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("intervals", T.ArrayType(T.StringType())),
])

SIGNAL_HISTORY = T.StructType([
    T.StructField("signal_id", T.StringType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", NTZ, False),
    T.StructField("value", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("produced_at", NTZ),
    T.StructField("source", T.StringType()),
    T.StructField("meta", T.StringType()),
])

FOLDS = T.StructType([
    T.StructField("fold", T.IntegerType(), False),
    T.StructField("train_start", NTZ, False),
    T.StructField("train_end", NTZ, False),
    T.StructField("test_start", NTZ, False),
    T.StructField("test_end", NTZ, False),
])

# Bar widths in seconds, and the ordinal code of each stackable interval.
INTERVAL_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
INTERVAL_CODES = {"5m": 0, "15m": 1, "1h": 2, "4h": 3}
GRID_INTERVALS = ("1m", "5m", "15m", "1h", "4h")
