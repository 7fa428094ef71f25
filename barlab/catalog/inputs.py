"""Store-shaped inputs derived from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlab.schema import INTERVAL_SECONDS
from barlab.sources.bars import build_bars, tick_order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    """Bars per event type over event values; a tick counts as taker-side when its ``k`` is even."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return build_bars(
        e, interval, F.col("event_type"), F.col("ts"), F.col("value"),
        tick_order(F.col("ts"), F.col("event_id")), k % 2 == 0,
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per order priority over order totals, ordered by order key."""
    o = table(spark, sf_dir, "orders")
    return build_bars(
        o, "1d", F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey")
    )


def event_bars_cte(interval: str = "1h", name: str = "bars") -> str:
    us = INTERVAL_SECONDS[interval] * 1_000_000
    return f"""{name} AS (
      SELECT event_type AS symbol, make_timestamp(epoch_us(ts) // {us} * {us}) AS ts, '{interval}' AS interval,
             first(value ORDER BY ts, event_id) AS open_price, max(value) AS high_price,
             min(value) AS low_price, last(value ORDER BY ts, event_id) AS close_price,
             sum(value) AS volume,
             sum(CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 2 = 0 THEN value ELSE 0 END)
               AS taker_buy_base_volume,
             count(*) AS trade_count
      FROM events GROUP BY 1, 2)"""


def order_bars_cte(name: str = "bars") -> str:
    return f"""{name} AS (
      SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, '1d' AS interval,
             arg_min(o_totalprice, o_orderkey) AS open_price, max(o_totalprice) AS high_price,
             min(o_totalprice) AS low_price, arg_max(o_totalprice, o_orderkey) AS close_price,
             sum(o_totalprice) AS volume, count(*) AS trade_count
      FROM orders GROUP BY 1, 2)"""


def returns_cte(source: str = "bars", name: str = "rets") -> str:
    """One-bar log returns, null where a price is not positive."""
    return f"""{name} AS (
      SELECT *, CASE WHEN close_price > 0 AND lag(close_price) OVER w > 0
                     THEN ln(close_price / lag(close_price) OVER w) END AS r1
      FROM {source} WINDOW w AS (PARTITION BY symbol, interval ORDER BY ts))"""


def atr_cte(source: str = "bars", name: str = "atrs", n: int = 14) -> str:
    return f"""{name}_tr AS (
      SELECT *, greatest(high_price - low_price, abs(high_price - lag(close_price) OVER w),
                         abs(low_price - lag(close_price) OVER w)) AS tr
      FROM {source} WINDOW w AS (PARTITION BY symbol, interval ORDER BY ts)),
    {name} AS (
      SELECT *, CASE WHEN count(tr) OVER w = {n} THEN avg(tr) OVER w END AS atr
      FROM {name}_tr
      WINDOW w AS (PARTITION BY symbol, interval ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"""


def barrier_cte(
    source: str = "atrs", name: str = "lab", k_tp: float = 1.5, k_sl: float = 1.0, h: int = 24,
    side: str = "long", classes: str = "three",
) -> str:
    sign = 1 if side == "long" else -1
    good, bad, ge, le = ("hs", "ls", ">=", "<=") if side == "long" else ("ls", "hs", "<=", ">=")
    label = (
        "CASE WHEN tp < sl THEN 1.0 ELSE 0.0 END" if classes == "win"
        else f"CASE WHEN tp < sl THEN 1.0 WHEN sl <= {h} THEN -1.0 ELSE 0.0 END"
    )
    return f"""{name}_paths AS (
      SELECT *, list(high_price) OVER w AS hs, list(low_price) OVER w AS ls
      FROM {source}
      WINDOW w AS (PARTITION BY symbol, interval ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)),
    {name}_hits AS (
      SELECT *,
        coalesce(nullif(list_position(list_transform({good}, lambda x: x {ge} close_price + {sign * k_tp} * atr), true), 0), {h + 1}) AS tp,
        coalesce(nullif(list_position(list_transform({bad}, lambda x: x {le} close_price - {sign * k_sl} * atr), true), 0), {h + 1}) AS sl
      FROM {name}_paths),
    {name} AS (
      SELECT *, CASE WHEN len(hs) = {h} AND atr > 0 THEN {label} END AS label FROM {name}_hits)"""


def rounded(c: Column | str, n: int = 6) -> Column:
    """Round and drop negative zero, so both engines print one value."""
    return F.round(c, n) + F.lit(0.0)


# --- feature store -----------------------------------------------------------------------------

STORE_FEATURES = ("log_return_24", "volume_zscore_24", "atr_14")
GLOBAL_FEATURES = {"g_signup": "signup", "g_error": "error"}


def store_values(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Long feature store: hourly per-bar features, and event values as off-grid global features."""
    from barlab.operators.align import wide_to_long
    from barlab.operators.features import derive

    bars = event_bars(spark, sf_dir) if bars is None else bars
    wide = derive(bars, STORE_FEATURES).withColumn("ts", F.col("start_time"))
    local = wide_to_long(wide, STORE_FEATURES, ["symbol", "interval", "ts"]).filter(F.col("value").isNotNull())
    names = F.create_map(*[F.lit(x) for n, e in GLOBAL_FEATURES.items() for x in (e, n)])
    shared = table(spark, sf_dir, "events").select(
        F.lit("").alias("symbol"), F.lit("").alias("interval"), "ts",
        F.element_at(names, F.col("event_type")).alias("feature_name"), "value",
    ).filter(F.col("feature_name").isNotNull())
    return local.unionByName(shared).withColumn("version", F.lit(1)).withColumn(
        "value", F.round("value", 9)).select("feature_name", "version", "symbol", "interval", "ts", "value")


def store_cte(name: str = "store", interval: str = "1h") -> str:
    """Needs ``bars``; adds CTEs up to the long store."""
    key = "PARTITION BY symbol, interval ORDER BY ts"
    return f"""{atr_cte("bars", "sa")}, sf AS (
      SELECT symbol, interval, ts,
        CASE WHEN close_price > 0 AND lag(close_price, 24) OVER k > 0
             THEN ln(close_price / lag(close_price, 24) OVER k) END AS log_return_24,
        CASE WHEN count(volume) OVER w = 24 AND stddev_samp(volume) OVER w > 1e-12
             THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w END AS volume_zscore_24,
        atr AS atr_14
      FROM sa WINDOW k AS ({key}), w AS ({key} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    {name} AS (
      SELECT feature_name, 1 AS version, symbol, interval, ts, round(value, 9) AS value
      FROM (UNPIVOT sf ON log_return_24, volume_zscore_24, atr_14 INTO NAME feature_name VALUE value)
      UNION ALL
      SELECT CASE event_type WHEN 'signup' THEN 'g_signup' ELSE 'g_error' END, 1, '', '', ts, round(value, 9)
      FROM events WHERE event_type IN ('signup', 'error'))"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature registry with one entry per part: brand and name give the feature, the key its version."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("array<string>")
    scope = F.when(F.col("p_size") < 15, F.array().cast("array<string>")).when(F.col("p_size") < 25, none)
    return p.select(
        F.concat_ws(" ", "p_brand", "p_name").alias("feature_name"), F.col("p_partkey").cast("int").alias("version"),
        F.col("p_type").alias("family"),
        F.when(F.col("p_size") > 45, "draft").otherwise("registered").alias("status"),
        F.when(F.col("p_retailprice") >= 980, "forward").when(F.col("p_retailprice") >= 960, "backward")
        .alias("label_direction"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("max_ffill_age_hours"),
        F.when(F.col("p_retailprice") >= 930, "last_value").otherwise("exact").alias("ffill_policy"),
        scope.otherwise(F.when(F.col("p_retailprice") >= 950, F.array(F.lit("click"), F.lit("view")))
                        .otherwise(F.array(F.lit("view")))).alias("symbols"),
        scope.otherwise(F.array(F.lit("1h"), F.lit("4h"))).alias("intervals"),
    )


REGISTRY_CTE = """registry AS (
      SELECT p_brand || ' ' || p_name AS feature_name, CAST(p_partkey AS INTEGER) AS version, p_type AS family,
        CASE WHEN p_size > 45 THEN 'draft' ELSE 'registered' END AS status,
        CASE WHEN p_retailprice >= 980 THEN 'forward' WHEN p_retailprice >= 960 THEN 'backward' END AS label_direction,
        CASE WHEN p_size > 10 THEN p_size END AS max_ffill_age_hours,
        CASE WHEN p_retailprice >= 930 THEN 'last_value' ELSE 'exact' END AS ffill_policy,
        CASE WHEN p_size < 15 THEN CAST([] AS VARCHAR[]) WHEN p_size < 25 THEN NULL
             WHEN p_retailprice >= 950 THEN ['click', 'view'] ELSE ['view'] END AS symbols,
        CASE WHEN p_size < 15 THEN CAST([] AS VARCHAR[]) WHEN p_size < 25 THEN NULL ELSE ['1h', '4h'] END AS intervals
      FROM part)"""


# --- predictions -------------------------------------------------------------------------------

def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary predictions with labels, one per line item; symbol is the line status."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"),
        F.least(F.lit(1.0), F.round(F.col("l_quantity") * 0.018 + F.col("l_discount"), 6)).alias("predicted"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("actual"),
        "l_tax", "l_extendedprice", "l_quantity", "l_discount",
    )


SCORES_CTE = """scores AS (
      SELECT l_linestatus AS symbol, l_shipdate AS ts,
        least(1.0, round(l_quantity * 0.018 + l_discount, 6)) AS predicted,
        CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS actual,
        l_tax, l_extendedprice, l_quantity, l_discount
      FROM lineitem)"""


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select(
        "source", F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6).alias("predicted"),
        F.col("quality").cast("double").alias("actual"),
    )


DOCUMENT_SCORES_CTE = """dscores AS (
      SELECT source, round(n_chars / (n_chars + 2000.0), 6) AS predicted, CAST(quality AS DOUBLE) AS actual
      FROM labels JOIN documents USING (doc_id))"""


ROW_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _raw_models() -> dict[str, tuple[Column, Column, Column]]:
    q, d, t, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    return {
        "m1": (1.0 + q / 10.0, 2.0 + t * 10.0, 1.0 + p / 20000.0),
        "m2": (1.0 + d * 20.0, 1.0 + q / 25.0, 2.0 + t * 5.0),
        "m3": (2.0 + p / 50000.0, 1.0 + d * 30.0, 1.0 + q / 20.0),
    }


def probability_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with three models' class probabilities as arrays, true class and year."""
    li = table(spark, sf_dir, "lineitem")
    shares = {name: [r / (raw[0] + raw[1] + raw[2]) for r in raw] for name, raw in _raw_models().items()}
    arrays = [F.array(*p).alias(name) for name, p in shares.items()]
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.select(
        *ROW_ID, F.col("l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"),
        F.year("l_shipdate").alias("fold"), y.alias("y"), *arrays, "l_tax", "l_quantity",
    )


def mean_probabilities(rows: DataFrame) -> DataFrame:
    """Adds ``probs``, the mean over the three models."""
    at = lambda m, c: F.get(m, F.lit(c))
    return rows.withColumn("probs", F.array(*[(at("m1", c) + at("m2", c) + at("m3", c)) / 3.0 for c in range(3)]))


def probability_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, model, class, p, y)."""
    rows = probability_rows(spark, sf_dir)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("probs")) for m in ("m1", "m2", "m3")])
    return rows.select(*ROW_ID, "y", F.explode(models).alias("m")).select(
        *ROW_ID, "y", F.col("m.model").alias("model"), F.posexplode("m.probs").alias("class", "p"))


def _model_sql(raw: tuple[str, str, str]) -> str:
    total = " + ".join(f"({r})" for r in raw)
    return "[" + ", ".join(f"({r}) / ({total})" for r in raw) + "]"


PROBABILITY_CTE = f"""proba AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus AS symbol, l_shipdate AS ts,
        CAST(year(l_shipdate) AS INTEGER) AS fold, l_tax, l_quantity,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
        {_model_sql(("1.0::DOUBLE + l_quantity / 10.0", "2.0::DOUBLE + l_tax * 10.0", "1.0::DOUBLE + l_extendedprice / 20000.0"))} AS m1,
        {_model_sql(("1.0::DOUBLE + l_discount * 20.0", "1.0::DOUBLE + l_quantity / 25.0", "2.0::DOUBLE + l_tax * 5.0"))} AS m2,
        {_model_sql(("2.0::DOUBLE + l_extendedprice / 50000.0", "1.0::DOUBLE + l_discount * 30.0", "1.0::DOUBLE + l_quantity / 20.0"))} AS m3
      FROM lineitem),
    meanp AS (
      SELECT *, (m1[1] + m2[1] + m3[1]) / 3.0 AS p0, (m1[2] + m2[2] + m3[2]) / 3.0 AS p1,
             (m1[3] + m2[3] + m3[3]) / 3.0 AS p2 FROM proba),
    pred AS (
      SELECT *, greatest(p0, p1, p2) AS conf,
        CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM meanp)"""

MODEL_LONG_CTE = """mlong AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, y, model, unnest([0, 1, 2]) AS class, unnest(ps) AS p
      FROM (SELECT *, 'm1' AS model, m1 AS ps FROM proba UNION ALL SELECT *, 'm2', m2 FROM proba
            UNION ALL SELECT *, 'm3', m3 FROM proba))"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-probability class per line item, taken above 0.4 confidence; interval by line status."""
    from barlab.operators.metrics import argmax
    from barlab.operators.pnl import trade_pnl

    rows = mean_probabilities(probability_rows(spark, sf_dir))
    rows = rows.withColumn("pred", argmax(F.col("probs"))).withColumn("take", F.array_max("probs") > 0.4)
    return trade_pnl(rows, F.when(F.col("symbol") == "F", "1h").otherwise("15m"))


TRADES_CTE = f"""{PROBABILITY_CTE}, trades AS (
      SELECT *, conf > 0.4 AND pred <> 1 AS traded,
        CASE WHEN NOT (conf > 0.4 AND pred <> 1) THEN 0.0
             WHEN pred = 2 AND y = 2 THEN 1.5 WHEN pred = 2 AND y = 0 THEN -1.0
             WHEN pred = 0 AND y = 0 THEN 1.0 WHEN pred = 0 AND y = 2 THEN -1.0 ELSE 0.0 END::DOUBLE
          * CASE WHEN symbol = 'F' THEN 60.0 ELSE 30.0 END::DOUBLE AS gross_bps
      FROM pred)"""


# --- folds -------------------------------------------------------------------------------------

FOLD_PARAMS = dict(train_days=365, test_days=120, embargo_days=7, n_folds=12)


def score_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward folds per line status over the shipped dates."""
    from barlab.operators.folds import generate_folds

    spans = scores(spark, sf_dir).groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return generate_folds(spans, **FOLD_PARAMS)


FOLDS_CTE = """folds AS (
      SELECT symbol, fold, test_start - INTERVAL 372 DAY AS train_start, test_start - INTERVAL 7 DAY AS train_end,
             test_start, test_start + INTERVAL 120 DAY AS test_end
      FROM (SELECT symbol, CAST(k AS INTEGER) AS fold, s + INTERVAL 372 DAY + INTERVAL (k * 120) DAY AS test_start, e
            FROM (SELECT symbol, min(ts) AS s, max(ts) AS e FROM scores GROUP BY 1), range(12) r(k))
      WHERE test_start + INTERVAL 120 DAY <= e)"""


# --- wide matrices -----------------------------------------------------------------------------

EMBED_DIMS = 64
EMBED_FEATURES = tuple(f"f{i}" for i in range(EMBED_DIMS))


def embedding_matrix(spark: SparkSession, sf_dir: str, dims: int = EMBED_DIMS) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("y"),
                    *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(dims)])


def embedding_cte(dims: int = EMBED_DIMS) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(dims))
    return f"emb AS (SELECT vec_id, label AS y, {cols} FROM embeddings)"


CHECK_FEATURES = ("log_return_24", "volume_zscore_24", "atr_14", "y_copy", "flat", "stops_early")


def check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with features, a binary and a three-class label, a copy of the label, a constant
    and a column that ends early."""
    from barlab.operators.features import derive

    wide = derive(event_bars(spark, sf_dir), [*STORE_FEATURES, "long_win_tb", "triple_barrier", "forward_return_24"])
    return wide.select(
        "symbol", F.col("start_time").alias("ts"), *STORE_FEATURES, F.col("long_win_tb").alias("y"),
        F.col("triple_barrier").alias("y3"), F.col("forward_return_24").alias("yr"),
        F.col("long_win_tb").alias("y_copy"), F.lit(1.5).alias("flat"),
        F.when(F.col("start_time") < F.lit("2024-01-15").cast("timestamp_ntz"), F.col("atr_14")).alias("stops_early"),
    ).filter(F.col("y").isNotNull() & F.col("log_return_24").isNotNull() & F.col("volume_zscore_24").isNotNull())


def check_cte() -> str:
    """CTEs up to ``chk``."""
    key = "PARTITION BY symbol, interval ORDER BY ts"
    return f"""{event_bars_cte()}, {atr_cte()}, {barrier_cte()}, chk0 AS (
      SELECT symbol, ts, label AS y3, CASE WHEN label IS NOT NULL THEN CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS y,
        CASE WHEN close_price > 0 AND lag(close_price, 24) OVER k > 0
             THEN ln(close_price / lag(close_price, 24) OVER k) END AS log_return_24,
        CASE WHEN count(volume) OVER w = 24 AND stddev_samp(volume) OVER w > 1e-12
             THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w END AS volume_zscore_24,
        CASE WHEN close_price <> 0 THEN (lead(close_price, 24) OVER k - close_price) / close_price END AS yr,
        atr AS atr_14, 1.5::DOUBLE AS flat,
        CASE WHEN ts < TIMESTAMP '2024-01-15' THEN atr END AS stops_early
      FROM lab WINDOW k AS ({key}), w AS ({key} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    chk AS (SELECT *, y AS y_copy FROM chk0
            WHERE y IS NOT NULL AND log_return_24 IS NOT NULL AND volume_zscore_24 IS NOT NULL)"""
