"""Bars, grids, rolling features and forward labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.inputs import (
    atr_cte, barrier_cte, event_bars, event_bars_cte, order_bars, order_bars_cte, returns_cte, rounded,
)
from barlab.catalog.registry import query
from barlab.operators.features import BarColumn, derive, forward_pctrank, forward_return, rolling_corr

W_KEY = "PARTITION BY symbol, interval ORDER BY ts"


def _bars_sql(interval: str) -> str:
    return f"""WITH {event_bars_cte(interval)}
    SELECT symbol, interval, ts, open_price, high_price, low_price, close_price, round(volume, 4) AS volume,
           round(taker_buy_base_volume, 4) AS taker_buy_base_volume, trade_count FROM bars"""


def _bars_out(bars):
    return bars.select(
        "symbol", "interval", F.col("start_time").alias("ts"), "open_price", "high_price", "low_price",
        "close_price", rounded("volume", 4).alias("volume"),
        rounded("taker_buy_base_volume", 4).alias("taker_buy_base_volume"), "trade_count",
    )


@query("bars_1h", _bars_sql("1h"))
def bars_1h(spark, d):
    return _bars_out(event_bars(spark, d, "1h"))


@query("bars_15m", _bars_sql("15m"))
def bars_15m(spark, d):
    return _bars_out(event_bars(spark, d, "15m"))


@query("bars_4h", _bars_sql("4h"))
def bars_4h(spark, d):
    return _bars_out(event_bars(spark, d, "4h"))


@query("bars_1d_orders", f"""WITH {order_bars_cte()}
    SELECT symbol, interval, ts, open_price, high_price, low_price, close_price, round(volume, 2) AS volume,
           trade_count FROM bars""")
def bars_1d(spark, d):
    return order_bars(spark, d).select(
        "symbol", "interval", F.col("start_time").alias("ts"), "open_price", "high_price", "low_price",
        "close_price", rounded("volume", 2).alias("volume"), "trade_count",
    )


def _derived(bars, name, n=6):
    return derive(bars, [name]).select("symbol", F.col("start_time").alias("ts"), rounded(name, n).alias("value"))


@query("w01_log_return", f"""WITH {event_bars_cte()}
    SELECT symbol, ts, round(CASE WHEN close_price > 0 AND lag(close_price, 24) OVER w > 0
             THEN ln(close_price / lag(close_price, 24) OVER w) END, 6) AS value
    FROM bars WINDOW w AS ({W_KEY})""")
def w01(spark, d):
    return _derived(event_bars(spark, d), "log_return_24")


@query("w02_realized_vol", f"""WITH {event_bars_cte()}, {returns_cte()}
    SELECT symbol, ts, round(CASE WHEN count(r1) OVER w = 168 THEN stddev_samp(r1) OVER w END, 6) AS value
    FROM rets WINDOW w AS ({W_KEY} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""")
def w02(spark, d):
    return _derived(event_bars(spark, d), "realized_vol_168")


@query("w03_volume_zscore", f"""WITH {event_bars_cte()}, s AS (
      SELECT symbol, ts, volume, avg(volume) OVER w AS m,
             CASE WHEN count(volume) OVER w = 24 THEN stddev_samp(volume) OVER w END AS sd
      FROM bars WINDOW w AS ({W_KEY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, round(CASE WHEN sd > 1e-12 THEN (volume - m) / sd END, 6) AS value FROM s""")
def w03(spark, d):
    return _derived(event_bars(spark, d), "volume_zscore_24")


PAIR_SQL = f"""WITH {event_bars_cte()}, {returns_cte()}, p AS (
      SELECT ts, max(CASE WHEN symbol = 'click' THEN r1 END) AS a, max(CASE WHEN symbol = 'purchase' THEN r1 END) AS b
      FROM rets WHERE symbol IN ('click', 'purchase') GROUP BY ts
      HAVING max(CASE WHEN symbol = 'click' THEN r1 END) IS NOT NULL
         AND max(CASE WHEN symbol = 'purchase' THEN r1 END) IS NOT NULL),
    c AS (SELECT ts, CASE WHEN count(*) OVER w = 24 THEN corr(a, b) OVER w END AS v
          FROM p WINDOW w AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT bars.symbol, bars.ts, round(c.v, 6) AS value
    FROM bars LEFT JOIN c ON bars.ts = c.ts WHERE bars.symbol = 'click'"""


@query("w04_rolling_corr", PAIR_SQL)
def w04(spark, d):
    rho = rolling_corr(event_bars(spark, d), "click", "purchase", 24)
    return rho.select("symbol", F.col("start_time").alias("ts"), rounded("corr").alias("value"))


@query("w05_forward_return", f"""WITH {event_bars_cte()}
    SELECT symbol, ts, round(CASE WHEN close_price <> 0
             THEN (lead(close_price, 24) OVER w - close_price) / close_price END, 6) AS value
    FROM bars WINDOW w AS ({W_KEY})""")
def w05(spark, d):
    return _derived(event_bars(spark, d), "forward_return_24")


@query("w06_forward_sharpe_sign", f"""WITH {event_bars_cte()}, {returns_cte()}, f AS (
      SELECT symbol, ts,
             CASE WHEN close_price <> 0 THEN (lead(close_price, 24) OVER a - close_price) / close_price END AS fwd,
             CASE WHEN count(r1) OVER w = 24 THEN stddev_samp(r1) OVER w END * sqrt(24.0) AS sd
      FROM rets WINDOW a AS ({W_KEY}), w AS ({W_KEY} ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING))
    SELECT symbol, ts, CASE WHEN sd > 0 AND fwd IS NOT NULL
                            THEN CASE WHEN fwd / sd > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS value FROM f""")
def w06(spark, d):
    return _derived(event_bars(spark, d), "forward_sharpe_sign_24")


def pctrank_sql(source_cte: str, window: int, least: int) -> str:
    return f"""WITH {source_cte}, f AS (
      SELECT symbol, interval, ts, CASE WHEN close_price > 0 AND lead(close_price, 24) OVER w > 0
               THEN ln(lead(close_price, 24) OVER w / close_price) END AS x
      FROM bars WINDOW w AS ({W_KEY})),
    l AS (SELECT symbol, ts, x, list(x) OVER w AS xs, count(x) OVER w AS n
          FROM f WINDOW w AS ({W_KEY} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)),
    r AS (SELECT symbol, ts, CASE WHEN x IS NOT NULL AND n >= {least}
            THEN (len(list_filter(xs, lambda v: v < x)) + (len(list_filter(xs, lambda v: v = x)) + 1) / 2.0) / n END AS p FROM l)
    SELECT symbol, ts, CASE WHEN p > 0.5 THEN 1.0 WHEN p IS NOT NULL THEN 0.0 END::DOUBLE AS value FROM r"""


@query("w07_forward_pctrank", pctrank_sql(order_bars_cte(), 2160, 720))
def w07(spark, d):
    ranked = forward_pctrank(order_bars(spark, d), 24, 2160, 720, "value")
    return ranked.select("symbol", F.col("start_time").alias("ts"), "value")


@query("w07_forward_pctrank_hourly", pctrank_sql(event_bars_cte(), 168, 48))
def w07_hourly(spark, d):
    ranked = forward_pctrank(event_bars(spark, d), 24, 168, 48, "value")
    return ranked.select("symbol", F.col("start_time").alias("ts"), "value")


@query("w08_atr", f"""WITH {event_bars_cte()}, {atr_cte()}
    SELECT symbol, ts, round(atr, 6) AS value FROM atrs""")
def w08(spark, d):
    return _derived(event_bars(spark, d), "atr_14")


def _barrier_sql(where: str = "", bars: str | None = None, **kw) -> str:
    return f"""WITH {bars or event_bars_cte()}, {atr_cte()}, {barrier_cte(**kw)}
    SELECT symbol, ts, label::DOUBLE AS value FROM lab {where}"""


@query("w09_triple_barrier", _barrier_sql())
def w09(spark, d):
    return _derived(event_bars(spark, d), "triple_barrier")


@query("w10_long_win_tb", _barrier_sql(classes="win"))
def w10(spark, d):
    return _derived(event_bars(spark, d), "long_win_tb")


@query("w11_long_win_tb_short", _barrier_sql(k_tp=2.0, k_sl=0.75, h=6, classes="win"))
def w11(spark, d):
    return _derived(event_bars(spark, d), "long_win_tb_short")


@query("w12_long_win_tb_loose", _barrier_sql(k_tp=1.0, k_sl=0.5, h=6, classes="win"))
def w12(spark, d):
    return _derived(event_bars(spark, d), "long_win_tb_loose")


@query("w13_short_win_tb", _barrier_sql(side="short", classes="win"))
def w13(spark, d):
    return _derived(event_bars(spark, d), "short_win_tb")


@query("w14_long_win_tb_second_symbol", _barrier_sql("WHERE symbol = 'view'", classes="win"))
def w14(spark, d):
    return _derived(event_bars(spark, d).filter(F.col("symbol") == "view"), "long_win_tb")


@query("w15_long_win_tb_4h", _barrier_sql("WHERE symbol = 'view'", event_bars_cte("4h"), classes="win"))
def w15(spark, d):
    return _derived(event_bars(spark, d, "4h").filter(F.col("symbol") == "view"), "long_win_tb")


@query("flagship_label_mix", f"""WITH {event_bars_cte()}, {returns_cte()}, {atr_cte("rets")}, {barrier_cte()}, m AS (
      SELECT symbol, label, CASE WHEN close_price > 0 AND lag(close_price, 24) OVER k > 0
               THEN ln(close_price / lag(close_price, 24) OVER k) END AS ret,
             CASE WHEN count(r1) OVER v = 168 THEN stddev_samp(r1) OVER v END AS vol, atr
      FROM lab WINDOW k AS ({W_KEY}), v AS ({W_KEY} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
    SELECT symbol, CAST(label AS INTEGER) AS label, count(*) AS n, round(avg(ret), 6) AS mean_return,
           round(avg(vol), 6) AS mean_vol, round(avg(atr), 6) AS mean_atr
    FROM m GROUP BY 1, 2""")
def flagship(spark, d):
    wide = derive(
        event_bars(spark, d), ["log_return_24", "realized_vol_168", "volume_zscore_24", "atr_14", "triple_barrier"]
    )
    return wide.groupBy("symbol", F.col("triple_barrier").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg("log_return_24")).alias("mean_return"),
        rounded(F.avg("realized_vol_168")).alias("mean_vol"),
        rounded(F.avg("atr_14")).alias("mean_atr"),
    )
