"""Trade PnL, regimes, Sharpe, invariance, bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barlab.catalog.inputs import (
    EMBED_FEATURES, ROW_ID, TRADES_CTE, embedding_cte, embedding_matrix, mean_probabilities, order_bars,
    order_bars_cte, probability_rows, rounded, table, trades,
)
from barlab.catalog.registry import query
from barlab.functions.stats import normal_ppf
from barlab.operators.attach import attach
from barlab.operators import pnl
from barlab.operators import sharpe as sh
from barlab.operators.bootstrap import bootstrap_macro_auc
from barlab.operators.features import BarColumn, derive, log_return, realized_vol
from barlab.operators.invariance import bin_shifts, conditional_invariance, per_feature_max
from barlab.operators.ranks import quantiles


@query("g12_trade_pnl", f"""WITH {TRADES_CTE}
    SELECT symbol, y, CAST(pred AS INTEGER) AS pred, traded, gross_bps, count(*) AS n FROM trades GROUP BY 1, 2, 3, 4, 5""")
def g12(spark, d):
    return trades(spark, d).groupBy("symbol", "y", "pred", "traded", "gross_bps").agg(F.count(F.lit(1)).alias("n"))


COST_SQL = """SELECT fold, regime, n_trades, round(gross_mean, 6) AS gross_mean, round(hit_rate, 6) AS hit_rate, cost AS cost_bps,
      round(gross_mean - cost, 6) AS net_mean, round(gross_sum - n_trades * cost, 4) AS net_total,
      CASE WHEN gross_mean - cost > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS profitable
    FROM (SELECT fold, count(*) FILTER (traded) AS n_trades, avg(gross_bps) FILTER (traded) AS gross_mean,
                 coalesce(sum(gross_bps) FILTER (traded), 0) AS gross_sum,
                 avg(CASE WHEN gross_bps > 0 THEN 1.0 ELSE 0.0 END) FILTER (traded) AS hit_rate FROM trades GROUP BY 1),
         (VALUES ('realistic', 20.0::DOUBLE), ('conservative', 45.0::DOUBLE), ('adversarial', 70.0::DOUBLE)) r(regime, cost)"""


@query("g13_cost_regime_metrics", f"WITH {TRADES_CTE} {COST_SQL}")
def g13(spark, d):
    out = pnl.cost_regime_metrics(trades(spark, d), ["fold"])
    return out.select("fold", "regime", "n_trades", rounded("gross_mean").alias("gross_mean"), rounded("hit_rate").alias("hit_rate"),
                      "cost_bps", rounded("net_mean").alias("net_mean"), rounded("net_total", 4).alias("net_total"), "profitable")


def regime_trades(spark, d):
    """Trades of each symbol with regimes of its tax (vol) and quantity (trend) columns; the first four
    years are train."""
    rows = trades(spark, d).withColumn("role", F.when(F.col("fold") < 1999, "train").otherwise("test"))
    return pnl.add_regimes(rows, ["symbol"], "l_tax", "l_quantity")


REGIME_CTE = f"""{TRADES_CTE}, cuts AS (
      SELECT symbol, quantile_cont(l_tax, 0.25) AS v0, quantile_cont(l_tax, 0.75) AS v1,
             quantile_cont(l_quantity, 1.0::DOUBLE / 3) AS t0, quantile_cont(l_quantity, 2.0::DOUBLE / 3) AS t1
      FROM trades WHERE fold < 1999 GROUP BY 1),
    rt AS (SELECT t.*, l_tax < v0 AS low_vol, l_tax > v1 AS high_vol, l_quantity < t0 AS bear,
             l_quantity >= t0 AND l_quantity < t1 AS chop, l_quantity >= t1 AS bull
           FROM trades t JOIN cuts USING (symbol) WHERE fold >= 1999),
    rx AS (SELECT symbol, regime, gross_bps - 20.0 AS net FROM rt, (VALUES ('low_vol'), ('high_vol'), ('bear'), ('chop'), ('bull')) r(regime)
           WHERE traded AND CASE regime WHEN 'low_vol' THEN low_vol WHEN 'high_vol' THEN high_vol WHEN 'bear' THEN bear WHEN 'chop' THEN chop ELSE bull END),
    rs AS (SELECT symbol, regime, count(*) AS n, avg(net) AS mean_net, coalesce(stddev_samp(net), 0) AS std_net FROM rx GROUP BY 1, 2),
    rz AS (SELECT s.symbol, r.regime, coalesce(n, 0) AS n, mean_net, std_net,
             CASE WHEN std_net > 0 THEN mean_net / (std_net / sqrt(n)) END AS t_stat
           FROM (SELECT DISTINCT symbol FROM rt) s CROSS JOIN (VALUES ('low_vol'), ('high_vol'), ('bear'), ('chop'), ('bull')) r(regime)
           LEFT JOIN rs ON rs.symbol = s.symbol AND rs.regime = r.regime)"""

# Student t lower tail by Simpson's rule on [0, |t|].
T_CDF_SQL = """0.5 + sign(t_stat) * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt(pi() * (n - 1)) * (least(abs(t_stat), 60.0) / 4000) / 3
      * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
          * pow(1 + pow(least(abs(t_stat), 60.0) * i / 4000, 2) / (n - 1), -(n / 2.0))))"""


@query("g14_regime_subcuts", f"""WITH {REGIME_CTE}, p AS (
      SELECT *, CASE WHEN n < 10 THEN NULL WHEN std_net = 0 THEN CASE WHEN mean_net < 0 THEN 0.0 ELSE 1.0 END ELSE {T_CDF_SQL} END AS p FROM rz)
    SELECT symbol, regime, n, round(mean_net, 6) AS mean_net, round(t_stat, 6) AS t_stat, round(p, 5) AS p_value,
      CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS failing, CASE WHEN n < 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS caveat FROM p""")
def g14(spark, d):
    out = pnl.regime_subcuts(regime_trades(spark, d), ["symbol"])
    return out.select("symbol", "regime", "n", rounded("mean_net").alias("mean_net"), rounded("t_stat").alias("t_stat"),
                      rounded("p_value", 5).alias("p_value"), "failing", "caveat")


@query("g14_regime_gate", f"""WITH {REGIME_CTE}, p AS (
      SELECT *, CASE WHEN n < 10 THEN NULL WHEN std_net = 0 THEN CASE WHEN mean_net < 0 THEN 0.0 ELSE 1.0 END ELSE {T_CDF_SQL} END AS p FROM rz)
    SELECT symbol, count(*) FILTER (n >= 10) AS n_checked, sum(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END)::DOUBLE AS n_failing,
      CASE WHEN sum(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS gate_pass,
      max(CASE WHEN n < 10 THEN 1.0 ELSE 0.0 END)::DOUBLE AS gate_caveat FROM p GROUP BY 1""")
def g14_gate(spark, d):
    return pnl.regime_gate(pnl.regime_subcuts(regime_trades(spark, d), ["symbol"]), ["symbol"])


def _daily_regimes(spark, d):
    """Daily bars with 20-bar volatility and 24-bar return; bars before 1999 are train."""
    cols = [BarColumn("vol", "technical", 21, 0, realized_vol(20)), BarColumn("trend", "technical", 24, 0, log_return(24))]
    wide = derive(order_bars(spark, d), cols)
    return wide.select("symbol", F.col("start_time").alias("ts"), "vol", "trend",
                       F.when(F.year("start_time") < 1999, "train").otherwise("test").alias("role"))


DAILY_CTE = f"""{order_bars_cte()}, r AS (
      SELECT *, ln(close_price / lag(close_price) OVER w) AS r1, ln(close_price / lag(close_price, 24) OVER w) AS trend
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    dr AS (SELECT symbol, ts, trend, CASE WHEN count(r1) OVER w = 20 THEN stddev_samp(r1) OVER w END AS vol, year(ts) < 1999 AS tr
           FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    dq AS (SELECT symbol, quantile_cont(vol, 0.25) AS v0, quantile_cont(vol, 0.75) AS v1, quantile_cont(trend, 1.0::DOUBLE / 3) AS t0,
             quantile_cont(trend, 2.0::DOUBLE / 3) AS t1 FROM dr WHERE tr GROUP BY 1)"""


@query("g15_vol_regimes", f"""WITH {DAILY_CTE}
    SELECT symbol, ts, vol < v0 AS low_vol, vol > v1 AS high_vol FROM dr JOIN dq USING (symbol) WHERE NOT tr""")
def g15(spark, d):
    return pnl.add_regimes(_daily_regimes(spark, d), ["symbol"], "vol", "trend").select("symbol", "ts", "low_vol", "high_vol")


@query("g16_trend_regimes", f"""WITH {DAILY_CTE}
    SELECT symbol, ts, trend < t0 AS bear, trend >= t0 AND trend < t1 AS chop, trend >= t1 AS bull FROM dr JOIN dq USING (symbol) WHERE NOT tr""")
def g16(spark, d):
    return pnl.add_regimes(_daily_regimes(spark, d), ["symbol"], "vol", "trend").select("symbol", "ts", "bear", "chop", "bull")


@query("c10_threshold_join", f"""WITH {DAILY_CTE}
    SELECT symbol, round(v0, 6) AS low_cut, round(v1, 6) AS high_cut, count(*) FILTER (vol < v0) AS n_low, count(*) FILTER (vol > v1) AS n_high
    FROM dr JOIN dq USING (symbol) WHERE NOT tr GROUP BY 1, 2, 3""")
def c10(spark, d):
    rows = _daily_regimes(spark, d)
    cuts = quantiles(rows.filter("role = 'train'"), ["symbol"], "vol", [0.25, 0.75], "q")
    joined = attach(rows.filter("role = 'test'"), cuts, ["symbol"], F.col("vol")).select("symbol", "vol", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return joined.groupBy("symbol", rounded("lo").alias("low_cut"), rounded("hi").alias("high_cut")).agg(
        F.count_if(F.col("vol") < F.col("lo")).alias("n_low"), F.count_if(F.col("vol") > F.col("hi")).alias("n_high"))


def net_returns(spark, d):
    return trades(spark, d).filter("traded").select("fold", "symbol", (F.col("gross_bps") - pnl.round_trip_cost() + F.col("l_quantity")).alias("net"))


# g1/g2 population moments and their bias corrections.
MOMENTS_CTE = f"""{TRADES_CTE}, net AS (SELECT fold, symbol, gross_bps - 20.0 + l_quantity AS x FROM trades WHERE traded),
    mm AS (SELECT fold, symbol, count(*)::DOUBLE AS n, avg(x) AS mean, stddev_samp(x) AS std, stddev_pop(x) AS sp FROM net GROUP BY 1, 2),
    gg AS (SELECT net.fold, net.symbol, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std,
             avg(pow((x - mean) / sp, 3)) AS g1, avg(pow((x - mean) / sp, 4)) - 3 AS g2
           FROM net JOIN mm ON net.fold = mm.fold AND net.symbol = mm.symbol GROUP BY 1, 2),
    mo AS (SELECT fold, symbol, CAST(n AS BIGINT) AS n, mean, std, g1 * sqrt(n * (n - 1)) / (n - 2) AS skew,
             ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)) AS excess_kurtosis FROM gg)"""


@query("g17_sharpe_moments", f"""WITH {MOMENTS_CTE}
    SELECT fold, symbol, n, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 6) AS skew, round(excess_kurtosis, 6) AS excess_kurtosis FROM mo""")
def g17(spark, d):
    out = sh.sharpe_moments(net_returns(spark, d), ["fold", "symbol"], "net")
    return out.select("fold", "symbol", "n", *[rounded(c).alias(c) for c in ("mean", "std", "skew", "excess_kurtosis")])


_UNIT_10 = (1 - sh.EULER_GAMMA) * normal_ppf(1 - 1 / 10) + sh.EULER_GAMMA * normal_ppf(1 - 1 / (10 * math.e))


@query("g18_expected_max_sharpe", f"""WITH {MOMENTS_CTE}
    SELECT symbol, round(sqrt(var_samp(mean / std)) * {_UNIT_10!r}, 6) AS sharpe_star FROM mo GROUP BY 1""")
def g18(spark, d):
    m = sh.sharpe_moments(net_returns(spark, d), ["fold", "symbol"], "net")
    v = m.groupBy("symbol").agg(F.var_samp(F.col("mean") / F.col("std")).alias("v"))
    return v.select("symbol", rounded(sh.expected_max_sharpe(10, F.col("v"))).alias("sharpe_star"))


# Normal CDF by Simpson's rule on [0, |z|], |z| capped at 12.
PHI_SQL = """0.5 + sign(z) * (least(abs(z), 12.0) / 2000) / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001),
      lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(least(abs(z), 12.0) * i / 2000, 2) / 2)))"""


def _psr_sql(star: str) -> str:
    sr = "(mean / std)"
    return f"({sr} - ({star})) * sqrt(n - 1) / sqrt(greatest(1 - skew * {sr} + (excess_kurtosis + 2) / 4 * {sr} * {sr}, 1e-6))"


@query("g19_probabilistic_sharpe", f"""WITH {MOMENTS_CTE}, z AS (SELECT fold, symbol, {_psr_sql("0")} AS z FROM mo)
    SELECT fold, symbol, round(z, 6) AS z, round({PHI_SQL}, 6) AS psr FROM z""")
def g19(spark, d):
    m = sh.sharpe_moments(net_returns(spark, d), ["fold", "symbol"], "net")
    args = (F.col("mean") / F.col("std"), F.lit(0.0), F.col("n").cast("double"), F.col("skew"), F.col("excess_kurtosis"))
    return m.select("fold", "symbol", rounded(sh.probabilistic_sharpe_z(*args)).alias("z"), rounded(sh.probabilistic_sharpe(*args)).alias("psr"))


_STAR = math.sqrt(0.002) * _UNIT_10


@query("g20_deflated_sharpe", f"""WITH {MOMENTS_CTE}, z AS (SELECT *, {_psr_sql(repr(_STAR))} AS z FROM mo), v AS (SELECT *, {PHI_SQL} AS dsr FROM z)
    SELECT fold, symbol, n, round(mean / std, 6) AS sharpe, round({_STAR!r}::DOUBLE, 6) AS sharpe_star, round(skew, 6) AS skew,
      round(excess_kurtosis, 6) AS excess_kurtosis, round(dsr, 6) AS dsr, 1.0::DOUBLE AS discount_active,
      CASE WHEN dsr > 0.95 THEN 1.0 ELSE 0.0 END::DOUBLE AS gate_pass FROM v""")
def g20(spark, d):
    out = sh.deflated_sharpe(net_returns(spark, d), ["fold", "symbol"], "net", n_trials=10, variance=0.002)
    return out.select("fold", "symbol", "n", *[rounded(c).alias(c) for c in ("sharpe", "sharpe_star", "skew", "excess_kurtosis", "dsr")],
                      "discount_active", "gate_pass")


def embedding_sides(spark, d, dims=64):
    """Embedding matrix: binary label, first half of the ids is train."""
    e = embedding_matrix(spark, d, dims)
    half = e.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    return e.join(F.broadcast(half)).withColumn("role", F.when(F.col("vec_id") < F.col("half"), "train").otherwise("test")).withColumn(
        "yb", (F.col("y") >= 5).cast("double"))


def _invariance_cte(dims: int = 64) -> str:
    names = ", ".join(f"f{i}" for i in range(dims))
    return f"""{embedding_cte(dims)}, e2 AS (SELECT *, CASE WHEN y >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS yb,
        vec_id < (SELECT count(*) // 2 FROM emb) AS tr FROM emb),
    lg AS (UNPIVOT (SELECT vec_id, y, yb, tr, {names} FROM e2) ON {names} INTO NAME feature VALUE x),
    ct AS (SELECT feature, list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM lg WHERE tr GROUP BY 1),
    bn AS (SELECT lg.*, len(list_filter(cuts, lambda c: c <= x)) AS bin FROM lg JOIN ct USING (feature))"""


def _shift_sql(scale: str = "1", y: str = "yb") -> str:
    return f"""sf AS (SELECT feature, bin, count(*) FILTER (tr) AS n_train, count(*) FILTER (NOT tr) AS n_test,
        abs(avg({y}) FILTER (tr) - avg({y}) FILTER (NOT tr)) / {scale} AS diff FROM bn GROUP BY 1, 2
      HAVING count(*) FILTER (tr) >= 20 AND count(*) FILTER (NOT tr) >= 20)"""


@query("g21_conditional_invariance", f"""WITH {_invariance_cte()}, {_shift_sql()}
    SELECT feature, CAST(bin AS INTEGER) AS bin, n_train, n_test, round(diff, 6) AS diff FROM sf""")
def g21(spark, d):
    out = bin_shifts(embedding_sides(spark, d), [], EMBED_FEATURES, "binary", "yb")
    return out.select("feature", "bin", "n_train", "n_test", rounded("diff").alias("diff"))


@query("g21_invariance_summary", f"""WITH {_invariance_cte()}, {_shift_sql()}
    SELECT round(max(diff), 6) AS ci_max_abs_diff, round(avg(diff), 6) AS ci_mean_abs_diff, count(*) AS n_pairs,
           CAST(NULL AS VARCHAR) AS skipped_reason, max(diff) < 0.15 AS passes FROM sf""")
def g21_summary(spark, d):
    out = conditional_invariance(embedding_sides(spark, d), [], EMBED_FEATURES, "binary", "yb")
    return out.select(rounded("ci_max_abs_diff").alias("ci_max_abs_diff"), rounded("ci_mean_abs_diff").alias("ci_mean_abs_diff"),
                      "n_pairs", "skipped_reason", "passes")


@query("g21_invariance_regression", f"""WITH {_invariance_cte()}, {_shift_sql("(SELECT stddev_pop(y) FROM e2 WHERE tr)", "y")}
    SELECT feature, round(max(diff), 6) AS max_diff FROM sf GROUP BY 1 HAVING max(diff) > 0""")
def g21_regression(spark, d):
    out = per_feature_max(bin_shifts(embedding_sides(spark, d), [], EMBED_FEATURES, "regression", "y"))
    return out.withColumn("max_diff", rounded("max_diff"))


@query("g21_invariance_multiclass", f"""WITH {_invariance_cte()}, nb AS (SELECT feature, bin, count(*) FILTER (tr) AS a, count(*) FILTER (NOT tr) AS b FROM bn GROUP BY 1, 2),
      cl AS (SELECT feature, bin, y, count(*) FILTER (tr) AS ca, count(*) FILTER (NOT tr) AS cb FROM bn GROUP BY 1, 2, 3)
    SELECT feature, CAST(bin AS INTEGER) AS bin, max(a) AS n_train, max(b) AS n_test, round(max(abs(ca / a - cb / b)), 6) AS diff
    FROM cl JOIN nb USING (feature, bin) WHERE a >= 20 AND b >= 20 GROUP BY 1, 2""")
def g21_multiclass(spark, d):
    out = bin_shifts(embedding_sides(spark, d), [], EMBED_FEATURES, "multiclass", "y")
    return out.select("feature", "bin", "n_train", "n_test", rounded("diff").alias("diff"))


@query("g22_bootstrap_ci")
def g22(spark, d):
    rows = mean_probabilities(probability_rows(spark, d))
    return bootstrap_macro_auc(rows, 3, ["symbol"], ROW_ID)
