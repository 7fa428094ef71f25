"""Trade PnL under cost assumptions, and PnL by volatility and trend regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlab.functions.stats import student_t_cdf
from barlab.operators.attach import attach
from barlab.operators.ranks import quantiles

# Costs in basis points per round trip, mean true range per interval, barrier widths.
FEE_BPS = 8.0
FUNDING_BPS = 2.0
SLIPPAGE_BPS = {"realistic": 10.0, "conservative": 35.0, "adversarial": 60.0}
ATR_BPS = {"1h": 60.0, "15m": 30.0, "5m": 15.0, "4h": 130.0}
TAKE_PROFIT, STOP_LOSS = 1.5, 1.0

MIN_TRADES = 10
P_THRESHOLD = 0.05
MAX_FAILING = 1


def trade_pnl(df: DataFrame, interval: Column, y: str = "y", pred: str = "pred", take: str = "take") -> DataFrame:
    """Adds ``traded`` and ``gross_bps``. Classes: 0 down, 1 neither, 2 up; predicting 1 is no trade."""
    atr = F.element_at(F.create_map(*[F.lit(x) for kv in ATR_BPS.items() for x in kv]), interval)
    missing = F.raise_error(F.concat(F.lit("no range estimate for interval "), F.coalesce(interval, F.lit("null"))))
    up, down = F.col(y) == 2, F.col(y) == 0
    units = (
        F.when((F.col(pred) == 2) & up, TAKE_PROFIT)
        .when((F.col(pred) == 2) & down, -STOP_LOSS)
        .when((F.col(pred) == 0) & down, STOP_LOSS)
        .when((F.col(pred) == 0) & up, -STOP_LOSS)
        .otherwise(0.0)
    )
    traded = F.col(take) & (F.col(pred) != 1)
    return df.withColumn("traded", traded).withColumn(
        "gross_bps", F.when(F.col("traded"), units).otherwise(0.0) * F.coalesce(atr, missing.cast("double"))
    )


def round_trip_cost(regime: str = "realistic") -> float:
    return FEE_BPS + SLIPPAGE_BPS[regime] + FUNDING_BPS


def cost_regime_metrics(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gross statistics once per group, then three cost regimes by arithmetic on the sums.

    A group without trades keeps its rows: no mean, a total of 0, not profitable.
    """
    bps = F.when(F.col("traded"), F.col("gross_bps"))
    gross = trades.groupBy(*keys).agg(
        F.count_if("traded").alias("n_trades"), F.avg(bps).alias("gross_mean"),
        F.sum(bps).alias("_sum"), F.avg((bps > 0).cast("double")).alias("hit_rate"),
    )
    regimes = F.array(*[F.struct(F.lit(r).alias("regime"), F.lit(round_trip_cost(r)).alias("cost"))
                        for r in SLIPPAGE_BPS])
    net = F.col("gross_mean") - F.col("r.cost")
    return gross.withColumn("r", F.explode(regimes)).select(
        *keys, F.col("r.regime").alias("regime"), "n_trades", "gross_mean", "hit_rate",
        F.col("r.cost").alias("cost_bps"), net.alias("net_mean"),
        (F.coalesce("_sum", F.lit(0.0)) - F.col("n_trades") * F.col("r.cost")).alias("net_total"),
        F.coalesce((net > 0).cast("double"), F.lit(0.0)).alias("profitable"),
    )


def vol_flags(x: Column, low: Column, high: Column) -> dict[str, Column]:
    return {"low_vol": x < low, "high_vol": x > high}


def trend_flags(x: Column, bear: Column, bull: Column) -> dict[str, Column]:
    return {"bear": x < bear, "chop": (x >= bear) & (x < bull), "bull": x >= bull}


def add_regimes(
    rows: DataFrame, keys: Sequence[str], vol: str, trend: str, role: str = "role",
    vol_probs: tuple[float, float] = (0.25, 0.75), trend_probs: tuple[float, float] = (1 / 3, 2 / 3),
) -> DataFrame:
    """Boolean regime columns for the ``test`` rows, from exact quantiles of each key's ``train`` rows.

    Cut points are one row per key.
    """
    if not 0 < trend_probs[0] < trend_probs[1] < 1:
        raise ValueError("trend quantiles must satisfy 0 < low < high < 1")
    train = rows.filter(F.col(role) == "train")
    cuts = quantiles(train, keys, vol, vol_probs, "_v").join(quantiles(train, keys, trend, trend_probs, "_t"), list(keys))
    test = attach(rows.filter(F.col(role) == "test"), cuts, keys, F.hash(vol, trend))
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    flags = {
        **vol_flags(F.col(vol), at("_v", 0), at("_v", 1)), **trend_flags(F.col(trend), at("_t", 0), at("_t", 1))
    }
    return test.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("_v", "_t")


REGIMES = ("low_vol", "high_vol", "bear", "chop", "bull")


def regime_stats(
    trades: DataFrame, keys: Sequence[str], cost_bps: float, regimes: Sequence[str] = REGIMES
) -> DataFrame:
    """Trade count, mean net PnL, sample std and t statistic per regime, in one pass.

    Regimes overlap, so each is a conditional aggregate; a regime or a key without trades keeps its row.
    """
    net = F.when(F.col("traded"), F.col("gross_bps") - cost_bps)
    aggs = []
    for r in regimes:
        x = F.when(F.col(r), net)
        aggs += [F.count(x).alias(f"{r}_n"), F.avg(x).alias(f"{r}_m"), F.stddev_samp(x).alias(f"{r}_s")]
    wide = trades.groupBy(*keys).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(r).alias("regime"), F.col(f"{r}_n").alias("n"), F.col(f"{r}_m").alias("mean_net"),
                 F.col(f"{r}_s").alias("std_net")) for r in regimes
    ])
    long = wide.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")
    std = F.coalesce(F.col("std_net"), F.lit(0.0))
    return long.withColumn("std_net", F.when(F.col("n") > 0, std)).withColumn(
        "t_stat", F.when(F.col("std_net") > 0, F.col("mean_net") / (F.col("std_net") / F.sqrt("n")))
    )


def regime_subcuts(
    trades: DataFrame, keys: Sequence[str], cost_bps: float | None = None, regimes: Sequence[str] = REGIMES,
    min_trades: int = MIN_TRADES, p_threshold: float = P_THRESHOLD,
) -> DataFrame:
    """One-sided t-test (mean below zero) per regime; regimes under ``min_trades`` are not tested."""
    stats = regime_stats(trades, keys, round_trip_cost() if cost_bps is None else cost_bps, regimes)
    tested = F.col("n") >= min_trades
    p = F.when(tested, F.when(F.col("std_net") == 0, F.when(F.col("mean_net") < 0, 0.0).otherwise(1.0)).otherwise(
        student_t_cdf(F.col("t_stat"), (F.col("n") - 1).cast("double"))))
    return stats.withColumn("p_value", p).withColumn(
        "failing", F.when(tested, (F.col("p_value") < p_threshold).cast("double")).otherwise(0.0)
    ).withColumn("caveat", (~tested).cast("double"))


def regime_gate(subcuts: DataFrame, keys: Sequence[str], max_failing: int = MAX_FAILING) -> DataFrame:
    return subcuts.groupBy(*keys).agg(
        F.count_if(F.col("caveat") == 0).alias("n_checked"), F.sum("failing").alias("n_failing"),
        (F.sum("failing") <= max_failing).cast("double").alias("gate_pass"), F.max("caveat").alias("gate_caveat"),
    )
