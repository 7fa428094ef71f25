"""Chunked frames, features and labels against plain pandas definitions."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from barlab.operators import features as fe
from barlab.operators.frames import number_rows

START = datetime(2024, 1, 1)


def bars(spark, n=300, seed=0, symbols=("a", "b"), gap=True):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i in range(n):
            if gap and 40 <= i < 47 and s == "a":
                continue
            c = float(price[i])
            rows.append((s, "1h", START + timedelta(hours=i), c, c * 1.003, c * 0.997, c, float(rng.lognormal()), 1))
    cols = "symbol string, interval string, start_time timestamp_ntz, open_price double, high_price double, low_price double, close_price double, volume double, trade_count long"
    return spark.createDataFrame(rows, cols)


def to_pandas(df):
    return df.toPandas().sort_values(["symbol", "start_time"]).reset_index(drop=True)


def test_numbering_is_global_per_key(spark):
    df = bars(spark)
    got = to_pandas(number_rows(df, ["symbol"], ["start_time"], "rn", "total"))
    for _, g in got.groupby("symbol"):
        assert list(g["rn"]) == list(range(len(g)))
        assert set(g["total"]) == {len(g)}


@pytest.mark.parametrize("chunk", [7, 50, None])
def test_chunks_do_not_change_results(spark, chunk):
    names = ["log_return_24", "volume_zscore_24", "atr_14", "triple_barrier", "forward_sharpe_sign_24", "short_win_tb"]
    df = bars(spark)
    whole = df
    spec = Window.partitionBy("symbol", "interval").orderBy("start_time")
    for n in names:
        col = fe.FEATURES.get(n) or fe.LABELS[n]
        whole = col.build(whole, spec, n)
    a, b = to_pandas(fe.derive(df, names, chunk_rows=chunk)), to_pandas(whole)
    assert len(a) == len(b)
    for n in names:
        np.testing.assert_allclose(a[n].to_numpy(float), b[n].to_numpy(float), rtol=1e-9, equal_nan=True)


def test_realized_vol_matches_pandas(spark):
    col = fe.BarColumn("v", "technical", 25, 0, fe.realized_vol(24))
    got = to_pandas(fe.derive(bars(spark), [col], chunk_rows=31))
    for _, g in got.groupby("symbol"):
        want = np.log(g["close_price"] / g["close_price"].shift()).rolling(24).std()
        np.testing.assert_allclose(g["v"].to_numpy(float), want.to_numpy(), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("chunk", [17, None])
def test_pctrank_matches_pandas(spark, chunk):
    got = to_pandas(fe.forward_pctrank(bars(spark), 5, 60, 20, chunk_rows=chunk))
    close = to_pandas(bars(spark))
    for s, g in got.groupby("symbol"):
        c = close.loc[close["symbol"] == s, "close_price"].reset_index(drop=True)
        pct = np.log(c.shift(-5) / c).rolling(60, min_periods=20).rank(pct=True)
        want = (pct > 0.5).astype(float).where(pct.notna())
        np.testing.assert_array_equal(g["label"].to_numpy(float), want.to_numpy())


def test_rolling_corr_pairs_first(spark):
    got = fe.rolling_corr(bars(spark), "a", "b", 24, chunk_rows=40).toPandas().sort_values("start_time")
    pdf = to_pandas(bars(spark))
    side = {s: g.set_index("start_time")["close_price"] for s, g in pdf.groupby("symbol")}
    pair = pd.DataFrame({s: np.log(c / c.shift()) for s, c in side.items()}).dropna()
    want = pair["a"].rolling(24).corr(pair["b"]).reindex(side["a"].index)
    np.testing.assert_allclose(got["corr"].to_numpy(float), want.to_numpy(), rtol=1e-7, equal_nan=True)


def path(spark, highs, lows):
    """14 flat warm-up bars with true range 2, then the given bars, entry at the last flat bar."""
    rows = [("x", "1h", START + timedelta(hours=i), 100.0, 101.0, 99.0, 100.0, 1.0, 1) for i in range(15)]
    for j, (h, l) in enumerate(zip(highs, lows), 15):
        rows.append(("x", "1h", START + timedelta(hours=j), 100.0, float(h), float(l), 100.0, 1.0, 1))
    return spark.createDataFrame(rows, bars(spark, 1).schema)


@pytest.mark.parametrize("highs,lows,three,win", [
    ([103.5, 100, 100], [99.5, 99.5, 97], 1.0, 1.0),
    ([100.5, 103.5, 100], [97.5, 99.5, 99.5], -1.0, 0.0),
    ([103.5, 100, 100], [97.5, 99.5, 99.5], -1.0, 0.0),
    ([100.5, 100.5, 100.5], [99.5, 99.5, 99.5], 0.0, 0.0),
])
def test_triple_barrier_cases(spark, highs, lows, three, win):
    cols = [fe.BarColumn(c, "label", 15, 3, fe.triple_barrier(1.5, 1.0, 3, classes=c), False) for c in ("three", "win")]
    got = to_pandas(fe.derive(path(spark, highs, lows), cols))
    assert got.loc[14, "three"] == three and got.loc[14, "win"] == win
    assert got["three"].iloc[-3:].isna().all() and got["three"].iloc[:13].isna().all()


def test_collision_is_rejected(spark):
    with pytest.raises(ValueError):
        fe.derive(bars(spark).withColumn("atr_14", F.lit(1.0)), ["atr_14"])
