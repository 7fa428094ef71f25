"""Rolling bar features and forward labels as registered column builders.

Every builder adds one column to chunked bars and states how many rows back and ahead it reaches,
so one numbering and one shuffle serve any mix of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barlab.functions.corr import pearson
from barlab.operators.frames import add_halo, following, gated, number_rows, over_chunks, trailing

KEYS = ("symbol", "interval")
TS = "start_time"

Builder = Callable[[DataFrame, WindowSpec, str], DataFrame]


@dataclass(frozen=True)
class BarColumn:
    """A derived feature or label: its reach in rows and whether it is safe as a model input."""

    name: str
    family: str
    back: int
    ahead: int
    build: Builder
    pit_safe: bool = True
    symbols: tuple[str, ...] = ()


def _ratio_log(now: Column, then: Column) -> Column:
    return F.when((now > 0) & (then > 0), F.log(now / then))


def log_return(k: int, price: str = "close_price") -> Builder:
    def build(df: DataFrame, spec: WindowSpec, out: str) -> DataFrame:
        return df.withColumn(out, _ratio_log(F.col(price), F.lag(price, k).over(spec)))

    return build


def realized_vol(n: int) -> Builder:
    def build(df: DataFrame, spec: WindowSpec, out: str) -> DataFrame:
        step = log_return(1)(df, spec, "_r1")
        return step.withColumn(out, gated(F.stddev_samp, F.col("_r1"), trailing(spec, n), n)).drop("_r1")

    return build


def rolling_zscore(n: int, source: str = "volume", floor: float = 1e-12) -> Builder:
    def build(df: DataFrame, spec: WindowSpec, out: str) -> DataFrame:
        frame = trailing(spec, n)
        x = F.col(source)
        std = gated(F.stddev_samp, x, frame, n)
        return df.withColumn(out, F.when(std > floor, (x - F.avg(x).over(frame)) / std))

    return build


def atr(n: int = 14) -> Builder:
    """Mean true range; ``greatest`` skips nulls, so the first bar falls back to high - low."""

    def build(df: DataFrame, spec: WindowSpec, out: str) -> DataFrame:
        prev = F.lag("close_price", 1).over(spec)
        high, low = F.col("high_price"), F.col("low_price")
        ranged = df.withColumn("_tr", F.greatest(high - low, F.abs(high - prev), F.abs(low - prev)))
        return ranged.withColumn(out, gated(F.avg, F.col("_tr"), trailing(spec, n), n)).drop("_tr")

    return build


def forward_return(h: int) -> Builder:
    def build(df: DataFrame, spec: WindowSpec, out: str) -> DataFrame:
        close = F.col("close_price")
        return df.withColumn(out, F.when(close != 0, (F.lead("close_price", h).over(spec) - close) / close))

    return build


def forward_sharpe_sign(h: int) -> Builder:
    def build(df: DataFrame, spec: WindowSpec, out: str) -> DataFrame:
        step = forward_return(h)(log_return(1)(df, spec, "_r1"), spec, "_fwd")
        vol = gated(F.stddev_samp, F.col("_r1"), following(spec, h), h) * F.sqrt(F.lit(float(h)))
        sharpe = F.when(vol > 0, F.col("_fwd") / vol)
        sign = F.when(sharpe.isNotNull(), (sharpe > 0).cast("double"))
        return step.withColumn(out, sign).drop("_r1", "_fwd")

    return build


def triple_barrier(
    k_tp: float = 1.5,
    k_sl: float = 1.0,
    horizon: int = 24,
    atr_window: int = 14,
    side: str = "long",
    classes: str = "three",
) -> Builder:
    """First barrier touched in the next ``horizon`` bars.

    ``classes='three'``: +1 target first, -1 stop first or both in one bar, 0 neither.
    ``classes='win'``: 1 only when the target comes strictly first.
    """
    if side not in ("long", "short") or classes not in ("three", "win"):
        raise ValueError(f"unknown side/classes: {side!r}/{classes!r}")
    sign = 1.0 if side == "long" else -1.0
    good, bad = ("h", "l") if side == "long" else ("l", "h")

    def build(df: DataFrame, spec: WindowSpec, out: str) -> DataFrame:
        ahead = F.collect_list(F.struct(F.col("high_price").alias("h"), F.col("low_price").alias("l")))
        step = atr(atr_window)(df, spec, "_atr").withColumn("_path", ahead.over(following(spec, horizon)))
        target = F.col("close_price") + sign * k_tp * F.col("_atr")
        stop = F.col("close_price") - sign * k_sl * F.col("_atr")

        def first(field: str, level: Column, above: bool) -> Column:
            hit = lambda bar: (bar[field] >= level) if above else (bar[field] <= level)
            at = F.array_position(F.transform("_path", hit), True)
            return F.when(at > 0, at).otherwise(horizon + 1)

        step = step.withColumn("_tp", first(good, target, side == "long"))
        step = step.withColumn("_sl", first(bad, stop, side != "long"))
        win = F.col("_tp") < F.col("_sl")
        lose = F.col("_sl") <= horizon
        label = (
            F.when(win, 1.0).otherwise(0.0) if classes == "win"
            else F.when(win, 1.0).when(lose, -1.0).otherwise(0.0)
        )
        usable = (F.size("_path") == horizon) & F.col("_atr").isNotNull() & (F.col("_atr") > 0)
        return step.withColumn(out, F.when(usable, label)).drop("_atr", "_path", "_tp", "_sl")

    return build


def _barrier(name: str, horizon: int, k_tp: float, k_sl: float, symbols=(), **kw) -> BarColumn:
    return BarColumn(name, "label", 15, horizon, triple_barrier(k_tp, k_sl, horizon, **kw), False, symbols)


FEATURES: dict[str, BarColumn] = {
    c.name: c
    for c in (
        BarColumn("log_return_24", "technical", 24, 0, log_return(24)),
        BarColumn("realized_vol_168", "technical", 169, 0, realized_vol(168)),
        BarColumn("volume_zscore_24", "technical", 24, 0, rolling_zscore(24)),
        BarColumn("atr_14", "technical", 15, 0, atr(14)),
    )
}

LABELS: dict[str, BarColumn] = {
    c.name: c
    for c in (
        BarColumn("forward_return_24", "label", 0, 24, forward_return(24), False),
        BarColumn("forward_sharpe_sign_24", "label", 1, 24, forward_sharpe_sign(24), False),
        _barrier("triple_barrier", 24, 1.5, 1.0),
        _barrier("long_win_tb", 24, 1.5, 1.0, classes="win"),
        _barrier("long_win_tb_short", 6, 2.0, 0.75, classes="win"),
        _barrier("long_win_tb_loose", 6, 1.0, 0.5, classes="win"),
        _barrier("short_win_tb", 24, 1.5, 1.0, side="short", classes="win"),
    )
}


def derive(
    bars: DataFrame,
    columns: Sequence[str | BarColumn],
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add registered columns to bars; the halo is the widest reach among them."""
    chosen = [c if isinstance(c, BarColumn) else (FEATURES.get(c) or LABELS[c]) for c in columns]
    for c in chosen:
        if c.name in bars.columns:
            raise ValueError(f"column {c.name} already exists")

    def build(df: DataFrame, spec: WindowSpec) -> DataFrame:
        for c in chosen:
            df = c.build(df, spec, c.name)
        return df

    back = max((c.back for c in chosen), default=0)
    ahead = max((c.ahead for c in chosen), default=0)
    return over_chunks(bars, keys, [ts], back, ahead, build, chunk_rows)


def rolling_corr(
    bars: DataFrame, left: str, right: str, n: int = 24, out: str = "corr", chunk_rows: int | None = None
) -> DataFrame:
    """Rolling correlation of two symbols' one-bar returns over their *paired* bars.

    Pairing is one conditional aggregation per bar start; the result sits on the left symbol's bars.
    """
    single = BarColumn("_r1", "technical", 1, 0, log_return(1))
    two = bars.filter(F.col("symbol").isin(left, right)).select("symbol", "interval", TS, "close_price")
    returns = derive(two, [single], chunk_rows=chunk_rows)
    side = lambda s: F.max(F.when(F.col("symbol") == s, F.col("_r1")))
    paired = (
        returns.groupBy("interval", TS)
        .agg(side(left).alias("_a"), side(right).alias("_b"))
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    )

    def build(df: DataFrame, spec: WindowSpec) -> DataFrame:
        frame = trailing(spec, n)
        full = F.count(F.lit(1)).over(frame) == n
        return df.withColumn(out, F.when(full, pearson(F.col("_a"), F.col("_b"), frame)))

    rho = over_chunks(paired, ["interval"], [TS], n, 0, build, chunk_rows).select("interval", TS, out)
    grid = bars.filter(F.col("symbol") == left).select("symbol", "interval", TS)
    return grid.join(rho, ["interval", TS], "left").select("symbol", "interval", TS, out)


def forward_pctrank(
    bars: DataFrame,
    h: int = 24,
    window: int = 2160,
    min_periods: int = 720,
    out: str = "label",
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """1 when the forward log return ranks in the upper half of its trailing window.

    The rank over thousands of rows is a running order statistic, so each chunk (with its halo, at
    most ``chunk_rows + window + h`` rows) is ranked by one Arrow batch call.
    """
    names = [*keys, ts]
    spread = add_halo(number_rows(bars.select(*names, "close_price"), keys, [ts]), window + h, h, chunk_rows)
    spec = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    moved = spread.select(
        *names, "_chunk", "_core", "_rn",
        _ratio_log(F.lead("close_price", h).over(spec), F.col("close_price")).alias("_fwd"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.select(*names).schema)

    def rank(pdf):
        pdf = pdf.sort_values("_rn")
        pct = pdf["_fwd"].rolling(window, min_periods=min_periods).rank(pct=True)
        pdf[out] = (pct > 0.5).astype("float64").where(pct.notna())
        return pdf.loc[pdf["_core"], [*names, out]]

    ranked = moved.groupBy(*keys, "_chunk").applyInPandas(rank, f"{schema}, {out} double")
    return ranked.withColumn(out, F.when(~F.isnan(out), F.col(out)))


@dataclass(frozen=True)
class WholeColumn:
    """A label that needs more than a window frame: ``compute(bars, out)`` gives (keys, ts, out)."""

    name: str
    back: int
    ahead: int
    compute: Callable[[DataFrame, str], DataFrame]


def pctrank_label(h: int = 24, window: int = 2160, min_periods: int = 720, name: str = "forward_pctrank") -> WholeColumn:
    return WholeColumn(name, window + h, h, lambda bars, out: forward_pctrank(bars, h, window, min_periods, out))


WHOLE_LABELS: dict[str, WholeColumn] = {c.name: c for c in (pctrank_label(),)}


def label_column(label: str | BarColumn | WholeColumn) -> BarColumn | WholeColumn:
    """A registered label by name, or the given one."""
    if not isinstance(label, str):
        return label
    return LABELS.get(label) or WHOLE_LABELS[label]
