"""Model dataset: grid, per-bar features, as-of global features, derived features and label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from barlab.functions.times import default_cap_hours, seconds_of
from barlab.operators.align import drop_incomplete, feature_coverage, long_to_wide, stack_intervals
from barlab.operators.asof import asof_wide
from barlab.operators.features import FEATURES, KEYS, TS, BarColumn, WholeColumn, derive, label_column, rolling_corr
from barlab.sources.bars import bar_grid
from barlab.sources.store import BUNDLE_HALO, market_bundle, read_features, read_global_features

GLOBAL_CAP_HOURS = 168.0


#: Bars of a pair correlation.
PAIR_FRAME = 24


@dataclass(frozen=True)
class DatasetSpec:
    """What to load. ``per_bar`` and ``shared`` map feature name to version; ``caps`` maps it to its
    maximum age in hours; ``exact`` lists global features that are not carried forward."""

    symbols: tuple[str, ...]
    interval: str
    start: datetime
    end: datetime
    label: str | BarColumn | WholeColumn
    per_bar: Mapping[str, int] = field(default_factory=dict)
    shared: Mapping[str, int] = field(default_factory=dict)
    caps: Mapping[str, float] = field(default_factory=dict)
    exact: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()
    training_intervals: tuple[str, ...] = ()
    pairs: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # column -> two symbols, whose returns are correlated

    @property
    def features(self) -> list[str]:
        """Column order: per-bar, global, derived, pair correlations."""
        return [*self.per_bar, *self.shared, *self.derived, *self.pairs]

    def halo(self, interval: str) -> timedelta:
        """How far bars are read beyond the range: the widest frame among the derived columns and the label."""
        chosen = [*(FEATURES[c] for c in self.derived), label_column(self.label)]
        reach = max([PAIR_FRAME * bool(self.pairs), *(max(c.back, c.ahead) for c in chosen)])
        return max(BUNDLE_HALO, timedelta(seconds=(reach + 1) * seconds_of(interval)))


def from_registry(scoped: DataFrame, base: DatasetSpec) -> DatasetSpec:
    """Fill feature names, versions, caps and policies from classified registry rows.

    The registry lists feature definitions, not values, so its rows decide the matrix columns here.
    """
    rows = scoped.filter(F.col("scope") != "skip").orderBy("feature_name").collect()
    local = {r.feature_name: r.version for r in rows if r.scope == "per_bar"}
    shared = {r.feature_name: r.version for r in rows if r.scope == "global"}
    caps = {r.feature_name: float(r.max_ffill_age_hours) for r in rows if r.max_ffill_age_hours}
    exact = tuple(r.feature_name for r in rows if r.scope == "global" and r.ffill_policy != "last_value")
    return replace(base, per_bar=local, shared=shared, caps=caps, exact=exact)


def _symbol_grid(spec: DatasetSpec, spark, interval: str) -> DataFrame:
    symbols = F.array(*[F.lit(s) for s in spec.symbols])
    return bar_grid(spark, spec.start, spec.end, interval).select(F.explode(symbols).alias("symbol"), "ts")


def load_matrix(store: DataFrame, bars: DataFrame, spec: DatasetSpec, interval: str | None = None) -> DataFrame:
    """Every grid slot of every symbol with its features and label ``y``; gaps are null.

    At an ``interval`` other than the spec's own, per-bar features are carried onto the finer grid
    with an age cap and derived columns are computed from that interval's bars.
    """
    spark = store.sparkSession
    interval = interval or spec.interval
    serving = interval == spec.interval
    step, origin = seconds_of(interval), F.lit(spec.start).cast("timestamp_ntz")
    matrix = _symbol_grid(spec, spark, interval)
    if spec.per_bar:
        values = read_features(store, spec.per_bar, spec.symbols, spec.interval, spec.start, spec.end)
        if serving:
            local = long_to_wide(values, list(spec.per_bar))
        else:
            caps = {n: spec.caps.get(n, default_cap_hours(spec.interval)) for n in spec.per_bar}
            local = asof_wide(matrix, values, caps, step, origin, keys=["symbol"])
        matrix = matrix.join(local, ["symbol", "ts"], "left")
    if spec.shared:
        caps = {n: spec.caps.get(n, GLOBAL_CAP_HOURS) for n in spec.shared}
        values = read_global_features(store, spec.shared, spec.start, spec.end)
        shared = asof_wide(bar_grid(spark, spec.start, spec.end, interval), values, caps, step, origin, exact=spec.exact)
        matrix = matrix.join(shared, "ts", "left")
    needed = list(dict.fromkeys([*spec.symbols, *(s for pair in spec.pairs.values() for s in pair)]))
    around = market_bundle(bars, needed, interval, spec.start, spec.end, spec.halo(interval))
    bundle = around.filter(F.col("symbol").isin(list(spec.symbols)))
    label = label_column(spec.label)
    framed = [*spec.derived, *([label] if isinstance(label, BarColumn) else [])]
    wide = derive(bundle, framed) if framed else bundle
    if isinstance(label, WholeColumn):
        wide = wide.join(label.compute(bundle, label.name), [*KEYS, TS], "left")
    wide = wide.select("symbol", F.col(TS).alias("ts"), *spec.derived, F.col(label.name).alias("y"))
    matrix = matrix.join(wide, ["symbol", "ts"], "left")
    for name, (left, right) in spec.pairs.items():
        rho = rolling_corr(around, left, right, PAIR_FRAME, name).select(F.col(TS).alias("ts"), name)
        matrix = matrix.join(rho, "ts", "left")
    return matrix.select("symbol", "ts", *spec.features, "y")


def load_dataset(store: DataFrame, bars: DataFrame, spec: DatasetSpec, interval: str | None = None) -> DataFrame:
    """Complete rows. A feature without any value leaves the columns first, so it cannot empty the dataset; if no complete
    row is left even so, that is an error."""
    matrix = load_matrix(store, bars, spec, interval)
    present = matrix.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in [*spec.features, "y"]]).first()
    kept = [c for c in spec.features if present[c]]
    complete = drop_incomplete(matrix.select("symbol", "ts", *kept, "y"), [*kept, "y"])
    if not present["y"] or complete.isEmpty():
        raise ValueError(f"no complete row between {spec.start} and {spec.end}; without values: {[c for c in spec.features if not present[c]]}")
    return complete


def load_stacked(store: DataFrame, bars_by_interval: Mapping[str, DataFrame], spec: DatasetSpec) -> DataFrame:
    """Datasets of all training intervals stacked, serving interval first among equal timestamps."""
    pieces = [(i, load_dataset(store, bars_by_interval[i], spec, i)) for i in spec.training_intervals]
    return stack_intervals(pieces)


def coverage(matrix: DataFrame, spec: DatasetSpec, keys: Sequence[str] = ()) -> DataFrame:
    return feature_coverage(matrix, [*spec.features, "y"], keys)


def horizon_hours(label: str | BarColumn | WholeColumn, interval: str) -> float:
    """How far a label looks ahead; the smallest embargo that keeps it out of the next window."""
    return label_column(label).ahead * seconds_of(interval, ("1m", "5m", "15m", "1h", "4h", "1d")) / 3600


def check_embargo(label: str, interval: str, embargo_days: float) -> None:
    need = horizon_hours(label, interval) / 24
    if embargo_days < need:
        raise ValueError(f"embargo of {embargo_days} days is shorter than the label's {need:g} days")
