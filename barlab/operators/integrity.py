"""Dataset checks, each a small aggregate turned into (key, check, severity, actual)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.corr import pearson
from barlab.functions.times import micros
from barlab.operators.attach import attach
from barlab.operators.frames import number_rows
from barlab.operators.ranks import quantiles
from barlab.operators.splits import halves, split_chronological
from barlab.session import cut_lineage

# Check thresholds.
MIN_ROWS = 1000
MIN_CLASS_SHARE = 0.15
BALANCE_DRIFT = 0.10
STATIONARITY_DRIFT = 0.15
STATIONARITY_MIN_ROWS = 200
OUTLIER_STD = 6.0
CONSTANT_STD = 1e-12
STALE_HOURS = 168
LEAKAGE = 0.95
MULTI_FAIL_SHARE, MULTI_WARN_SHARE, MULTI_MIN_ROWS = 0.01, 0.05, 50

_RANK = {"PASS": 0, "WARN": 1, "FAIL": 2}


def _check(df: DataFrame, keys: Sequence[str], name: str, severity: Column, actual: Column) -> DataFrame:
    return df.select(
        *keys, F.lit(name).alias("check"), severity.alias("severity"), actual.cast("double").alias("actual")
    )


def _warn(bad: Column) -> Column:
    return F.when(bad, "WARN").otherwise("PASS")


def min_rows(df: DataFrame, keys: Sequence[str] = (), threshold: int = MIN_ROWS) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _check(n, keys, "min_rows", F.when(F.col("n") < threshold, "FAIL").otherwise("PASS"), F.col("n"))


def feature_std(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.stddev_pop(f).alias(f) for f in features]).unpivot(
        list(keys), list(features), "feature", "std"
    )


def constant_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    flat = F.count_if(F.col("std") < CONSTANT_STD)
    n = feature_std(df, features, keys).groupBy(*keys).agg(flat.alias("n"))
    return _check(n, keys, "constant_features", _warn(F.col("n") > 0), F.col("n"))


def stale_hours(
    df: DataFrame, features: Sequence[str], end: Column, keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Hours from each feature's last non-null value to ``end`` (a column of ``df``, constant per key)."""
    last = df.groupBy(*keys).agg(
        F.max(end).alias("_end"), *[F.max(F.when(F.col(f).isNotNull(), F.col(ts))).alias(f) for f in features]
    )
    long = last.unpivot([*keys, "_end"], list(features), "feature", "last_ts").filter(F.col("last_ts").isNotNull())
    gap = (micros("_end") - micros("last_ts")) / 3_600_000_000
    return long.select(*keys, "feature", gap.alias("hours"), (gap > STALE_HOURS).alias("stale"))


def stale_tail(df: DataFrame, features: Sequence[str], end: Column, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    n = stale_hours(df, features, end, keys, ts).groupBy(*keys).agg(F.count_if("stale").alias("n"))
    return _check(n, keys, "stale_tail", _warn(F.col("n") > 0), F.col("n"))


def _class_counts(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    counts = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"), F.min("_c").alias("min_count"), F.sum("_c").alias("n")
    )


def binary_class_balance(df: DataFrame, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    share = F.col("min_count") / F.col("n")
    severity = F.when(F.col("classes") < 2, "FAIL").when(share < MIN_CLASS_SHARE, "WARN").otherwise("PASS")
    return _check(_class_counts(df, keys, y), keys, "binary_class_balance", severity, share)


def multiclass_class_balance(df: DataFrame, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    share = F.col("min_count") / F.col("n")
    severity = (
        F.when((F.col("classes") < 2) | (F.col("min_count") < MULTI_MIN_ROWS) | (share < MULTI_FAIL_SHARE), "FAIL")
        .when(share < MULTI_WARN_SHARE, "WARN").otherwise("PASS")
    )
    return _check(_class_counts(df, keys, y), keys, "multiclass_class_balance", severity, share)


def train_val_class_balance(
    df: DataFrame, val_fraction: float, keys: Sequence[str] = (), order: Sequence[str] = ("ts",), y: str = "y"
) -> DataFrame:
    split = split_chronological(df, val_fraction, keys, order)
    p = lambda role: F.avg(F.when(F.col("role") == role, F.col(y).cast("double")))
    m = split.groupBy(*keys).agg(F.abs(p("train") - p("val")).alias("drift"))
    severity = F.when(F.col("drift").isNull(), "FAIL").when(F.col("drift") > BALANCE_DRIFT, "WARN").otherwise("PASS")
    return _check(m, keys, "train_val_class_balance", severity, F.col("drift"))


def label_stationarity(
    df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("ts",), y: str = "y"
) -> DataFrame:
    p = lambda h: F.avg(F.when(F.col("half") == h, F.col(y).cast("double")))
    m = halves(df, keys, order).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.abs(p(1) - p(2)).alias("drift")
    )
    bad = (F.col("n") >= STATIONARITY_MIN_ROWS) & (F.col("drift") > STATIONARITY_DRIFT)
    return _check(m, keys, "label_stationarity", _warn(bad), F.col("drift"))


def regression_label_distribution(df: DataFrame, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Fails a constant label, warns on values beyond six standard deviations (second pass)."""
    stats = df.groupBy(*keys).agg(F.avg(y).alias("_m"), F.stddev_pop(y).alias("_s"))
    joined = df.join(stats, list(keys)) if keys else df.join(F.broadcast(stats))
    far = F.abs(F.col(y) - F.col("_m")) > OUTLIER_STD * F.col("_s")
    m = joined.groupBy(*keys).agg(F.max("_s").alias("_s"), F.count_if(far).alias("n"))
    severity = F.when(F.col("_s") == 0, "FAIL").when(F.col("n") > 0, "WARN").otherwise("PASS")
    return _check(m, keys, "regression_label_distribution", severity, F.col("n"))


def leakage_pearson(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    """|correlation| of every feature with the label, one aggregation; constants are left out."""
    label = F.col(y).cast("double")
    wide = df.groupBy(*keys).agg(*[F.abs(pearson(F.col(f).cast("double"), label)).alias(f) for f in features])
    return wide.unpivot(list(keys), list(features), "feature", "score").filter(
        F.col("score").isNotNull()
    )


def mutual_information(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), y: str = "y", n_bins: int = 10
) -> DataFrame:
    """Mutual information (nats) of each feature's quantile bin with the class, and its share of H(y).

    Bins are exact quantiles over every row, so the work reduces to (feature, bin, class) counts.
    """
    by = [*keys, "feature"]
    long = df.select(*keys, F.col(y).alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [*keys, "_y"], list(features), "feature", "x"
    ).filter(F.col("x").isNotNull())
    cuts = quantiles(long, by, "x", [i / n_bins for i in range(1, n_bins)], "_cuts")
    bin_ = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.col("x"))).alias("_bin")
    cells = attach(long, cuts, by, F.col("x")).groupBy(*by, bin_, "_y").agg(F.count(F.lit(1)).alias("_n"))
    sums = lambda *k: F.sum("_n").over(Window.partitionBy(*by, *k))
    joint = cells.withColumn("_t", sums()).withColumn("_nb", sums("_bin")).withColumn("_ny", sums("_y"))
    p = lambda c: F.col(c) / F.col("_t")
    term = p("_n") * F.log(F.col("_n") * F.col("_t") / (F.col("_nb") * F.col("_ny")))
    entropy = -p("_n") * F.log(p("_ny"))
    return joint.groupBy(*by).agg(F.sum(term).alias("mi"), F.sum(entropy).alias("_h")).select(
        *by, F.greatest(F.col("mi"), F.lit(0.0)).alias("mi"),
        F.when(F.col("_h") > 0, F.greatest(F.col("mi"), F.lit(0.0)) / F.col("_h")).alias("score"),
    )


def label_leakage(scores: DataFrame, keys: Sequence[str] = (), threshold: float = LEAKAGE) -> DataFrame:
    m = scores.groupBy(*keys).agg(F.max("score").alias("s"))
    severity = F.when(F.col("s") >= threshold, "FAIL").otherwise("PASS")
    return _check(m, keys, "label_leakage", severity, F.col("s"))


def combine(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def check_suite(
    df: DataFrame, features: Sequence[str], leakage_features: Sequence[str], end: Column, val_fraction: float,
    keys: Sequence[str] = (), order: Sequence[str] = ("ts",), y: str = "y", ts: str = "ts",
) -> DataFrame:
    """The checks of a binary label (0 or 1; anything else is one further class) as (keys, check, severity, actual).

    Rows are ranked once; every check is a few columns of one grouped aggregate over them, unfolded at the end, so the input is
    not read once per check. Equal to the single checks put together.
    """
    needed = dict.fromkeys([*keys, *order, ts, y, *features, *leakage_features])
    rows = cut_lineage(df.select(*needed, end.alias("_end")))  # ranking reads it three times, the columns that lead here once
    ranked = number_rows(rows, keys, order, "_rn", "_total")
    label = F.col(y).cast("double")
    late = F.col("_rn") >= F.col("_total") - F.greatest(F.lit(1), F.bround(F.col("_total") * val_fraction).cast("long"))
    second = F.col("_rn") >= F.floor(F.col("_total") / 2)
    mean = lambda where: F.avg(F.when(where, label))
    stats = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("_end").alias("_end"),
        *[F.stddev_pop(f).alias(f"std_{f}") for f in features], *[F.max(F.when(F.col(f).isNotNull(), F.col(ts))).alias(f"last_{f}") for f in features],
        F.count_if(label == 0).alias("n0"), F.count_if(label == 1).alias("n1"),
        F.abs(mean(~late) - mean(late)).alias("balance"), F.abs(mean(~second) - mean(second)).alias("drift"),
        *[F.abs(pearson(F.col(f).cast("double"), label)).alias(f"corr_{f}") for f in leakage_features],
    )
    total = lambda flags: sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    flat = total([F.col(f"std_{f}") < CONSTANT_STD for f in features])
    stale = total([(micros("_end") - micros(f"last_{f}")) / 3_600_000_000 > STALE_HOURS for f in features])
    counts = F.filter(F.array("n0", "n1", F.col("n") - F.col("n0") - F.col("n1")), lambda c: c > 0)
    share = F.array_min(counts) / F.col("n")
    leak = F.array_max(F.array(*[F.col(f"corr_{f}") for f in leakage_features]))
    checks = {
        "min_rows": (F.when(F.col("n") < MIN_ROWS, "FAIL").otherwise("PASS"), F.col("n")),
        "constant_features": (_warn(flat > 0), flat),
        "stale_tail": (_warn(stale > 0), stale),
        "binary_class_balance": (F.when(F.size(counts) < 2, "FAIL").when(share < MIN_CLASS_SHARE, "WARN").otherwise("PASS"), share),
        "train_val_class_balance": (F.when(F.col("balance").isNull(), "FAIL").when(F.col("balance") > BALANCE_DRIFT, "WARN").otherwise("PASS"), F.col("balance")),
        "label_stationarity": (_warn((F.col("n") >= STATIONARITY_MIN_ROWS) & (F.col("drift") > STATIONARITY_DRIFT)), F.col("drift")),
        "label_leakage": (F.when(leak.isNull(), None).when(leak >= LEAKAGE, "FAIL").otherwise("PASS"), leak),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("check"), severity.alias("severity"), actual.cast("double").alias("actual"))
                     for name, (severity, actual) in checks.items()])
    return stats.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*").filter(F.col("severity").isNotNull())


def worst_severity(checks: DataFrame, keys: Sequence[str] = (), allow_leakage: bool = False) -> DataFrame:
    """FAIL > WARN > PASS; an allowed leakage failure only warns."""
    severity = F.col("severity")
    if allow_leakage:
        severity = F.when((F.col("check") == "label_leakage") & (severity == "FAIL"), "WARN").otherwise(severity)
    rank = F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])
    names = F.array(*[F.lit(s) for s in _RANK])
    worst = F.max(F.element_at(rank, severity))
    return checks.groupBy(*keys).agg(F.get(names, worst).alias("verdict"), F.count(F.lit(1)).alias("n_checks"))


def dataset_sha(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], label: str, label_version: int, ts: str = "ts"
) -> DataFrame:
    """Hash of shape, window and names only; refreshed values keep it."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat_ws(
        "|", *keys, F.lit(label), F.lit(str(label_version)), F.count(F.lit(1)).cast("string"),
        F.lit(str(len(features))), stamp(F.min(ts)), stamp(F.max(ts)), F.lit(",".join(sorted(features))),
    )
    return df.groupBy(*keys).agg(F.sha2(text, 256).alias("dataset_sha"))


def data_fingerprint(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts"
) -> DataFrame:
    """Hash that changes with any value or timestamp.

    Every row is hashed with its timestamp, each field behind its length (a null is ``n``), so no two rows share a text; four 60-bit lanes of the row hashes are summed,
    so the digest is a plain sum with partial aggregation and needs no order and no lists.
    """
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = [stamp, *[F.col(c).cast("string") for c in columns]]
    framed = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in text]
    row = F.sha2(F.concat(*framed), 256)
    lane = lambda i: F.sum(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
    parts = [F.count(F.lit(1)).cast("string"), *[lane(i).cast("string") for i in range(4)]]
    return df.groupBy(*keys).agg(F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))
