"""Dataset checks, fingerprints and feature selection."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barlab.catalog.inputs import (
    CHECK_FEATURES, EMBED_FEATURES, check_cte, check_matrix, embedding_cte, embedding_matrix,
    rounded, table,
)
from barlab.catalog.registry import query
from barlab.operators import integrity as it
from barlab.operators import selection as sel
from barlab.operators.neighbours import neighbour_information

K = ["symbol"]
def _end(spark, d):
    """The day after the last event."""
    last = F.date_trunc("day", F.max("ts")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return F.lit(table(spark, d, "events").agg(last).first()[0]).cast("timestamp_ntz")


CLEAN = [f for f in CHECK_FEATURES if f != "stops_early"]


def _out(df):
    return df.select("symbol", "check", "severity", rounded("actual").alias("actual"))


def _sql(name: str, body: str, actual: str, severity: str) -> str:
    return f"""WITH {check_cte()}, m AS ({body})
    SELECT symbol, '{name}' AS "check", {severity} AS severity, round(CAST({actual} AS DOUBLE), 6) AS actual FROM m"""


SQLS = {
    "min_rows": ("SELECT symbol, count(*) AS n FROM chk GROUP BY 1", "n", "CASE WHEN n < 1000 THEN 'FAIL' ELSE 'PASS' END"),
    "constant_features": (
        "SELECT symbol, " + " + ".join(f"CASE WHEN stddev_pop({f}) < 1e-12 THEN 1 ELSE 0 END" for f in CHECK_FEATURES)
        + " AS n FROM chk GROUP BY 1", "n", "CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END"),
    "stale_tail": (
        "SELECT symbol, " + " + ".join(
            f"CASE WHEN (SELECT date_trunc('day', max(ts)) + INTERVAL 1 DAY FROM events) - max(ts) FILTER ({f} IS NOT NULL) > INTERVAL 168 HOUR THEN 1 ELSE 0 END" for f in CHECK_FEATURES)
        + " AS n FROM chk GROUP BY 1", "n", "CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END"),
    "binary_class_balance": (
        "SELECT symbol, count(*) AS k, min(c) / sum(c) AS s FROM (SELECT symbol, y, count(*) AS c FROM chk GROUP BY 1, 2) GROUP BY 1", "s",
        "CASE WHEN k < 2 THEN 'FAIL' WHEN s < 0.15 THEN 'WARN' ELSE 'PASS' END"),
    "train_val_class_balance": (
        """SELECT symbol, abs(avg(y) FILTER (NOT v) - avg(y) FILTER (v)) AS s FROM (
             SELECT symbol, y, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1
               >= count(*) OVER (PARTITION BY symbol) - greatest(1, CAST(round_even(count(*) OVER (PARTITION BY symbol) * 0.2, 0) AS BIGINT)) AS v
             FROM chk) GROUP BY 1""", "s", "CASE WHEN s IS NULL THEN 'FAIL' WHEN s > 0.10 THEN 'WARN' ELSE 'PASS' END"),
    "label_stationarity": (
        """SELECT symbol, count(*) AS n, abs(avg(y) FILTER (h) - avg(y) FILTER (NOT h)) AS s FROM (
             SELECT symbol, y, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 < count(*) OVER (PARTITION BY symbol) // 2 AS h FROM chk) GROUP BY 1""",
        "s", "CASE WHEN n >= 200 AND s > 0.15 THEN 'WARN' ELSE 'PASS' END"),
    "multiclass_class_balance": (
        "SELECT symbol, count(*) AS k, min(c) AS mc, min(c) / sum(c) AS s FROM (SELECT symbol, y3, count(*) AS c FROM chk GROUP BY 1, 2) GROUP BY 1",
        "s", "CASE WHEN k < 2 OR mc < 50 OR s < 0.01 THEN 'FAIL' WHEN s < 0.05 THEN 'WARN' ELSE 'PASS' END"),
    "regression_label_distribution": (
        """SELECT symbol, any_value(sd) AS sd, count(*) FILTER (abs(yr - m) > 6 * sd) AS n FROM chk JOIN (
             SELECT symbol, avg(yr) AS m, stddev_pop(yr) AS sd FROM chk GROUP BY 1) USING (symbol) GROUP BY 1""", "n",
        "CASE WHEN sd = 0 THEN 'FAIL' WHEN n > 0 THEN 'WARN' ELSE 'PASS' END"),
    "label_leakage": (
        "SELECT symbol, greatest(" + ", ".join(
            f"CASE WHEN stddev_pop({f}) > 0 THEN abs(corr({f}, y)) END" for f in CLEAN if f != "flat") + ") AS s FROM chk GROUP BY 1",
        "s", "CASE WHEN s >= 0.95 THEN 'FAIL' ELSE 'PASS' END"),
}


@query("g23_min_rows", _sql("min_rows", *SQLS["min_rows"]))
def g23(spark, d):
    return _out(it.min_rows(check_matrix(spark, d), K))


@query("g24_constant_features", _sql("constant_features", *SQLS["constant_features"]))
def g24(spark, d):
    return _out(it.constant_features(check_matrix(spark, d), CHECK_FEATURES, K))


@query("g25_stale_tail", _sql("stale_tail", *SQLS["stale_tail"]))
def g25(spark, d):
    return _out(it.stale_tail(check_matrix(spark, d), CHECK_FEATURES, _end(spark, d), K))


@query("g26_binary_class_balance", _sql("binary_class_balance", *SQLS["binary_class_balance"]))
def g26(spark, d):
    return _out(it.binary_class_balance(check_matrix(spark, d), K))


@query("g27_train_val_class_balance", _sql("train_val_class_balance", *SQLS["train_val_class_balance"]))
def g27(spark, d):
    return _out(it.train_val_class_balance(check_matrix(spark, d), 0.2, K))


@query("g28_label_stationarity", _sql("label_stationarity", *SQLS["label_stationarity"]))
def g28(spark, d):
    return _out(it.label_stationarity(check_matrix(spark, d), K))


@query("g29_multiclass_class_balance", _sql("multiclass_class_balance", *SQLS["multiclass_class_balance"]))
def g29(spark, d):
    return _out(it.multiclass_class_balance(check_matrix(spark, d), K, "y3"))


@query("g30_regression_label_distribution", _sql("regression_label_distribution", *SQLS["regression_label_distribution"]))
def g30(spark, d):
    return _out(it.regression_label_distribution(check_matrix(spark, d), K, "yr"))


@query("g31_label_leakage_pearson", f"""WITH {check_cte()}
    SELECT symbol, feature, round(score, 6) AS score FROM (
      SELECT symbol, {", ".join(f"abs(corr({f}, y)) AS {f}" for f in CLEAN if f != "flat")} FROM chk GROUP BY 1)
    UNPIVOT (score FOR feature IN ({", ".join(f for f in CLEAN if f != "flat")}))""")
def g31(spark, d):
    return it.leakage_pearson(check_matrix(spark, d), CLEAN, K).withColumn("score", rounded("score"))


@query("k04_top5_leakage", f"""WITH {check_cte()}, s AS (
      SELECT symbol, feature, round(score, 6) AS score FROM (
        SELECT symbol, {", ".join(f"abs(corr({f}, y)) AS {f}" for f in CLEAN if f != "flat")} FROM chk GROUP BY 1)
      UNPIVOT (score FOR feature IN ({", ".join(f for f in CLEAN if f != "flat")})))
    SELECT symbol, feature, score, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, feature) AS rank FROM s
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, feature) <= 5""")
def k04(spark, d):
    s = it.leakage_pearson(check_matrix(spark, d), CLEAN, K).withColumn("score", rounded("score"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "feature"))
    return s.withColumn("rank", rank.cast("long")).filter("rank <= 5")


def mi_cte(source: str, feats, y: str, n_bins: int = 10) -> str:
    names = ", ".join(feats)
    probs = "[" + ", ".join(repr(i / n_bins) for i in range(1, n_bins)) + "]::DOUBLE[]"
    return f"""lg AS (UNPIVOT (SELECT {y} AS yy, {names} FROM {source}) ON {names} INTO NAME feature VALUE x),
    ct AS (SELECT feature, list_distinct(quantile_cont(x, {probs})) AS cuts FROM lg GROUP BY 1),
    cell AS (SELECT feature, len(list_filter(cuts, lambda c: c <= x)) AS bin, yy, count(*)::DOUBLE AS n FROM lg JOIN ct USING (feature) GROUP BY 1, 2, 3),
    mi AS (SELECT feature, greatest(0, sum(n / t * ln(n * t / (nb * ny)))) AS mi, any_value(h) AS h
           FROM (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, yy) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM cell)
           JOIN (SELECT feature, -sum(p * ln(p)) AS h FROM (SELECT feature, yy, sum(n) / sum(sum(n)) OVER (PARTITION BY feature) AS p FROM cell GROUP BY 1, 2) GROUP BY 1) USING (feature)
           GROUP BY 1)"""


def neighbour_cte(source: str, feats, y: str) -> str:
    """The nearest-neighbour estimate with three neighbours, by counting every row inside every interval."""
    names = ", ".join(feats)
    sides = ", ".join(f"{{'d': {d}, 'c': {f}(c, {j}) OVER w}}" for j in (1, 2, 3) for f, d in ((f"lag", f"x - lag(x, {j}) OVER w"), ("lead", f"lead(x, {j}) OVER w - x")))
    return f"""nl AS (UNPIVOT (SELECT {y} AS yy, {names} FROM {source}) ON {names} INTO NAME feature VALUE x),
    nc AS (SELECT feature, yy, x, count(*) AS c FROM nl GROUP BY ALL),
    nn AS (SELECT *, list_sort(list_filter([{sides}], lambda s: s.d IS NOT NULL)) AS near FROM nc WINDOW w AS (PARTITION BY feature, yy ORDER BY x)),
    nk AS (SELECT *, least(3, c - 1 + coalesce(list_sum(list_transform(near, lambda s: s.c)), 0)) AS k FROM nn),
    nr AS (SELECT *, CASE WHEN c - 1 >= k THEN 0 WHEN c - 1 + near[1].c >= k THEN near[1].d WHEN c - 1 + near[1].c + near[2].c >= k THEN near[2].d ELSE near[3].d END AS r
           FROM nk WHERE k > 0),
    nm AS (SELECT a.feature, a.yy, a.x, any_value(a.c) AS c, any_value(a.k) AS k, sum(b.c) AS m FROM nr a JOIN nc b ON b.feature = a.feature
             AND ((a.r = 0 AND b.x = a.x) OR (b.x > a.x - a.r AND b.x < a.x + a.r)) GROUP BY a.feature, a.yy, a.x),
    dg AS (SELECT n, coalesce(sum(1.0 / nullif(n - 1, 0)) OVER (ORDER BY n), 0) - 0.5772156649015329 AS psi FROM range(1, (SELECT count(*) + 2 FROM {source})) t(n)),
    ny AS (SELECT feature, yy, sum(c) AS c, sum(c) / sum(sum(c)) OVER (PARTITION BY feature) AS p FROM nc GROUP BY 1, 2),
    nh AS (SELECT feature, sum(ny.c * psi) FILTER (ny.c > 1) AS sc, -sum(p * ln(p)) AS h FROM ny JOIN dg ON dg.n = ny.c GROUP BY 1),
    ns AS (SELECT feature, sum(c) AS n, sum(c * (g1.psi - g2.psi)) AS s FROM nm JOIN dg g1 ON g1.n = k JOIN dg g2 ON g2.n = m GROUP BY 1),
    mi AS (SELECT ns.feature, greatest(0, psi + (s - sc) / ns.n) AS mi, h FROM ns JOIN nh USING (feature) JOIN dg ON dg.n = ns.n)"""


@query("g32_label_leakage_neighbours", f"""WITH {embedding_cte()}, {neighbour_cte("emb", EMBED_FEATURES, "y")}
    SELECT feature, round(mi, 6) AS mi, round(mi / h, 6) AS score FROM mi""")
def g32_neighbours(spark, d):
    out = neighbour_information(embedding_matrix(spark, d), EMBED_FEATURES)
    return out.select("feature", rounded("mi").alias("mi"), rounded("score").alias("score"))


@query("g37_neighbour_information", f"""WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) AS price, floor(CAST(o_totalprice AS DOUBLE) / 5000) AS steps, o_orderstatus AS y FROM orders),
    {neighbour_cte("o", ("price", "steps"), "y")}
    SELECT feature, round(mi, 6) AS mi, round(mi / h, 6) AS score FROM mi""")
def g37_neighbours(spark, d):
    """Order prices, once as they are and once with nothing but ties."""
    price = F.col("o_totalprice").cast("double")
    orders = table(spark, d, "orders").select(price.alias("price"), F.floor(price / 5000).cast("double").alias("steps"), F.col("o_orderstatus").alias("y"))
    return neighbour_information(orders, ["price", "steps"]).select("feature", rounded("mi").alias("mi"), rounded("score").alias("score"))


@query("g32_label_leakage_mi", f"""WITH {embedding_cte()}, {mi_cte("emb", EMBED_FEATURES, "y")}
    SELECT feature, round(mi, 6) AS mi, round(mi / h, 6) AS score FROM mi""")
def g32(spark, d):
    out = it.mutual_information(embedding_matrix(spark, d), EMBED_FEATURES)
    return out.select("feature", rounded("mi").alias("mi"), rounded("score").alias("score"))


@query("g37_mutual_information", f"""WITH {embedding_cte()}, e2 AS (SELECT *, y >= 5 AS yb FROM emb), {mi_cte("e2", EMBED_FEATURES, "yb")}
    SELECT feature, round(mi, 6) AS mi FROM mi""")
def g37(spark, d):
    out = it.mutual_information(embedding_matrix(spark, d).withColumn("yb", F.col("y") >= 5), EMBED_FEATURES, y="yb")
    return out.select("feature", rounded("mi").alias("mi"))


def _checks(spark, d):
    return it.check_suite(check_matrix(spark, d), CHECK_FEATURES, CLEAN, _end(spark, d), 0.2, K)


SUITE = ("min_rows", "constant_features", "stale_tail", "binary_class_balance", "train_val_class_balance", "label_stationarity", "label_leakage")


@query("g33_check_suite", f"""WITH {check_cte()}, {", ".join(f"m{i} AS ({SQLS[n][0]})" for i, n in enumerate(SUITE))}
    {" UNION ALL ".join(f"SELECT symbol, '{n}' AS check_name, {SQLS[n][2]} AS severity, round(CAST({SQLS[n][1]} AS DOUBLE), 6) AS actual FROM m{i}" for i, n in enumerate(SUITE))}""")
def g33_suite(spark, d):
    return _out(_checks(spark, d)).withColumnRenamed("check", "check_name")


@query("g33_worst_severity", f"""WITH {check_cte()}, {", ".join(
    f"m{i} AS (SELECT symbol, {SQLS[n][2]} AS s FROM ({SQLS[n][0]}))" for i, n in enumerate(
        ("min_rows", "constant_features", "stale_tail", "binary_class_balance", "train_val_class_balance", "label_stationarity", "label_leakage")))},
      u AS ({" UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(7))})
    SELECT symbol, CASE max(CASE s WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict,
      count(*) AS n_checks FROM u GROUP BY 1""")
def g33(spark, d):
    return it.worst_severity(_checks(spark, d), K)


@query("g34_dataset_sha", f"""WITH {check_cte()}
    SELECT symbol, sha256(concat_ws('|', symbol, 'long_win_tb', '1', CAST(count(*) AS VARCHAR), '{len(CHECK_FEATURES)}',
      strftime(min(ts), '%Y-%m-%dT%H:%M:%S'), strftime(max(ts), '%Y-%m-%dT%H:%M:%S'), '{",".join(sorted(CHECK_FEATURES))}')) AS dataset_sha
    FROM chk GROUP BY 1""")
def g34(spark, d):
    return it.dataset_sha(check_matrix(spark, d), CHECK_FEATURES, K, "long_win_tb", 1)


@query("g35_data_fingerprint", """WITH h AS (
      SELECT event_type, sha256(list_aggregate(list_transform([strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), CAST(CAST(value AS DECIMAL(28, 8)) AS VARCHAR), props],
        lambda t: coalesce(length(t) || ':' || t, 'n')), 'string_agg', '')) AS h FROM events),
      s AS (SELECT event_type, count(*) AS n, """ + ", ".join(
    f"sum(CAST(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT) AS HUGEINT)) AS l{i}" for i in range(4)) + """ FROM h GROUP BY 1)
    SELECT event_type, sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(l0 AS VARCHAR), CAST(l1 AS VARCHAR), CAST(l2 AS VARCHAR), CAST(l3 AS VARCHAR))) AS fingerprint FROM s""")
def g35(spark, d):
    return it.data_fingerprint(table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(28,8)")), ["event_id", "user_id", "value", "props"], ["event_type"])


def _corr_sql(dims: int) -> str:
    names = ", ".join(f"f{i}" for i in range(dims))
    return f"""{embedding_cte(dims)}, lg AS (UNPIVOT (SELECT vec_id, {names} FROM emb) ON {names} INTO NAME feature VALUE x),
    cm AS (SELECT a.feature AS i, b.feature AS j, round(abs(corr(a.x, b.x)), 6) AS corr FROM lg a JOIN lg b ON a.vec_id = b.vec_id GROUP BY 1, 2)"""


@query("g36_corr_matrix", f"WITH {_corr_sql(64)} SELECT * FROM cm")
def g36(spark, d):
    return sel.corr_matrix(embedding_matrix(spark, d), EMBED_FEATURES).withColumn("corr", rounded("corr"))


@query("c12_correlated_pairs", f"WITH {_corr_sql(64)} SELECT * FROM cm WHERE i < j AND corr > 0.12")
def c12(spark, d):
    return sel.correlated_pairs(sel.corr_matrix(embedding_matrix(spark, d), EMBED_FEATURES).withColumn("corr", rounded("corr")), 0.12)


@query("k05_top_features_by_mi", f"""WITH {embedding_cte()}, {mi_cte("emb", EMBED_FEATURES, "y")}
    SELECT feature, round(mi, 6) AS mi, row_number() OVER (ORDER BY round(mi, 6) DESC, feature) AS rank FROM mi ORDER BY rank LIMIT 8""")
def k05(spark, d):
    top = it.mutual_information(embedding_matrix(spark, d), EMBED_FEATURES).select("feature", rounded("mi").alias("mi"))
    top = top.orderBy(F.desc("mi"), "feature").limit(8)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")).cast("long"))


def _greedy_sql(information: str) -> str:
    return f"""WITH RECURSIVE {_corr_sql(64).replace("lg", "lc")}, {information},
    p AS (SELECT row_number() OVER (ORDER BY cm.i, cm.j) AS rn, cm.i AS a, cm.j AS b, ma.mi AS mia, mb.mi AS mib
          FROM cm JOIN mi ma ON ma.feature = cm.i JOIN mi mb ON mb.feature = cm.j WHERE cm.i < cm.j AND cm.corr > 0.12),
    walk AS (SELECT 0 AS rn, CAST([] AS VARCHAR[]) AS gone
             UNION ALL SELECT p.rn, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone
                                         ELSE list_append(gone, CASE WHEN mia < mib THEN a ELSE b END) END
             FROM walk JOIN p ON p.rn = walk.rn + 1),
    kept AS (SELECT feature, mi, CAST(substr(feature, 2) AS INTEGER) AS idx FROM mi
             WHERE NOT list_contains((SELECT gone FROM walk ORDER BY rn DESC LIMIT 1), feature)),
    best AS (SELECT feature, idx FROM kept ORDER BY mi DESC, idx LIMIT 7)
    SELECT (SELECT count(*) FROM emb) AS n_rows, CAST(row_number() OVER (ORDER BY idx) AS INTEGER) AS position, feature FROM best
    UNION ALL SELECT (SELECT count(*) FROM emb), 0, 'interval_indicator'"""


@query("g38_select_features", _greedy_sql(mi_cte("emb", EMBED_FEATURES, "y")))
def g38(spark, d):
    m = embedding_matrix(spark, d).withColumn("interval_indicator", F.lit(2.0))
    chosen = sel.select_features(m, ["interval_indicator", *EMBED_FEATURES], threshold=0.12, n_bins=10)
    return _picked(m, chosen)


def _picked(m, chosen):
    picked = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature")) for i, c in enumerate(chosen)])
    return m.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(picked).alias("p")).select("n_rows", "p.*")


@query("g38_select_features_neighbours", _greedy_sql(neighbour_cte("emb", EMBED_FEATURES, "y")))
def g38_neighbours(spark, d):
    m = embedding_matrix(spark, d).withColumn("interval_indicator", F.lit(2.0))
    return _picked(m, sel.select_features(m, ["interval_indicator", *EMBED_FEATURES], threshold=0.12))


@query("p18_feature_side_columns", f"""WITH {embedding_cte()}, m AS (SELECT 2.0::DOUBLE AS interval_indicator, {", ".join(EMBED_FEATURES)} FROM emb)
    SELECT feature, feature = 'interval_indicator' AS is_side, count(x) AS n, round(avg(x), 6) AS mean
    FROM (UNPIVOT m ON interval_indicator, {", ".join(EMBED_FEATURES)} INTO NAME feature VALUE x) GROUP BY 1""")
def p18(spark, d):
    """Every matrix column with its side: kept aside from selection, or a candidate."""
    m = embedding_matrix(spark, d).withColumn("interval_indicator", F.lit(2.0))
    names = ["interval_indicator", *EMBED_FEATURES]
    side = sel.side_columns(names)
    long = m.select(*names).unpivot([], names, "feature", "x")
    return long.groupBy("feature").agg(F.count("x").alias("n"), rounded(F.avg("x")).alias("mean")).withColumn("is_side", F.col("feature").isin(side))
