"""Queries of statistics and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import aggregate as A
from seqloom.plans.catalog import query
from seqloom.session import table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(parts):
    return " UNION ALL ".join(parts)


@query("column_stats", union(
    f"""SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean,
    round(coalesce(stddev_samp({c}), 0), 6) AS dev, round(median({c}), 6) AS med, min({c}) AS lo, max({c}) AS hi FROM lineitem""" for c in NUMERIC))
def column_stats(spark, sf_dir):
    return A.column_stats(table(spark, sf_dir, "lineitem"), NUMERIC)


_NOMINAL = """WITH c AS (SELECT {c} AS v, count(*) AS c FROM {t} GROUP BY {c}), k AS (SELECT * FROM c WHERE v IS NOT NULL)
SELECT (SELECT sum(c) FROM k)::BIGINT AS n, coalesce((SELECT sum(c) FROM c WHERE v IS NULL), 0)::BIGINT AS missing, (SELECT count(*) FROM k) AS n_values,
(SELECT v FROM k ORDER BY c DESC, v LIMIT 1) AS mode, (SELECT round(max(c) / sum(c), 6) FROM k) AS mode_share,
(SELECT round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) FROM k) AS entropy"""


@query("nominal_stats", _NOMINAL.format(t="lineitem", c="l_returnflag"))
def nominal_stats(spark, sf_dir):
    return A.nominal_stats(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("event_type_stats", _NOMINAL.format(t="events", c="event_type"))
def event_type_stats(spark, sf_dir):
    return A.nominal_stats(table(spark, sf_dir, "events"), "event_type")


@query("baseline_values", "SELECT round(avg(l_quantity), 6) AS mean_quantity, (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_status FROM lineitem")
def baseline_values(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return A.baseline(df, "l_quantity", False).select(F.round("baseline", 6).alias("mean_quantity")).crossJoin(A.baseline(df, "l_linestatus", True).select(F.col("baseline").alias("mode_status")))  # one row each


@query("homogenous_columns", "SELECT count(DISTINCT l_returnflag) <= 1 AS l_returnflag, count(DISTINCT l_linestatus) <= 1 AS l_linestatus FROM lineitem")
def homogenous_columns(spark, sf_dir):
    return A.is_homogenous(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("centroid", "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC) + " FROM (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in NUMERIC) + " FROM lineitem)")
def centroid(spark, sf_dir):
    return A.centroid(table(spark, sf_dir, "lineitem"), NUMERIC).select(*(F.round(c, 6).alias(c) for c in NUMERIC))


@query("unbiased_ranges", union(
    f"""SELECT '{c}' AS name, round(min({c}) - 0.5 * ((max({c}) - min({c})) * (count(*) + 1) / (count(*) - 1) - (max({c}) - min({c}))), 6) AS low,
    round(max({c}) - min({c}) + 0.5 * ((max({c}) - min({c})) * (count(*) + 1) / (count(*) - 1) - (max({c}) - min({c}))), 6) AS width FROM lineitem""" for c in NUMERIC))
def unbiased_ranges(spark, sf_dir):
    return A.ranges(table(spark, sf_dir, "lineitem"), NUMERIC, unbiased=True).select("name", F.round("low", 6).alias("low"), F.round("width", 6).alias("width"))


@query("covariance_matrix", union(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 3) AS cov, round(covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})), 5) AS corr FROM lineitem"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]))
def covariance_matrix(spark, sf_dir):
    return A.covariances(table(spark, sf_dir, "lineitem"), NUMERIC, 9).select("a", "b", F.round("cov", 3).alias("cov"), F.round("corr", 5).alias("corr"))


@query("origin_correlation", "SELECT round(sum(l_quantity * l_tax) / sqrt(sum(l_quantity * l_quantity)) / sqrt(sum(l_tax * l_tax)), 6) AS corr FROM lineitem")
def origin_correlation(spark, sf_dir):
    return A.origin_correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax").select(F.round("corr", 6).alias("corr"))


@query("t_test_pooled", "SELECT round(abs(avg(l_discount) - avg(l_tax)) / sqrt((var_samp(l_discount) + var_samp(l_tax)) / count(*)), 4) AS t, 2 * count(*) - 2 AS v FROM lineitem")
def t_test_pooled(spark, sf_dir):
    return A.t_test_pooled(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax").select(F.round("t", 4).alias("t"), "v")


@query("wilcoxon", """WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem), r AS (SELECT d, abs(d) AS m FROM d),
c AS (SELECT m, count(*) AS n, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down FROM r GROUP BY m),
t AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (ORDER BY m) AS g FROM (SELECT *, coalesce(m - lag(m) OVER (ORDER BY m) > 1e-9, true) AS new FROM c)),
g AS (SELECT g, sum(n) AS n, sum(up) AS up, sum(down) AS down FROM t GROUP BY g), k AS (SELECT *, sum(n) OVER (ORDER BY g) - (n - 1) / 2.0 AS rank FROM g)
SELECT sum(n)::BIGINT AS n, least(sum(rank * (up + (n - up - down) / 2.0)), sum(rank * (down + (n - up - down) / 2.0)))::DOUBLE AS w FROM k""")
def wilcoxon(spark, sf_dir):
    return A.wilcoxon(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", 1e-9)


@query("sign_shares", "SELECT round(avg((l_discount < l_tax)::INT), 6) AS less, round(avg((l_discount = l_tax)::INT), 6) AS same, round(avg((l_discount > l_tax)::INT), 6) AS more FROM lineitem")
def sign_shares(spark, sf_dir):
    return A.sign_shares(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax").select(*(F.round(c, 6).alias(c) for c in ("less", "same", "more")))


@query("histogram", """WITH b AS (SELECT range AS bin FROM range(20)), h AS (SELECT floor(l_quantity * 20 / 60.0)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 60 GROUP BY 1)
SELECT b.bin, ((b.bin + 0.5) * 3.0)::DOUBLE AS middle, coalesce(n, 0)::DOUBLE AS n, round(coalesce(n, 0) / 3.0 / (SELECT count(l_quantity) FROM lineitem), 6) AS density FROM b LEFT JOIN h ON b.bin = h.bin""")
def histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 60.0, 20).withColumn("density", F.round("density", 6))


@query("weighted_histogram", """SELECT floor((value - 0) * 10 / 100.0)::BIGINT AS bin, round(sum(value), 3) AS n FROM events WHERE value >= 0 AND value < 100 GROUP BY 1""")
def weighted_histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "value", 0.0, 100.0, 10, "value").where("n > 0").select("bin", F.round("n", 3).alias("n"))


@query("autocorrelation", """WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events),
p AS (""" + union(f"SELECT user_id, {k} AS lag, d * lead(d, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM d" for k in range(1, 6)) + ") SELECT user_id, lag, round(avg(p), 6) AS value FROM p WHERE p IS NOT NULL GROUP BY 1, 2")
def autocorrelation(spark, sf_dir):
    return A.autocorrelation(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5).withColumn("value", F.round("value", 6))


@query("zipped_errors", "SELECT round(avg((l_discount - l_tax) * (l_discount - l_tax)), 9) AS mse_l_discount, round(avg((l_quantity - l_linenumber) * (l_quantity - l_linenumber)), 6) AS mse_l_quantity FROM lineitem")
def zipped_errors(spark, sf_dir):
    return A.mean_squared_errors(table(spark, sf_dir, "lineitem"), [("l_discount", "l_tax"), ("l_quantity", "l_linenumber")]).select(F.round("mse_l_discount", 9).alias("mse_l_discount"), F.round("mse_l_quantity", 6).alias("mse_l_quantity"))
