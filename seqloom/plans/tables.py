"""Queries of projection, filtering, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import formula, geometry, numeric, text
from seqloom.functions import vectors as V
from seqloom.operators import table as T
from seqloom.plans.catalog import query
from seqloom.session import table


def customers(spark, sf_dir):
    return T.with_order(table(spark, sf_dir, "customer"), "c_custkey")


_O = "(SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS _ord FROM customer)"


@query("row_order", f"SELECT c_custkey, _ord FROM {_O}")
def row_order(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", "_ord")


@query("add_index", f"SELECT (10.0 + _ord * 2.5)::DOUBLE AS index, c_custkey FROM {_O}")
def add_index(spark, sf_dir):
    return T.add_index(customers(spark, sf_dir).select("c_custkey", "_ord"), 10.0, 2.5).drop("_ord")


@query("column_list", "SELECT r_regionkey, r_name FROM region")
def column_list(spark, sf_dir):
    df = table(spark, sf_dir, "region").select("r_name", "r_regionkey")
    return T.drop_columns(T.swap_columns(df.withColumn("x", F.lit(1)), 0, 1), "2")


@query("first_rows", f"SELECT c_custkey FROM {_O} WHERE _ord < 25")
def first_rows(spark, sf_dir):
    return T.first_rows(customers(spark, sf_dir), 25).select("c_custkey")


@query("last_rows", f"SELECT c_custkey FROM {_O} WHERE _ord >= (SELECT count(*) - 7 FROM customer)")
def last_rows(spark, sf_dir):
    return T.last_rows(customers(spark, sf_dir), 7).select("c_custkey")


@query("delete_row", f"SELECT c_custkey, _ord - (CASE WHEN _ord > 3 THEN 1 ELSE 0 END) AS _ord FROM {_O} WHERE _ord <> 3")
def delete_row(spark, sf_dir):
    return T.delete_row(customers(spark, sf_dir), 3).select("c_custkey", "_ord")


@query("reverse_rows", f"SELECT c_custkey, (SELECT count(*) - 1 FROM customer) - _ord AS _ord FROM {_O}")
def reverse_rows(spark, sf_dir):
    return T.reverse(customers(spark, sf_dir)).select("c_custkey", "_ord")


@query("split_by_pivot", "SELECT l_quantity < 25 AS low, count(*) AS n FROM lineitem GROUP BY 1")
def split_by_pivot(spark, sf_dir):
    low, high = T.split_by_pivot(table(spark, sf_dir, "lineitem"), "l_quantity", 25)
    return low.agg(F.lit(True).alias("low"), F.count(F.lit(1)).alias("n")).unionByName(high.agg(F.lit(False).alias("low"), F.count(F.lit(1)).alias("n")))


@query("split_by_value", "SELECT l_returnflag = 'R' AS same, count(*) AS n FROM lineitem GROUP BY 1")
def split_by_value(spark, sf_dir):
    a, b = T.split_by_value(table(spark, sf_dir, "lineitem"), "l_returnflag", "R")
    return a.agg(F.lit(True).alias("same"), F.count(F.lit(1)).alias("n")).unionByName(b.agg(F.lit(False).alias("same"), F.count(F.lit(1)).alias("n")))


_GAPS = "(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)"


def gaps(spark, sf_dir):
    return customers(spark, sf_dir).select("_ord", "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"))


@query("drop_missing", f"SELECT * FROM {_GAPS} WHERE bal IS NOT NULL")
def drop_missing(spark, sf_dir):
    return T.drop_missing(gaps(spark, sf_dir).drop("_ord"))


@query("sort_missing_first", f"SELECT c_custkey, bal, row_number() OVER (ORDER BY bal NULLS FIRST, c_custkey) - 1 AS _ord FROM {_GAPS}")
def sort_missing_first(spark, sf_dir):
    return T.with_order(gaps(spark, sf_dir).drop("_ord"), "bal", "c_custkey")


@query("replace_missing")
def replace_missing(spark, sf_dir):
    return T.replace_missing(gaps(spark, sf_dir), ["bal"], seed=4)


@query("shuffle_rows")
def shuffle_rows(spark, sf_dir):
    return T.shuffle(customers(spark, sf_dir), 5).select("c_custkey", "_ord")


@query("zip_join", f"SELECT a.c_custkey, b.o_orderkey, a._ord FROM {_O} a JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS _ord FROM orders) b ON a._ord = b._ord")
def zip_join(spark, sf_dir):
    a = customers(spark, sf_dir).select("_ord", "c_custkey")
    n = a.count()
    b = T.first_rows(T.with_order(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), n)
    return T.zip_join(a, b).select("c_custkey", "o_orderkey", "_ord")


@query("append_tables", "SELECT s_suppkey AS key FROM supplier UNION ALL SELECT c_custkey FROM customer")
def append_tables(spark, sf_dir):
    return T.append(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), table(spark, sf_dir, "customer").select("c_custkey"))


@query("line_diff", """SELECT 'a' AS side, k AS key FROM (SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier) UNION ALL
SELECT 'b', k FROM (SELECT s_suppkey AS k FROM supplier EXCEPT ALL SELECT l_suppkey FROM lineitem) UNION ALL SELECT 'both', k FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT s_suppkey FROM supplier)""")
def line_diff(spark, sf_dir):
    return T.line_diff(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), "key")


@query("transitions", """SELECT * FROM (SELECT user_id, event_id, value, round(lead(value) OVER w - value, 6) AS next_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_value IS NOT NULL""")
def transitions(spark, sf_dir):
    out = T.transitions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], ["value"], delta=True)
    return out.select("user_id", "event_id", "value", F.round("next_value", 6).alias("next_value"))


@query("vector_functions", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS b FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])), 6) AS dot, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 5) AS l1,
round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i])))), 6) AS l2, round(list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 6) AS l_inf,
list_position(a, list_max(a)) - 1 AS argmax, list_position(a, list_min(a)) - 1 AS argmin FROM v""")
def vector_functions(spark, sf_dir):
    a = F.col("embedding").cast("array<double>")
    b = F.reverse("embedding").cast("array<double>")
    df = table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return df.select("vec_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.l1(a, b), 5).alias("l1"), F.round(V.l2(a, b), 6).alias("l2"), F.round(V.l_inf(a, b), 6).alias("l_inf"), V.index_of_max(a).alias("argmax"), V.index_of_min(a).alias("argmin"))


@query("formulas", "SELECT p_partkey, round(p_retailprice ^ 2 / 1000 - (3.2 + p_size * 2), 7) AS f, round(sqrt(abs(sin(p_size))) + pi(), 6) AS g FROM part")
def formulas(spark, sf_dir):
    own = formula.Formulas("h(x) = x ^ 2; f(price, size) = h(price) / 1000 - k - size * two; k = 3.2; two = 2; g(s) = sqrt(abs(sin(s))) + pi")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(own.call("f", F.col("p_retailprice"), F.col("p_size")), 7).alias("f"), F.round(own.call("g", F.col("p_size")), 6).alias("g"))


@query("activations", "SELECT event_id, round(1 / (1 + exp(-value / 50)), 6) AS logistic, round(tanh(value / 50), 6) AS tanh, round(value / 50 / sqrt(value / 50 * value / 50 + 1), 6) AS algebraic FROM events")
def activations(spark, sf_dir):
    x = F.col("value") / 50
    return table(spark, sf_dir, "events").select("event_id", *(F.round(numeric.ACTIVATIONS[k](x), 6).alias(k) for k in ("logistic", "tanh", "algebraic")))


@query("densities", "SELECT event_id, round(exp(-0.5 * (value - 20) * (value - 20) / 100) / sqrt(2 * pi() * 100), 9) AS normal, CASE WHEN value >= 10 AND value < 30 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS uniform FROM events")
def densities(spark, sf_dir):
    x = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(numeric.normal_density(x, 20.0, 100.0), 9).alias("normal"), numeric.uniform_density(x, 10.0, 30.0).alias("uniform"))


@query("special_functions")
def special_functions(spark, sf_dir):
    x = F.col("p_size") / 10
    return table(spark, sf_dir, "part").select("p_partkey", numeric.erf(x).alias("erf"), numeric.log_gamma(x).alias("log_gamma"), numeric.product_log(x).alias("product_log"))


@query("quaternions")
def quaternions(spark, sf_dir):
    axis = F.array(F.col("p_size").cast("double"), F.lit(1.0), F.lit(2.0))
    return table(spark, sf_dir, "part").select("p_partkey", geometry.rotated_about(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), axis, F.col("p_retailprice") / 100).alias("point"))


@query("date_parsing", """SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE AS b, o_orderdate::DATE AS c FROM orders""")
def date_parsing(spark, sf_dir):
    d = F.col("o_orderdate")
    forms = {"a": F.date_format(d, "dd MMM yyyy"), "b": F.date_format(d, "yyyy-M-d"), "c": F.date_format(d, "MM/dd/yyyy")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(text.parse_date(x).alias(k) for k, x in forms.items()))


@query("button_segments", """WITH m AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id) AS a FROM events)
SELECT user_id AS key, ((p + 1) // 2)::BIGINT AS segment, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM m WHERE event_type <> 'click' AND p % 2 = 1 AND a > p GROUP BY 1, 2""")
def button_segments(spark, sf_dir):
    from seqloom.streaming.segments import segments

    events = table(spark, sf_dir, "events").withColumn("button", F.col("event_type") == "click")
    return segments(events, "user_id", "ts", "event_id", "button", "value").withColumn("total", F.round("total", 4))


@query("kalman_filter")
def kalman_filter(spark, sf_dir):
    from seqloom.streaming.segments import kalman

    return kalman(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 1.0, 25.0)


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    from seqloom.streaming.segments import counts_in_windows

    return counts_in_windows(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "10 minutes")
