"""Queries of sequences, graphs, matrices, transforms and models, whose SQL goes step by step (recursion, or one table for each round)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions.vectors import total
from seqloom.operators import aggregate, clusters, features, graphs, matrix, models, neighbors, sequences
from seqloom.plans.catalog import query
from seqloom.plans.learning import _COO, _MODEL, _coo, _symbols, _tracks
from seqloom.session import table

_EVENTS = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query("kalman_estimates", f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT user_id, event_id, k, value AS x, 25.0::DOUBLE AS p FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.event_id, e.k, f.x + (f.p + 1) / (f.p + 26) * (e.value - f.x), (1 - (f.p + 1) / (f.p + 26)) * (f.p + 1) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, round(x, 6) AS estimate, round(p, 6) AS variance FROM f""")
def kalman_estimates(spark, sf_dir):
    from seqloom.streaming.segments import kalman

    df = kalman(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 1.0, 25.0)
    return df.select("user_id", "event_id", F.round("estimate", 6).alias("estimate"), F.round("variance", 6).alias("variance"))


_SYMBOL = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END"
_B = "([0.5, 0.3, 0.2]::DOUBLE[])", "([0.2, 0.3, 0.5]::DOUBLE[])"


@query("hmm_paths", f"""WITH RECURSIVE e AS (SELECT user_id, {_SYMBOL} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, k, n, 0.6 * {_B[0]}[s] / (0.6 * {_B[0]}[s] + 0.4 * {_B[1]}[s]) AS a0, 0.4 * {_B[1]}[s] / (0.6 * {_B[0]}[s] + 0.4 * {_B[1]}[s]) AS a1, ln(0.6 * {_B[0]}[s] + 0.4 * {_B[1]}[s]) AS ll,
  ln(0.6) + ln({_B[0]}[s]) AS d0, ln(0.4) + ln({_B[1]}[s]) AS d1, '0' AS p0, '1' AS p1 FROM e WHERE k = 1 UNION ALL
SELECT user_id, k, n, b0 / (b0 + b1), b1 / (b0 + b1), ll + ln(b0 + b1), greatest(d0 + ln(0.7), d1 + ln(0.4)) + ln(e0), greatest(d0 + ln(0.3), d1 + ln(0.6)) + ln(e1),
  CASE WHEN d0 + ln(0.7) >= d1 + ln(0.4) THEN p0 ELSE p1 END || '0', CASE WHEN d0 + ln(0.3) >= d1 + ln(0.6) THEN p0 ELSE p1 END || '1'
FROM (SELECT f.user_id, e.k, f.n, (a0 * 0.7 + a1 * 0.4) * {_B[0]}[s] AS b0, (a0 * 0.3 + a1 * 0.6) * {_B[1]}[s] AS b1, ll, d0, d1, p0, p1, {_B[0]}[s] AS e0, {_B[1]}[s] AS e1 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
SELECT user_id, round(ll, 6) AS log_likelihood, CASE WHEN d0 >= d1 THEN p0 ELSE p1 END AS path FROM f WHERE k = n""")
def hmm_paths(spark, sf_dir):
    m = sequences.HiddenMarkovModel(*_MODEL)
    return _symbols(spark, sf_dir).select("user_id", F.round(m.score(F.col("symbols")), 6).alias("log_likelihood"), F.array_join(m.decode(F.col("symbols")).cast("array<string>"), "").alias("path"))


@query("hmm_one_pass", """WITH p AS (SELECT a, b, c, [0.4, 0.6][a + 1] * [0.5, 0.7][a + 1] * (CASE WHEN a = b THEN 0.4 ELSE 0.6 END) * [0.5, 0.3][b + 1] * (CASE WHEN b = c THEN 0.4 ELSE 0.6 END) * [0.5, 0.7][c + 1] AS w FROM range(2) x(a), range(2) y(b), range(2) z(c)),
v AS (SELECT 'initial' AS part, a AS i, 0 AS g, w FROM p UNION ALL SELECT 'transition', 2 * a + b, a, w FROM p UNION ALL SELECT 'transition', 2 * b + c, b, w FROM p UNION ALL
  SELECT 'emission', 2 * a + 1, a, w FROM p UNION ALL SELECT 'emission', 2 * b, b, w FROM p UNION ALL SELECT 'emission', 2 * c + 1, c, w FROM p),
n AS (SELECT part, i::INT AS i, g, sum(w)::DOUBLE AS w FROM v GROUP BY ALL) SELECT part, i, round(w / sum(w) OVER (PARTITION BY part, g), 10) AS value FROM n""")
def hmm_one_pass(spark, sf_dir):
    """One pass of training on the observations 1 0 1, against all paths of states."""
    m = sequences.HiddenMarkovModel([0.4, 0.6], [[0.4, 0.6], [0.6, 0.4]], [[0.5, 0.5], [0.3, 0.7]]).trained(spark.createDataFrame([([1, 0, 1],)], "s array<int>"), "s", passes=1)
    rows = [(name, i, round(float(x), 10)) for name, a in (("initial", m.initial), ("transition", m.transition), ("emission", m.emission)) for i, x in enumerate(a.ravel())]
    return spark.createDataFrame(rows, "part string, i int, value double")


@query("thinned_points", """WITH RECURSIVE e AS (SELECT user_id AS seq_id, value AS v, hour(ts) + 1.0::DOUBLE AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT seq_id, k, v, h, 1 AS kept FROM e WHERE k = 1 UNION ALL
SELECT f.seq_id, e.k, CASE WHEN greatest(abs(f.v - e.v), abs(f.h - e.h)) >= 2 THEN e.v ELSE f.v END, CASE WHEN greatest(abs(f.v - e.v), abs(f.h - e.h)) >= 2 THEN e.h ELSE f.h END, (greatest(abs(f.v - e.v), abs(f.h - e.h)) >= 2)::INT FROM f JOIN e ON e.seq_id = f.seq_id AND e.k = f.k + 1),
p AS (SELECT seq_id, list(v + h ORDER BY k) AS points FROM f WHERE kept = 1 GROUP BY 1)
SELECT seq_id, len(points)::INT AS n, round(list_sum(list_transform(range(0, 5), lambda i: (i + 1) * points[(i * len(points)) // 5 + 1])), 4) AS five FROM p""")
def thinned_points(spark, sf_dir):
    p = sequences.thinned(F.col("points"), 2.0)
    five = total(F.transform(sequences.resampled_sequence(p, 5), lambda x, i: (F.get(x, 0) + F.get(x, 1)) * (i + 1)))
    return _tracks(spark, sf_dir).select("seq_id", F.size(p).alias("n"), F.round(five, 4).alias("five"))


@query("prefix_similarities", """WITH e AS (SELECT user_id AS seq_id, value AS v, hour(ts) + 1.0::DOUBLE AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT a.seq_id, (a.v * b.v + a.h * b.h + 9) / sqrt(a.v ^ 2 + a.h ^ 2 + 9) / sqrt(b.v ^ 2 + b.h ^ 2 + 9) AS c FROM e a JOIN e b ON a.k = b.k AND b.seq_id = (SELECT min(user_id) FROM events))
SELECT seq_id, round(sum(c), 5) AS l1, round(sqrt(sum(c * c)), 5) AS l2 FROM c GROUP BY 1""")
def prefix_similarities(spark, sf_dir):
    df = _tracks(spark, sf_dir)
    first = df.agg(F.min_by("points", "seq_id").alias("first"))
    df = df.crossJoin(F.broadcast(first))  # one row
    return df.select("seq_id", F.round(sequences.common_prefix_l1(F.col("points"), F.col("first")), 5).alias("l1"), F.round(sequences.common_prefix_l2(F.col("points"), F.col("first")), 5).alias("l2"))


def _mixture_sql(rounds: int) -> str:
    parts = ["WITH m0 AS (SELECT 0.5::DOUBLE AS w1, quantile_disc(value, 0.25) AS m1, var_pop(value) AS v1, 0.5::DOUBLE AS w2, quantile_disc(value, 0.75) AS m2, var_pop(value) AS v2 FROM events)"]
    dens = lambda i: f"w{i} * exp(-(value - m{i}) * (value - m{i}) / (2 * v{i})) / sqrt(v{i})"
    for r in range(rounds):
        parts.append(f"s{r} AS MATERIALIZED (SELECT value AS x, {dens(1)} / ({dens(1)} + {dens(2)}) AS p FROM events, m{r})")
        mean, mean2 = "sum(p * x) / sum(p)", "sum((1 - p) * x) / sum(1 - p)"
        parts.append(f"m{r + 1} AS MATERIALIZED (SELECT sum(p) / count(*) AS w1, {mean} AS m1, greatest(1e-6, sum(p * x * x) / sum(p) - ({mean}) ^ 2) AS v1, sum(1 - p) / count(*) AS w2, {mean2} AS m2, greatest(1e-6, sum((1 - p) * x * x) / sum(1 - p) - ({mean2}) ^ 2) AS v2 FROM s{r})")
    return ", ".join(parts) + f" SELECT i, round(w, 5) AS weight, round(m, 4) AS mean, round(v, 3) AS variance FROM (SELECT CASE WHEN m1 <= m2 THEN 0 ELSE 1 END AS i, w1 AS w, m1 AS m, v1 AS v FROM m{rounds} UNION ALL SELECT CASE WHEN m1 <= m2 THEN 1 ELSE 0 END, w2, m2, v2 FROM m{rounds})"


@query("mixture_rounds", _mixture_sql(10))
def mixture_rounds(spark, sf_dir):
    parts = clusters.gaussian_mixture(table(spark, sf_dir, "events"), "value", 2, rounds=10)
    return spark.createDataFrame([(i, round(w, 5), round(m, 4), round(v, 3)) for i, (w, m, v) in enumerate(parts)], "i int, weight double, mean double, variance double")


_SUPPLY = "e AS (SELECT l_suppkey AS a, 1000000000 + l_partkey AS b, min(l_discount) AS c FROM lineitem GROUP BY 1, 2), g AS (SELECT a AS src, b AS dst, c FROM e UNION ALL SELECT b, a, c FROM e)"


def _supply(spark, sf_dir):
    """The graph of suppliers and the parts they ship, which grows with the table."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).agg(F.min("l_discount").cast("double").alias("cost"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))


def _paths_sql(rounds: int) -> str:
    parts = [f"WITH {_SUPPLY}, d0 AS (SELECT 1::BIGINT AS node, 0.0::DOUBLE AS cost)"]
    for r in range(rounds):
        parts.append(f"d{r + 1} AS MATERIALIZED (SELECT node, min(cost) AS cost FROM (SELECT node, cost FROM d{r} UNION ALL SELECT dst, cost + c FROM d{r} JOIN g ON node = src) GROUP BY 1)")
    return ", ".join(parts) + f" SELECT node, round(cost, 6) AS cost FROM d{rounds}"


@query("supply_paths", _paths_sql(16))
def supply_paths(spark, sf_dir):
    return graphs.shortest_paths(_supply(spark, sf_dir), 1).select("node", F.round("cost", 6).alias("cost"))


def _spread_sql(rounds: int) -> str:
    parts = [f"WITH {_SUPPLY.replace('min(l_discount) AS c FROM lineitem', 'min(l_discount) AS c FROM lineitem WHERE l_partkey % 5 = l_suppkey % 5')}, d0 AS (SELECT DISTINCT src AS node, src AS c FROM g)"]
    for r in range(rounds):
        parts.append(f"d{r + 1} AS MATERIALIZED (SELECT node, min(c) AS c FROM (SELECT node, c FROM d{r} UNION ALL SELECT g.dst, d{r}.c FROM d{r} JOIN g ON node = src) GROUP BY 1)")
    return ", ".join(parts) + f" SELECT node, c AS component FROM d{rounds}"


@query("supply_components", _spread_sql(16))
def supply_components(spark, sf_dir):
    """Of parts and suppliers whose numbers end alike, which fall into several components."""
    return graphs.components(_supply(spark, sf_dir).where("pmod(src - 1000000000 * int(src > 1000000000), 5) = pmod(dst - 1000000000 * int(dst > 1000000000), 5)"))


@query("edge_betweenness", "SELECT * FROM (VALUES (0, 1, 1.0::DOUBLE), (0, 2, 4.0), (1, 2, 4.0), (2, 3, 9.0), (3, 4, 4.0), (3, 5, 4.0), (4, 5, 1.0)) t(a, b, score)")
def edge_betweenness(spark, sf_dir):
    _, edges = graphs.betweenness(6, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)])
    return spark.createDataFrame([(a, b, round(s, 9)) for (a, b), s in edges.items()], "a int, b int, score double")


_NET = [(0, 1, 3.0), (0, 2, 2.0), (1, 2, 1.0), (1, 3, 3.0), (2, 4, 4.0), (3, 5, 2.0), (4, 5, 3.0), (3, 4, 1.0)]
_NET_SQL = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c}::DOUBLE)" for a, b, c in _NET) + ") t(a, b, c)), g AS (SELECT a, b, c FROM e UNION ALL SELECT b, a, c FROM e)"


@query("all_paths", "WITH RECURSIVE " + _NET_SQL + ", p AS (SELECT a, b, c, [a, b] AS seen FROM g UNION ALL SELECT p.a, g.b, p.c + g.c, list_append(seen, g.b) FROM p JOIN g ON g.a = p.b WHERE NOT list_contains(seen, g.b)), m AS (SELECT a, b, min(c) AS cost FROM p GROUP BY 1, 2) SELECT a, b, cost, cost AS one_origin FROM m")
def all_paths(spark, sf_dir):
    cost = np.full((6, 6), np.inf)
    for a, b, c in _NET:
        cost[a, b] = cost[b, a] = c
    every, _ = graphs.all_pairs(cost)
    one = [graphs.dijkstra(6, [*_NET, *((b, a, c) for a, b, c in _NET)], s)[0] for s in range(6)]
    return spark.createDataFrame([(a, b, float(every[a, b]), float(one[a][b])) for a in range(6) for b in range(6) if a != b], "a int, b int, cost double, one_origin double")


@query("smallest_cut", "WITH " + _NET_SQL + ", s AS (SELECT i FROM range(64) t(i) WHERE i & 1 = 1 AND i & 32 = 0), w AS (SELECT i, sum(c) AS cut FROM s JOIN e ON (i >> a) & 1 <> (i >> b) & 1 GROUP BY 1) SELECT min(cut) AS cut FROM w")
def smallest_cut(spark, sf_dir):
    return spark.createDataFrame([(float(graphs.min_cut(6, _NET, 0, 5)[0]),)], "cut double")


@query("graph_cycles", "SELECT * FROM (VALUES ('0-1-2'), ('1-2-4-3'), ('3-4-5')) t(cycle)")
def graph_cycles(spark, sf_dir):
    """Cycles without chords."""
    found = graphs.atomic_cycles(6, [e[:2] for e in _NET])
    return spark.createDataFrame([("-".join(map(str, c if c[1] < c[-1] else (c[0], *c[:0:-1]))),) for c in found], "cycle string")


_XYZ = ["l_quantity / 10", "l_discount * 10", "l_tax * 10"]
_C = "WITH t AS (SELECT l_quantity / 10 AS x, l_discount * 10 AS y, l_tax * 10 AS z FROM lineitem), c AS (SELECT covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, covar_pop(y, y) AS d, covar_pop(y, z) AS e, covar_pop(z, z) AS f, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM t), q AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM c)"


def _xyz(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(e).cast("double").alias(c) for e, c in zip(_XYZ, "xyz", strict=True)))


@query("small_matrix", _C + """ SELECT name, round(v, 5) AS value FROM q, LATERAL (VALUES ('det', det), ('inverse00', (d * f - e * e) / det), ('inverse01', (c * e - b * f) / det), ('inverse22', (a * d - b * b) / det), ('pseudo00', (d * f - e * e) / det),
('cholesky00', sqrt(a)), ('cholesky10', b / sqrt(a)), ('cholesky11', sqrt(d - b * b / a)), ('cholesky22', sqrt(det / (a * d - b * b))), ('solved0', ((d * f - e * e) * mx + (c * e - b * f) * my + (b * e - c * d) * mz) / det),
('echelon0', ((d * f - e * e) * mx + (c * e - b * f) * my + (b * e - c * d) * mz) / det), ('rank', 3.0), ('values', a + d + f), ('squares', a * a + d * d + f * f + 2 * (b * b + c * c + e * e)), ('product', det)) l(name, v)""")
def small_matrix(spark, sf_dir):
    mean, cov, _ = matrix.moments(_xyz(spark, sf_dir), ["x", "y", "z"])
    inverse, low = matrix.inverse(cov), matrix.cholesky(cov)
    echelon, rank = matrix.reduced_row_echelon(np.column_stack([cov, mean]))
    w, _ = matrix.eigen(cov, 3)
    rows = {
        "det": matrix.determinant(cov), "inverse00": inverse[0, 0], "inverse01": inverse[0, 1], "inverse22": inverse[2, 2], "pseudo00": matrix.pseudo_inverse(cov)[0, 0], "cholesky00": low[0, 0], "cholesky10": low[1, 0],
        "cholesky11": low[1, 1], "cholesky22": low[2, 2], "solved0": matrix.solve(cov, mean)[0], "echelon0": echelon[0, 3], "rank": rank, "values": w.sum(), "squares": (w * w).sum(), "product": w.prod(),
    }
    return spark.createDataFrame([(k, round(float(v), 5)) for k, v in rows.items()], "name string, value double")


@query("singular_moments", _COO + ', s AS (SELECT a."row" AS i, b."row" AS j, sum(a.val * b.val) AS v FROM m a JOIN m b ON a."col" = b."col" GROUP BY 1, 2) SELECT round((SELECT sum(val * val) FROM m), 0) AS squares, round(sqrt(sum(v * v)), 0) AS fourths FROM s')
def singular_moments(spark, sf_dir):
    _, s, _ = matrix.svd(matrix.dense(_coo(spark, sf_dir)))
    return spark.createDataFrame([(round(float((s**2).sum()), 0), round(float(np.sqrt((s**4).sum())), 0))], "squares double, fourths double")


@query("matrix_forms", _COO + """SELECT 'subtracted' AS name, "row", "col", val - 2 AS val FROM m WHERE "row" = "col" UNION ALL SELECT 'scaled', "row", "col", val * 3 FROM m UNION ALL SELECT 'mirrored', "row", "col", val FROM m WHERE "row" <= "col" UNION ALL
SELECT 'mirrored', "col", "row", val FROM m WHERE "row" < "col" UNION ALL SELECT 'swapped', CASE "row" WHEN 3 THEN 7 WHEN 7 THEN 3 ELSE "row" END, "col", val FROM m UNION ALL SELECT 'set', 2, 5, 99.0::DOUBLE UNION ALL SELECT 'got', 4, 4, val FROM m WHERE "row" = 4 AND "col" = 4 UNION ALL
SELECT 'identity', 0, 0, sum((coalesce(val, 0) - (i = j)::INT) ^ 2) FROM (SELECT i, j, val FROM range(50) a(i) CROSS JOIN range(50) b(j) LEFT JOIN m ON m."row" = i AND m."col" = j) UNION ALL SELECT 'dense', "row", 0, sum(val * ("col" + 1)) FROM m GROUP BY "row" """)
def matrix_forms(spark, sf_dir):
    m = _coo(spark, sf_dir)
    two = matrix.scale(matrix.identity(spark, 50), 2.0)
    diagonal = m.where(F.col("row") == F.col("col"))
    forms = {
        "subtracted": matrix.subtract(diagonal, two.join(diagonal.select("row"), "row", "left_semi")), "scaled": matrix.scale(m, 3.0), "mirrored": matrix.mirrored(m), "swapped": matrix.swapped(m, "row", 3, 7),
        "set": matrix.with_element(m, 2, 5, 99.0).where((F.col("row") == 2) & (F.col("col") == 5)), "got": spark.createDataFrame([(4, 4, matrix.element(m, 4, 4))], "row int, col int, val double").where("val <> 0"),
        "identity": matrix.squared_difference_with_identity(m, 50).select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("norm2").alias("val")),
        "dense": matrix.dense_rows(m, 40).select("row", F.lit(0).alias("col"), total(F.transform("vec", lambda x, i: x * (i + 1))).alias("val")),
    }
    out = None
    for name, df in forms.items():
        df = df.select(F.lit(name).alias("name"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "val")
        out = df if out is None else out.unionByName(df)
    return out


@query("centred_columns", "SELECT l_orderkey, l_linenumber, round(l_quantity / 10 - avg(l_quantity / 10) OVER (), 6) AS x, round(l_quantity / 10, 6) AS restored, round(l_quantity / 10 - 0.1, 6) AS from_row FROM lineitem")
def centred_columns(spark, sf_dir):
    """Centred on the mean, restored from all principal components, and centred on a row whose quantity is 1."""
    df, cols = _xyz(spark, sf_dir), ["x", "y", "z"]
    mean, basis, _ = matrix.principal_components(df, cols, 3)
    back = matrix.restored(matrix.projected(df, cols, mean, basis).withColumn("own", F.col("x")), cols, mean, basis)
    moved = matrix.centred_on_row(back.withColumns({"moved": F.col("own"), "at": F.round(F.col("own") * 10)}), ["moved"], "at", 1)
    out = matrix.centred(moved.withColumn("c", F.col("own")), ["c"])
    return out.select("l_orderkey", "l_linenumber", F.round("c", 6).alias("x"), F.round("x", 6).alias("restored"), F.round("moved", 6).alias("from_row"))


@query("aligned_points", "SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS x, round(embedding[2]::DOUBLE, 5) AS y, round(embedding[1]::DOUBLE, 5) AS blended FROM embeddings")
def aligned_points(spark, sf_dir):
    """Points turned and moved come back onto the first ones."""
    a = [F.get("embedding", i).cast("double") for i in range(3)]
    c, s = float(np.cos(1.1)), float(np.sin(1.1))
    df = table(spark, sf_dir, "embeddings").select("vec_id", *(x.alias(f"a{i}") for i, x in enumerate(a)), (a[0] * c - a[2] * s + 4).alias("b0"), (a[1] - 1).alias("b1"), (a[0] * s + a[2] * c).alias("b2"))
    first, second = ["a0", "a1", "a2"], ["b0", "b1", "b2"]
    out = matrix.aligned(df, first, second).join(matrix.blended(df, first, second, 0.25).select("vec_id", F.col("a0").alias("blended")), "vec_id")
    return out.select("vec_id", F.round("b0", 5).alias("x"), F.round("b1", 5).alias("y"), F.round("blended", 5).alias("blended"))


@query("transforms_undone", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) - min(l_extendedprice) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round((greatest(0, least(9, floor((l_extendedprice - lo) * 10 / w))) + 0.5) * w / 10 + lo, 4) AS l_extendedprice, l_returnflag, l_linestatus FROM lineitem, s""")
def transforms_undone(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    for kind in (features.Normalize.fit(df, ["l_quantity"], -1.0, 1.0), features.Discretize.fit(df, ["l_extendedprice"], 10), features.OneHot.fit(df, ["l_returnflag", "l_linestatus"])):
        df = kind.undo(kind.apply(df))
    return df.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"), "l_returnflag", "l_linestatus")


@query("naive_bayes_table", """WITH p AS (SELECT l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT l_returnflag AS y, l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag AS y, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT (SELECT count(DISTINCT l_linestatus) FROM lineitem) AS ka, (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS kb), c AS (SELECT DISTINCT l_linestatus AS s, l_linenumber AS i FROM lineitem),
s AS (SELECT c.s, c.i, p.y, ln(p.n) + ln((coalesce(a.n, 0) + 0.2 / ka) / (0.2 + p.n)) + ln((coalesce(b.n, 0) + 0.2 / kb) / (0.2 + p.n)) AS score FROM c CROSS JOIN p CROSS JOIN k LEFT JOIN a ON a.y = p.y AND a.v = c.s LEFT JOIN b ON b.y = p.y AND b.v = c.i),
r AS (SELECT *, row_number() OVER (PARTITION BY s, i ORDER BY score DESC, y) AS r FROM s)
SELECT l_orderkey, l_linenumber, y AS prediction FROM lineitem JOIN r ON r.s = l_linestatus AND r.i = l_linenumber AND r = 1""")
def naive_bayes_table(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return models.NaiveBayes().fit(df, ["l_linestatus", "l_linenumber"], "l_returnflag").predict(df).select("l_orderkey", "l_linenumber", "prediction")


@query("normal_classes", """WITH s AS (SELECT l_returnflag AS y, count(*) AS n, avg(l_quantity) AS mq, var_pop(l_quantity) AS vq, avg(l_discount) AS md, var_pop(l_discount) AS vd FROM lineitem GROUP BY 1),
l AS (SELECT *, row_number() OVER () AS id FROM lineitem), p AS (SELECT id, l_orderkey, l_linenumber, y, ln(n) - 0.5 * (l_quantity - mq) ^ 2 / vq - 0.5 * ln(vq) - 0.5 * (l_discount - md) ^ 2 / vd - 0.5 * ln(vd) AS score FROM l, s),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, y) AS r FROM p) SELECT l_orderkey, l_linenumber, y AS prediction FROM r WHERE r = 1""")
def normal_classes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    return models.MixtureByClass().fit(df, ["q", "d"], "l_returnflag").predict(df).select("l_orderkey", "l_linenumber", "prediction")


@query("fitted_line", "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, avg(l_extendedprice) AS m FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_quantity * s + i, 2) AS prediction, round(m, 2) AS baseline FROM lineitem, f")
def fitted_line(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("y"))
    line = models.linear_regression().fit(df, ["q"], "y").predict(df)
    mean = models.Baseline(nominal=False).fit(df, ["q"], "y").value
    return line.select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"), F.round(F.lit(float(mean)), 2).alias("baseline"))


@query("lloyd_step", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), c AS (SELECT vec_id AS k, a AS c FROM v WHERE vec_id < 4),
d AS (SELECT vec_id, a, k, list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - c[i]) * (a[i] - c[i]))) AS d2 FROM v, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, k) AS r FROM d)
SELECT k::INT AS cluster, count(*) AS n, round(sum(d2), 4) AS distortion, round(avg(a[1]), 6) AS first, round(avg(a[20]), 6) AS twentieth FROM r WHERE r = 1 GROUP BY 1""")
def lloyd_step(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    start = [list(map(float, r.embedding)) for r in df.where("vec_id < 4").orderBy("vec_id").collect()]
    moved, _ = clusters._step(df, "embedding", start)
    own = clusters.assigned(df, "embedding", start).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 4).alias("distortion"))
    place = spark.createDataFrame([(i, round(m[0], 6), round(m[19], 6)) for i, m in enumerate(moved)], "cluster int, first double, twentieth double")
    return own.join(place, "cluster")


@query("learned_values", """WITH q AS (SELECT user_id % 5 AS state, event_type AS action, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT user_id % 5 AS state, event_type AS action, value AS reward, (user_id + 1) % 5 AS nxt FROM events), b AS (SELECT state AS nxt, greatest(0, max(v)) AS best FROM q GROUP BY 1),
t AS (SELECT s.state, s.action, avg(reward + 0.9 * coalesce(best, 0)) AS target FROM s LEFT JOIN b USING (nxt) GROUP BY 1, 2) SELECT q.state, q.action, round(0.7 * v + 0.3 * target, 6) AS value FROM q JOIN t ON q.state = t.state AND q.action = t.action""")
def learned_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("state"), F.col("event_type").alias("action"), F.col("value").alias("reward"), ((F.col("user_id") + 1) % 5).alias("next_state"))
    q = e.groupBy("state", "action").agg(F.avg("reward").alias("value"))
    return models.q_step(q, e, 0.3, 0.9).withColumn("value", F.round("value", 6))


@query("spread_labels", """WITH RECURSIVE l AS (SELECT k AS node, (k // 100)::INT AS label FROM range(1000) t(k)) SELECT node, label FROM l""")
def spread_labels(spark, sf_dir):
    """Chains of a hundred nodes take the label of their one labelled node."""
    edges = spark.range(1000).where("id % 100 <> 99").select(F.col("id").alias("query"), (F.col("id") + 1).alias("neighbor"))
    edges = edges.unionByName(edges.select(F.col("neighbor").alias("query"), F.col("query").alias("neighbor")))
    labels = spark.range(10).select((F.col("id") * 100 + 50).alias("node"), F.col("id").cast("int").alias("label"))
    return models.label_spread(edges, labels, rounds=60)


@query("neighbor_means", """WITH p AS (SELECT q.vec_id AS query, e.vec_id AS neighbor, e.label, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE))) AS d2 FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbor) AS r FROM p) SELECT query, round(sum(label / sqrt(d2)) / sum(1 / sqrt(d2)), 6) AS weighted, round(avg(label), 6) AS plain FROM r WHERE r <= 4 GROUP BY 1""")
def neighbor_means(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    near = neighbors.nearest(df.where("vec_id % 20 = 0"), df, 4)
    labels = df.select(F.col("vec_id").alias("neighbor"), "label")
    a, b = (neighbors.interpolated(near, labels, "label", w).select("query", F.round("prediction", 6).alias(n)) for w, n in ((True, "weighted"), (False, "plain")))
    return a.join(b, "query")


@query("accuracies", "SELECT round(avg((l_returnflag = 'N')::INT), 9) AS score, round(avg((l_quantity - 25) ^ 2), 6) AS error FROM lineitem")
def accuracies(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    right = models.accuracy(df.withColumn("prediction", F.lit("N")), "l_returnflag")
    error = models.accuracy(df.withColumn("prediction", F.lit(25.0)), "l_quantity", nominal=False).withColumnRenamed("score", "error")
    return right.crossJoin(error).select(F.round("score", 9).alias("score"), F.round("error", 6).alias("error"))  # one row each


@query("sum_of_squares", "SELECT round(sum((l_quantity - m) ^ 2), 1) AS to_mean FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)")
def sum_of_squares(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double")).alias("v"))
    mean = df.agg(F.avg(F.get("v", 0))).first()[0]
    return clusters.distortion(df, "v", [[mean]]).select(F.round("distortion", 1).alias("to_mean"))


@query("histogram_range", "SELECT bin, n FROM (SELECT floor((l_quantity - lo) * 12 / w)::BIGINT AS bin, count(*)::DOUBLE AS n FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) - min(l_quantity) + 1 AS w FROM lineitem) GROUP BY 1)")
def histogram_range(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    low, high = df.agg(F.min("l_quantity"), F.max("l_quantity") + 1).first()
    return aggregate.histogram(df, "l_quantity", float(low), float(high), 12).where("n > 0").select("bin", "n")
