"""Queries of vector algebra, kernels, densities, special functions and geometry. An array is told by its elements times their numbers, summed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import geometry, kernels, numeric
from seqloom.functions import vectors as V
from seqloom.plans.catalog import query
from seqloom.session import table

_V = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS b FROM embeddings) "
_AT = "range(1, len(a) + 1)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.reverse("embedding").cast("array<double>").alias("b"))


def told(v: Column, digits: int = 4) -> Column:
    return F.round(V.total(F.transform(v, lambda x, i: x * (i + 1))), digits)


def _told(sql: str, digits: int = 4) -> str:
    return f"round(list_sum(list_transform({sql}, lambda y, k: y * k)), {digits})"


def _sum(of: str) -> str:
    return f"list_sum(list_transform({_AT}, lambda i: {of}))"


def _each(of: str) -> str:
    return f"list_transform({_AT}, lambda i: {of})"


def _row(values: dict[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(k) for k, c in values.items()]


_N2A, _N2B, _DOT, _D2 = _sum("a[i] * a[i]"), _sum("b[i] * b[i]"), _sum("a[i] * b[i]"), _sum("(a[i] - b[i]) * (a[i] - b[i])")


@query("vector_norms", _V + f"""SELECT vec_id, round(sqrt({_N2A}), 6) AS norm, round({_N2A}, 6) AS square, round({_sum('abs(a[i]) ^ 3')} ^ (1.0 / 3), 6) AS p3, round({_sum('abs(a[i] - b[i]) ^ 3')} ^ (1.0 / 3), 6) AS distance3,
round({_DOT} / sqrt({_N2A}) / sqrt({_N2B}), 6) AS cosine, round({_DOT} / sqrt({_N2A}) / sqrt({_N2B}), 6) AS correlation, round(1 / (1 + exp(sqrt({_D2}))), 6) AS sigmoid,
CASE WHEN vec_id % 9 = 0 THEN -0.5::DOUBLE ELSE round({_DOT} / sqrt({_N2A}) / sqrt({_N2B}), 6) END AS score, round(list_sum(a), 6) AS total, round({_D2}, 6) AS d2 FROM v""")
def vector_norms(spark, sf_dir):
    score = V.alignment_score(F.col("a"), F.when(F.col("vec_id") % 9 != 0, F.col("b")))
    return _vectors(spark, sf_dir).select("vec_id", *_row({
        "norm": V.magnitude(F.col("a")), "square": V.squared_magnitude(F.col("a")), "p3": V.p_magnitude(F.col("a"), 3), "distance3": V.p_distance(F.col("a"), F.col("b"), 3), "cosine": V.cosine(F.col("a"), F.col("b")), "correlation": V.correlation(F.col("a"), F.col("b")),
        "sigmoid": V.sigmoid_similarity(F.col("a"), F.col("b")), "score": score, "total": V.total(F.col("a")), "d2": V.squared_distance(F.col("a"), F.col("b")),
    }))


@query("vector_arithmetic", _V + f"""SELECT vec_id, {_told(_each('a[i] + b[i]'))} AS added, {_told(_each('a[i] - b[i]'))} AS subtracted, {_told(_each('a[i] + 2.5 * b[i]'))} AS added_scaled, {_told(_each('a[i] * b[i]'))} AS times,
{_told(_each('a[i] / (abs(b[i]) + 1)'))} AS divided, {_told(_each('a[i] + ln(abs(b[i]) + 1)'))} AS added_log, {_told(_each('a[i] * 3'))} AS scaled, {_told(_each('least(a[i], 0.1)'))} AS capped, {_told(_each('greatest(a[i], -0.1)'))} AS floored FROM v""")
def vector_arithmetic(spark, sf_dir):
    positive = F.transform(F.col("b"), lambda x: F.abs(x) + 1)
    return _vectors(spark, sf_dir).select("vec_id", *(told(v).alias(k) for k, v in {
        "added": V.add(F.col("a"), F.col("b")), "subtracted": V.subtract(F.col("a"), F.col("b")), "added_scaled": V.add_scaled(F.col("a"), 2.5, F.col("b")), "times": V.times(F.col("a"), F.col("b")), "divided": V.divide(F.col("a"), positive), "added_log": V.add_log(F.col("a"), positive),
        "scaled": V.scale(F.col("a"), 3.0), "capped": V.cap(F.col("a"), 0.1), "floored": V.floor(F.col("a"), -0.1),
    }.items()))


@query("vector_normals", _V + f"""SELECT vec_id, {_told(_each(f'a[i] / sqrt({_N2A})'))} AS unit, CASE WHEN vec_id % 5 = 0 THEN 1.0::DOUBLE ELSE {_told(_each(f'a[i] / sqrt({_N2A})'))} END AS safe,
{_told(_each('a[i] / ' + _sum('abs(a[i]) ^ 3') + ' ^ (1.0 / 3)'))} AS unit3, {_told(_each('abs(a[i]) / ' + _sum('abs(a[i])')))} AS share FROM v""")
def vector_normals(spark, sf_dir):
    safe = V.safe_normalized(F.when(F.col("vec_id") % 5 == 0, V.scale(F.col("a"), 0.0)).otherwise(F.col("a")))
    return _vectors(spark, sf_dir).select("vec_id", told(V.normalized(F.col("a"))).alias("unit"), told(safe).alias("safe"), told(V.p_normalized(F.col("a"), 3)).alias("unit3"), told(V.sum_to_one(F.transform(F.col("a"), F.abs))).alias("share"))


@query("vector_missing", _V + f""", m AS (SELECT *, list_transform({_AT}, lambda i: CASE WHEN (i + vec_id) % 5 = 0 OR vec_id % 50 = 7 THEN NULL ELSE a[i] END) AS m FROM v)
SELECT vec_id, vec_id % 50 = 7 OR len(a) > 0 AS missing, round(coalesce(list_sum(list_transform({_AT}, lambda i: (b[i] - m[i]) * a[i])), 0), 6) AS known_dot,
CASE WHEN vec_id % 50 = 7 THEN 1e50::DOUBLE ELSE round(list_sum(list_transform({_AT}, lambda i: (m[i] - b[i]) * (m[i] - b[i]))) * len(a) / len(list_filter(m, lambda x: x IS NOT NULL)), 6) END AS known_d2,
list_count(list_filter(a, lambda x: x IS NULL)) > 0 AS none FROM m""")
def vector_missing(spark, sf_dir):
    gaps = F.transform(F.col("a"), lambda x, i: F.when(((i + 1 + F.col("vec_id")) % 5 != 0) & (F.col("vec_id") % 50 != 7), x))
    df = _vectors(spark, sf_dir).withColumn("m", gaps)
    m = F.col("m")
    return df.select("vec_id", V.has_missing(m).alias("missing"), F.round(V.dot_known(m, F.col("b"), F.col("a")), 6).alias("known_dot"), F.when(F.col("vec_id") % 50 == 7, V.known_squared_distance(m, F.col("b"))).otherwise(F.round(V.known_squared_distance(m, F.col("b")), 6)).alias("known_d2"), V.has_missing(F.col("a")).alias("none"))


_ONE = "list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 3 THEN 0.6 WHEN i = 9 THEN 0.8 ELSE 0.0 END)"


@query("vector_places", _V + f""", d AS (SELECT *, list_transform(a, lambda x: abs(x)) AS m, sqrt({_D2}) AS d, 0.6 * a[3] + 0.8 * a[9] AS along FROM v)
SELECT vec_id, (list_position(m, list_max(m)) - 1)::INT AS biggest, {_told('list_slice(list_sort(a), 1, 3)')} AS least, (list_position(a, a[8]) - 1)::INT AS found, round(a[11] + 0.25 * (a[12] - a[11]), 6) AS between_,
{_told("list_transform(range(0, 10), lambda j: a[(j * (len(a) - 1) / 9.0)::DOUBLE.floor()::INT + 1] + (a[least(len(a), (j * (len(a) - 1) / 9.0)::DOUBLE.floor()::INT + 2)] - a[(j * (len(a) - 1) / 9.0)::DOUBLE.floor()::INT + 1]) * (j * (len(a) - 1) / 9.0 - floor(j * (len(a) - 1) / 9.0)))")} AS ten,
{_told(_each("CASE WHEN i = 1 THEN a[1] * cos(0.7) - a[2] * sin(0.7) WHEN i = 2 THEN a[1] * sin(0.7) + a[2] * cos(0.7) ELSE a[i] END"))} AS turned,
round(0.6 * (a[3] - b[3]) + 0.8 * (a[9] - b[9]), 6) AS projected, {_told(_each("a[i] - along * CASE WHEN i = 3 THEN 0.6 WHEN i = 9 THEN 0.8 ELSE 0.0 END"))} AS without_, {_told(_each("a[i] + 0.5 * (d - 1) / d * (b[i] - a[i])"))} AS moved FROM d""".replace("(j * (len(a) - 1) / 9.0)::DOUBLE.floor()::INT", "floor(j * (len(a) - 1) / 9.0)::INT"))
def vector_places(spark, sf_dir):
    axis = F.transform(F.col("a"), lambda x, i: F.when(i == 2, 0.6).when(i == 8, 0.8).otherwise(0.0))
    return _vectors(spark, sf_dir).select(
        "vec_id", V.index_of_max_magnitude(F.col("a")).alias("biggest"), told(V.smallest(F.col("a"), 3)).alias("least"), V.index_of(F.col("a"), F.get(F.col("a"), 7)).alias("found"), F.round(V.interpolate(F.col("a"), F.lit(10.25)), 6).alias("between_"),
        told(V.resampled(F.col("a"), 10)).alias("ten"), told(V.rotated(F.col("a"), 0.7, 0, 1)).alias("turned"), F.round(F.get(V.project(F.col("a"), F.col("b"), [axis]), 0), 6).alias("projected"), told(V.without_component(F.col("a"), axis)).alias("without_"),
        told(V.moved_towards(F.col("a"), F.col("b"), 1.0, 0.5)).alias("moved"),
    )


@query("grid_points", "SELECT x::INT AS x, y::INT AS y, z::INT AS z FROM range(3) p(x), range(4) q(y), range(5) r(z)")
def grid_points(spark, sf_dir):
    return spark.range(1).select(F.explode(V.grid(3, 4, 5)).alias("p")).select(*(F.get("p", i).alias(c) for i, c in enumerate("xyz")))


@query("row_distances", """SELECT l_orderkey, l_linenumber, round(((l_quantity - 20) * 0.1) ^ 2 + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 4 END, 6) AS scaled, round((l_quantity - 20) ^ 2 + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, 6) AS plain FROM lineitem""")
def row_distances(spark, sf_dir):
    pairs = [(F.col("l_quantity"), F.lit(20.0), False), (F.col("l_returnflag"), F.lit("R"), True)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(V.mixed_squared_distance(pairs, [0.1, 2.0]), 6).alias("scaled"), F.round(V.mixed_squared_distance(pairs), 6).alias("plain"))


@query("kernel_values", _V + f""", k AS (SELECT vec_id, {_DOT} AS d, {_D2} AS s, {_N2A} AS aa, {_N2B} AS bb FROM v)
SELECT vec_id, round(d, 6) AS linear, round((d + 1.5) ^ 3, 5) AS polynomial, round(exp(-0.5 * s / 2), 6) AS gaussian, round(d + 2, 6) AS shifted, round(d * 3, 6) AS scaled, round(d + exp(-0.5 * s / 2), 6) AS summed, round(d * exp(-0.5 * s / 2), 6) AS multiplied,
round(d ^ 2, 6) AS raised, round(exp(d), 5) AS exponential, round(d / sqrt(aa * bb), 6) AS normalised FROM k""")
def kernel_values(spark, sf_dir):
    k, g = kernels.linear(), kernels.gaussian(2.0)
    both = {"linear": k, "gaussian": g, "shifted": kernels.shifted(k, 2.0), "scaled": kernels.scaled(k, 3.0), "summed": kernels.summed(k, g), "multiplied": kernels.multiplied(k, g), "raised": kernels.raised(k, 2), "normalised": kernels.normalised(k)}
    return _vectors(spark, sf_dir).select("vec_id", *_row({n: f(F.col("a"), F.col("b")) for n, f in both.items()}), F.round(kernels.polynomial(1.5, 3)(F.col("a"), F.col("b")), 5).alias("polynomial"), F.round(kernels.exponential(k)(F.col("a"), F.col("b")), 5).alias("exponential"))


@query("more_densities", f"""SELECT p_partkey, round(exp(p_size * ln(4) - 4 - lgamma(p_size + 1)), 9) AS poisson, round(exp(1.5 * ln(p_size) - p_size / 3 - {math.lgamma(2.5)!r} - 2.5 * ln(3)), 9) AS gamma,
round(exp(2.5 * ln(3) - {math.lgamma(2.5)!r} - 3.5 * ln(p_size) - 3 / p_size), 9) AS inverse_gamma, round(exp(ln(p_size / 51) + 2 * ln(1 - p_size / 51) + {math.lgamma(5) - math.lgamma(2) - math.lgamma(3)!r}), 9) AS beta,
round(1 / (1 + ((1 - p_size / 51) / (p_size / 51)) ^ 2), 9) AS soft_impulse,
round(exp(-0.5 * ((3 * (p_size - 25) ^ 2 - 2 * (p_size - 25) * (p_retailprice / 100 - 12) + 2 * (p_retailprice / 100 - 12) ^ 2) / 5)) / (2 * pi() * sqrt(5)), 9) AS normal2 FROM part""")
def more_densities(spark, sf_dir):
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    return table(spark, sf_dir, "part").select("p_partkey", *_row({
        "poisson": numeric.poisson_density(F.col("p_size"), 4), "gamma": numeric.gamma_density(x, 2.5, 3.0), "inverse_gamma": numeric.inverse_gamma_density(x, 2.5, 3.0), "beta": numeric.beta_density(x / 51, 2.0, 3.0),
        "soft_impulse": numeric.soft_impulse_cumulative(x / 51, 2.0), "normal2": numeric.multivariate_normal_density([x, y], [25.0, 12.0], [[2.0, 1.0], [1.0, 3.0]]),
    }, 9))


_SIMPSON = "list_sum(list_transform(range(0, 401), lambda i: exp(-((i * x / 400) ^ 2)) * CASE WHEN i IN (0, 400) THEN 1 ELSE 2 + 2 * (i % 2) END)) * x / 400 / 3 * 2 / sqrt(pi())"


@query("special_values", f"""WITH t AS (SELECT p_partkey, p_size, p_size / 25.0::DOUBLE AS x FROM part)
SELECT p_partkey, round({_SIMPSON}, 6) AS erf, round(lgamma(p_size + 0.5), 6) AS log_gamma, round(gamma(x), 6) AS gamma, round(lgamma(p_size + 1), 6) AS log_factorial, round(x, 6) AS product_log_back, round(x / 2.1, 6) AS inverse_erf_back,
round((p_size::DOUBLE) ^ 3 / 3, 4) AS square_area, round(1 - cos(x), 6) AS sine_area FROM t""")
def special_values(spark, sf_dir):
    x = F.col("p_size") / F.lit(25.0)
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", x.alias("x"), numeric.product_log(x).alias("w"), numeric.inverse_erf(x / 2.1).alias("e"))
    x = F.col("x")
    return df.select("p_partkey", *_row({
        "erf": numeric.erf(x), "log_gamma": numeric.log_gamma(F.col("p_size") + 0.5), "gamma": numeric.gamma(x), "log_factorial": numeric.log_factorial(F.col("p_size")), "product_log_back": F.col("w") * F.exp("w"),
        "inverse_erf_back": numeric.erf(F.col("e")), "sine_area": numeric.integrate(F.sin, 0.0, x),
    }), F.round(numeric.integrate(lambda t: t * t, 0.0, F.col("p_size").cast("double")), 4).alias("square_area"))


@query("probability_values", f"""SELECT name, value FROM (SELECT 54.5 / sqrt(20 * 21 * 41 / 24) / sqrt(2) AS x), LATERAL (VALUES ('beta_2_3_half', 0.6875::DOUBLE), ('t_10_2', 0.073388035::DOUBLE), ('wilcoxon_20_50', round(1 - {_SIMPSON}, 6)), ('pascal_10_4', 210.0::DOUBLE), ('total_beta_2_3', 0.083333333::DOUBLE)) t(name, value)""")
def probability_values(spark, sf_dir):
    """The distribution of Beta(2, 3) is 6 x^2 - 8 x^3 + 3 x^4; the t value has a table entry, the rank sum a normal one."""
    rows = [
        ("beta_2_3_half", round(numeric.beta_share(2, 3, 0.5), 9)), ("t_10_2", round(numeric.t_test_alpha(10, 2.0), 9)), ("wilcoxon_20_50", round(numeric.wilcoxon_alpha(20, 50.5), 6)),
        ("pascal_10_4", float(numeric.pascal_row(10)[4])), ("total_beta_2_3", round(numeric.incomplete_beta(1.0, 2, 3), 9)),
    ]
    return spark.createDataFrame(rows, "name string, value double")


@query("quaternion_parts", """WITH t AS (SELECT p_partkey, p_size::DOUBLE AS ax, 1.0::DOUBLE AS ay, 2.0::DOUBLE AS az, p_retailprice / 100 AS w FROM part), u AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS n FROM t),
k AS (SELECT p_partkey, ax / n AS x, ay / n AS y, az / n AS z, cos(w) AS c, sin(w) AS s, cos(w / 2) AS hc, sin(w / 2) AS hs FROM u)
SELECT p_partkey, round(c + x * x * (1 - c), 6) AS px, round(z * s + y * x * (1 - c), 6) AS py, round(-y * s + z * x * (1 - c), 6) AS pz, round(hc * hc + hs * hs, 6) AS own_product, round(sin(0.1) / sin(0.4), 6) AS slerp_a, round(sin(0.3) / sin(0.4), 6) AS slerp_b,
round(y * 3 - z * 2, 6) AS cross_x, round(z * 1 - x * 3, 6) AS cross_y, round(sin(c) * cos(s), 6) AS sphere_x, round(sin(c) * sin(s), 6) AS sphere_y, round(cos(c), 6) AS sphere_z FROM k""")
def quaternion_parts(spark, sf_dir):
    axis, w = F.array(F.col("p_size").cast("double"), F.lit(1.0), F.lit(2.0)), F.col("p_retailprice") / 100
    df = table(spark, sf_dir, "part").select("p_partkey", axis.alias("axis"), w.alias("w"))
    axis, w = F.col("axis"), F.col("w")
    vector = lambda *x: F.array(*(F.lit(float(e)) for e in x))
    q = geometry.about_axis(axis, w)
    point = geometry.rotated_about(vector(1, 0, 0), axis, w)
    half = geometry.slerp(vector(1, 0, 0, 0), vector(math.cos(0.4), math.sin(0.4), 0, 0), F.lit(0.75))
    # the second unit vector of the arc is what is left beside the first
    b = F.get(half, 1) / math.sin(0.4)
    a = F.get(half, 0) - b * math.cos(0.4)
    crossed, sphere = geometry.cross(V.normalized(axis), vector(1, 2, 3)), geometry.cartesian(F.sin(w), F.cos(w))
    return df.select("p_partkey", *_row({
        "px": F.get(point, 0), "py": F.get(point, 1), "pz": F.get(point, 2), "own_product": F.get(geometry.quaternion_product(q, geometry.conjugate(q)), 3), "slerp_a": a, "slerp_b": b,
        "cross_x": F.get(crossed, 0), "cross_y": F.get(crossed, 1), "sphere_x": F.get(sphere, 0), "sphere_y": F.get(sphere, 1), "sphere_z": F.get(sphere, 2),
    }))


@query("homogeneous_points", """WITH t AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part)
SELECT p_partkey, round((x * 2 + 1) * cos(0.5) - (y * 3 - 1) * sin(0.5), 6) AS u, round((x * 2 + 1) * sin(0.5) + (y * 3 - 1) * cos(0.5), 6) AS v, round(x + 0.25 * y, 6) AS sheared, round(x, 6) AS back FROM t""")
def homogeneous_points(spark, sf_dir):
    m = geometry.rotation(0.5) @ geometry.translation(1.0, -1.0) @ geometry.scaling(2.0, 3.0)
    p = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100)
    df = table(spark, sf_dir, "part").select("p_partkey", p.alias("p"), geometry.transformed(geometry.literal(m), p, 3).alias("q"), geometry.inverse_of(geometry.literal(m)).alias("inverse"))
    back = geometry.transformed(F.col("inverse"), F.col("q"), 3)
    sheared = geometry.transformed(geometry.literal(geometry.shear(2, 0, 1, 0.25)), F.col("p"), 3)
    return df.select("p_partkey", *_row({"u": F.get("q", 0), "v": F.get("q", 1), "sheared": F.get(sheared, 0), "back": F.get(back, 0)}))


@query("fourier", _V + f"""SELECT vec_id, round({_sum('a[i] * cos(2 * pi() * (i - 1) / len(a))')}, 5) AS re1, round(-{_sum('a[i] * sin(2 * pi() * (i - 1) / len(a))')}, 5) AS im1, round({_sum('a[i] * cos(2 * pi() * 5 * (i - 1) / len(a))')}, 5) AS re5, round(list_sum(a), 5) AS re0 FROM v""")
def fourier(spark, sf_dir):
    df = _vectors(spark, sf_dir).select("vec_id", geometry.spectrum(F.col("a")).alias("s"))
    return df.select("vec_id", *_row({"re1": F.get("s", 2), "im1": F.get("s", 3), "re5": F.get("s", 10), "re0": F.get("s", 0)}, 5))


_LEVEL = "greatest(0, least(255, floor((a[{i}] + 1) * 128)))"


@query("pixels", _V + f"""SELECT vec_id, ({_LEVEL.format(i=1)} * 65536 + {_LEVEL.format(i=2)} * 256 + {_LEVEL.format(i=3)})::INT AS first, (len(a) // 3)::INT AS n, round(({_LEVEL.format(i=5)} + 0.5) / 128 - 1, 6) AS fifth FROM v""")
def pixels(spark, sf_dir):
    p = geometry.to_pixels(F.col("a"), -1.0, 1.0)
    return _vectors(spark, sf_dir).select("vec_id", F.get(p, 0).alias("first"), F.size(p).alias("n"), F.round(F.get(geometry.from_pixels(p, -1.0, 1.0), 4), 6).alias("fifth"))


@query("fourier_2d", _V + f"""SELECT vec_id, round({_sum('a[i] * cos(2 * pi() * (((i - 1) // 8) + 2 * ((i - 1) % 8)) / 8)')}, 5) AS re12, round(-{_sum('a[i] * sin(2 * pi() * (((i - 1) // 8) + 2 * ((i - 1) % 8)) / 8)')}, 5) AS im12 FROM v WHERE len(a) = 64""")
def fourier_2d(spark, sf_dir):
    """Of vectors of 64 values as images of 8 x 8: the coefficient of row 1 and column 2."""
    df = _vectors(spark, sf_dir).where(F.size("a") == 64).select("vec_id", geometry.spectrum_2d(8)(F.col("a")).alias("s"))
    return df.select("vec_id", *_row({"re12": F.get("s", 20), "im12": F.get("s", 21)}, 5))


@query("tag_values", "SELECT page_id, regexp_extract(html, '<[a-zA-Z]+ +[a-zA-Z_]+=\"([^\"]*)\"', 1) AS first_value, length(regexp_replace(html, '[\r\n]+$', ''))::INT AS chomped FROM pages")
def tag_values(spark, sf_dir):
    from seqloom.functions import text

    tag = F.regexp_extract("html", '<[a-zA-Z]+ +[a-zA-Z_]+="[^"]*"', 0)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.get(F.map_values(text.tag_attributes(tag)), 0), F.lit("")).alias("first_value"), F.length(text.chomp(F.col("html"))).alias("chomped"))


@query("label_information", "WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS t FROM c) SELECT round(-sum(n / t * log2(n / t)), 6) AS bits, (SELECT round(var_samp(l_quantity), 6) FROM lineitem) AS variance FROM c, t")
def label_information(spark, sf_dir):
    from seqloom.operators import aggregate

    df = table(spark, sf_dir, "lineitem")
    bits = aggregate.label_information(df, "l_returnflag").select(F.round("information", 6).alias("bits"))
    return bits.crossJoin(aggregate.label_information(df, "l_quantity", False).select(F.round("information", 6).alias("variance")))  # one row each


@query("plot_marks", """SELECT (SELECT count(*) FROM (SELECT DISTINCT least(63, floor((l_quantity - lo) * 64 / w)), least(63, floor((l_discount - ld) * 64 / wd)) FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) - min(l_quantity) AS w, min(l_discount) AS ld, max(l_discount) - min(l_discount) AS wd FROM lineitem)))::INT AS scatter,
(SELECT count(DISTINCT l_returnflag) FROM lineitem)::INT AS bars, 9 AS correlations""")
def plot_marks(spark, sf_dir):
    """How many marks each plot has."""
    from seqloom.operators import plots

    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")))
    flags = [(r[0], r[1]) for r in df.groupBy("l_returnflag").count().orderBy("l_returnflag").collect()]
    drawn = (plots.scatter(df, "l_quantity", "l_discount"), plots.bars(flags), plots.correlations(df, ["l_quantity", "l_discount", "l_tax"]))
    return spark.createDataFrame([tuple(x.count("<rect") for x in drawn)], "scatter int, bars int, correlations int")
