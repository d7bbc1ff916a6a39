"""Sources, functions and operators on small tables with known results."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.functions import formula, geometry, numeric, text
from seqloom.functions import vectors as V
from seqloom.operators import aggregate, clusters, features, generate, graphs, matrix, models, neighbors, sequences
from seqloom.operators import table as T
from seqloom.sources import gesture, tables
from seqloom.streaming import segments


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*v):
    return F.array(*(F.lit(x) if x is None else F.lit(float(x)) for x in v))


def write(path, body):
    path.write_text(body)
    return str(path)


# sources ---------------------------------------------------------------------------------------------------------------------


def test_gestures(spark, tmp_path):
    body = "# gesture #1\n@ PUSH\n0 0 0 -147.3 -158.9 0\n# inside\n0 0 0 -147.5 -159.5 0\n\n\n# gesture #2\n@ WAVE\n1 2 3 4 5 6\n\n1 1 1 1 1 1 1 1 1"
    rows = gesture.read_gestures(spark, write(tmp_path / "g.txt", body))
    got = [(r.seq_id, r.label, r.pos, r.point) for r in rows.orderBy("seq_id", "pos").collect()]
    assert got == [(0, "PUSH", 0, [0, 0, 0, -147.3, -158.9, 0]), (0, "PUSH", 1, [0, 0, 0, -147.5, -159.5, 0]), (1, "WAVE", 0, [1, 2, 3, 4, 5, 6]), (2, "UNKNOWN", 0, [1.0] * 9)]
    gesture.write_gestures(rows, str(tmp_path / "out"))
    again = gesture.read_gestures(spark, str(tmp_path / "out"))
    assert sorted(r.point for r in again.collect()) == sorted(r.point for r in rows.collect())
    assert gesture.read_gestures(spark, write(tmp_path / "e.txt", "")).count() == 0


def test_arff(spark, tmp_path):
    head = "% note\n@RELATION 'r'\n@Attribute 'the x' Real\n@ATTRIBUTE kind{a, b,C}\n@DATA\n"
    df = tables.read_arff(spark, write(tmp_path / "a.arff", head + "1.5,a\n?,c\n% gone\n\n-2e3,?\n"))
    assert df.columns == ["the x", "kind"] and sorted(map(tuple, df.collect()), key=repr) == sorted([(1.5, "a"), (None, "C"), (-2000.0, None)], key=repr)
    tables.write_arff(df, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_arff(spark, str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    for bad in ("1,a,2\n", "1\n", "x,a\n", "1,z\n"):
        with pytest.raises(PySparkException):
            tables.read_arff(spark, write(tmp_path / "b.arff", head + bad)).collect()


def test_delimited(spark, tmp_path):
    df = tables.read_delimited(spark, write(tmp_path / "c.csv", "a,b,c\n1,2,x\n?,3.5,\n"), header=True)
    assert df.dtypes == [("a", "double"), ("b", "double"), ("c", "string")]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(1.0, 2.0, "x"), (None, 3.5, None)], key=repr)
    short = write(tmp_path / "s.txt", "1 2   3\n4\t5\n")
    with pytest.raises(ValueError):
        tables.read_delimited(spark, short, None)
    assert tables.read_delimited(spark, short, None, tolerant=True).orderBy("attr0").collect()[1].attr2 is None


def test_sparse(spark, tmp_path):
    for head in ("3,4", "3 4"):
        df = tables.read_sparse(spark, write(tmp_path / "m.sparse", head + "\n0=1.5,3=2\n\n2=-1\n"))
        assert sorted(map(tuple, df.collect())) == [(0, 0, 1.5), (0, 3, 2.0), (2, 2, -1.0)]
    tables.write_sparse(df, str(tmp_path / "out"), 3, 4)
    assert sorted(map(tuple, tables.read_sparse(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_model_files():
    body = "M= 2\nN= 3\nA:\n.9 .05 .05\n.45 .1 .45\n.45 .45 .1\nB:\n.5 .5\n.75 .25\n.25 .75\npi:\n.333 .333 .333\n"
    m = tables.read_hmm(body)
    assert m["transition"][1] == [0.45, 0.1, 0.45] and m["initial"] == [0.333] * 3
    assert tables.read_hmm(tables.write_hmm(m)) == m
    assert tables.read_symbols("R= 1\nT= 3\n1 2 2\n") == [1, 2, 2] == tables.read_symbols(tables.write_symbols([1, 2, 2]))


# functions -------------------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    a, b = arr(1, 2, 3), arr(3, 0, -1)
    want = {
        "dot": (V.dot(a, b), 0.0), "l1": (V.l1(a, b), 8.0), "l2": (V.l2(a, b), math.sqrt(24)), "inf": (V.l_inf(a, b), 4.0), "corr": (V.correlation(a, b), 0.0), "p": (V.p_magnitude(arr(3, 4), 2), 5.0),
        "known": (V.known_squared_distance(arr(1, None, 3), arr(0, 5, 1)), 7.5), "none": (V.known_squared_distance(arr(None), arr(1)), 1e50), "max": (V.index_of_max(arr(1, 5, 5)), 1),
        "mag": (V.index_of_max_magnitude(arr(1, -7, 5)), 1), "score": (V.alignment_score(F.lit(None).cast("array<double>"), a), -0.5), "at": (V.interpolate(arr(0, 10, 20), F.lit(1.25)), 12.5),
        "sub": (V.without_component(arr(1, 2), arr(1, 0)), [0.0, 2.0]), "rot": (F.transform(V.rotated(arr(1, 0, 9), math.pi / 2, 0, 1), lambda x: F.round(x, 9)), [0.0, 1.0, 9.0]), "re": (V.resampled(arr(0, 10), 3), [0.0, 5.0, 10.0]),
        "one": (V.sum_to_one(arr(1, 3)), [0.25, 0.75]), "cap": (V.cap(arr(1, 9), 4), [1.0, 4.0]), "safe": (V.safe_normalized(arr(0, 0)), [1.0, 0.0]), "missing": (V.has_missing(arr(1, None)), True),
        "hot": (V.one_hot(F.lit("b"), ["a", "b"]), [0.0, 1.0]), "small": (V.smallest(arr(3, 1, 2), 2), [1.0, 2.0]),
    }
    got = spark.range(1).select(*(c.alias(k) for k, (c, _) in want.items())).first()
    for k, (_, v) in want.items():
        assert got[k] == pytest.approx(v), k
    assert len(one(spark, V.grid(2, 3))) == 6


def test_numbers(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (None,)], "x double")
    got = df.select(numeric.erf(F.col("x")), numeric.log_gamma(F.col("x")), numeric.product_log(F.col("x")), numeric.inverse_erf(F.col("x") / 4)).collect()
    assert got[1][:2] == (math.erf(2), math.lgamma(2)) and got[2][0] is None
    assert got[1][2] * math.exp(got[1][2]) == pytest.approx(2) and math.erf(got[1][3]) == pytest.approx(0.5)
    assert numeric.t_test_alpha(10, 2.228) == pytest.approx(0.05, abs=1e-4) and numeric.pascal_row(4) == [1, 4, 6, 4, 1]
    assert numeric.incomplete_beta(0.5, 2, 2) == pytest.approx(1 / 12)
    assert one(spark, numeric.integrate(lambda x: x * x, 0.0, 3.0)) == pytest.approx(9)
    assert one(spark, numeric.poisson_density(F.lit(2), 3)) == pytest.approx(9 / 2 * math.exp(-3))
    assert one(spark, numeric.gamma_density(F.lit(1.5), 2, 0.5)) == pytest.approx(1.5 * 4 * math.exp(-3))
    assert one(spark, numeric.beta_density(F.lit(0.25), 2, 3)) == pytest.approx(12 * 0.25 * 0.75**2)


def test_formulas(spark):
    own = formula.Formulas("h(bob)=bob^2;somefunc(x)=3+blah(x,5)*h(x)-(x/foo);blah(a,b)=a*b-b;foo=3.2")
    assert one(spark, own.call("somefunc", 1.1)) == pytest.approx(3.26125, abs=1e-12)
    assert one(spark, formula.Formulas("f(x) = -x^2 + 7 % 4 * 2").call("f", 3)) == pytest.approx(-3)
    for bad in ("f(x)=g(x)", "f(x)=(x", "f(x)=f(x)", "nonsense", "f(x)=x x"):
        with pytest.raises(formula.FormulaError):
            formula.Formulas(bad).call("f", 1)


def test_dates(spark):
    cases = {"31 DEC 2000": "2000-12-31", "jan 02, 2006": "2006-01-02", "14 feb 1401": "1401-02-14", "07/13/1999": "1999-07-13", "13-7-1999": "1999-07-13", "6-7-1999": "1999-06-07", "6.7.1999": "1999-07-06", "1993-2-1": "1993-02-01", "1987": "1987-01-01", "junk": "None", "99/99/99": "None"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: str(r.d) for r in got} == cases


def test_stems_and_html(spark):
    for word, want in {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "vietnamization": "vietnam", "adjustable": "adjust", "controlling": "control", "sky": "sky"}.items():
        assert text.porter_stem(word) == want
    assert one(spark, F.trim(text.visible_text(F.lit("<p>a<!-- x <b> --><script>if (a<b) c</script></p>b")))).split() == ["a", "b"]


def test_geometry(spark):
    q1, q2 = arr(1, 2, 3, 4), arr(3, 4, 2, 1)
    assert one(spark, geometry.conjugate(q1)) == [-1, -2, -3, 4]
    assert one(spark, geometry.quaternion_product(q1, q2)) == [5.0, 25.0, 9.0, -13.0]
    assert one(spark, geometry.quaternion_product(q1, geometry.conjugate(q1))) == [0, 0, 0, 30]
    assert one(spark, geometry.rotated_about(arr(1, 0, 0), arr(0, 0, 2), F.lit(math.pi / 2))) == pytest.approx([0, 1, 0])
    half = one(spark, geometry.slerp(arr(0, 0, 0, 1), arr(0, 0, 1, 0), F.lit(0.5)))
    assert half == pytest.approx([0, 0, math.sqrt(0.5), math.sqrt(0.5)])
    assert one(spark, geometry.transformed(geometry.literal(geometry.translation(1, 2) @ geometry.rotation(math.pi / 2)), arr(1, 0), 3)) == pytest.approx([1, 3])
    assert one(spark, geometry.inverse_of(arr(2, 0, 0, 4))) == [0.5, 0, 0, 0.25]
    assert one(spark, geometry.spectrum(arr(1, 1, 1, 1))) == pytest.approx([4] + [0] * 7)


# tables ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i * i), "ab"[i % 2]) for i in range(20)], "k long, v double, c string")
    return T.with_order(df.repartition(5), "k")


def test_rows(spark, small):
    assert [(r.k, r._ord) for r in small.orderBy("k").collect()] == [(i, i) for i in range(20)]
    assert T.parse_columns("0,2-4,7-6", 8) == [0, 2, 3, 4, 7, 6]
    for bad in ("1,1", "9", "a", "2-x"):
        with pytest.raises(ValueError):
            T.parse_columns(bad, 8)
    assert T.replace_missing(small, ["v"], 3).where("v is null").count() == 0
    assert {r.v for r in T.replace_missing(small, ["v"], 3).collect()} <= {float(i * i) for i in range(20) if i % 4}
    assert T.replace_missing(small.withColumn("v", F.lit(None).cast("double")), ["v"]).agg(F.max("v")).first()[0] == 0
    low, high = T.split_by_pivot(small, "v", 100.0)
    assert low.count() + high.count() == 20 and low.where("v is null").count() in (0, 5)
    assert sorted(r._ord for r in T.shuffle(small, 1).collect()) == list(range(20))
    with pytest.raises(PySparkException):
        T.require_known(small, ["v"]).collect()
    with pytest.raises(PySparkException):
        T.zip_join(small.select("_ord", "k"), T.first_rows(small, 3).select("_ord", "c")).collect()
    assert T.zip_join(small.select("_ord", "k"), small.select("_ord", "k")).columns == ["_ord", "k", "k_1"]
    assert T.append(small, small).agg(F.max("_ord")).first()[0] == 39


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (2.0, 1.0, "b"), (None, 1.0, "b"), (4.0, 1.0, None)], "x double, y double, c string")
    r = aggregate.column_stats(df, ["x", "y"]).collect()
    assert (r[0].n, r[0].missing, r[0].med, r[1].dev) == (3, 1, 2.0, 0.0)
    c = {(q.a, q.b): q.corr for q in aggregate.covariances(df, ["x", "y"]).collect()}
    assert c["x", "y"] == 0 and c["x", "x"] == 1
    assert aggregate.nominal_stats(df, "c").first().mode == "b"
    one_row = spark.createDataFrame([(3.0,)], "x double")
    assert aggregate.column_stats(one_row, ["x"]).first().dev == 0
    w = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (5.0, 1.0), (3.0, 2.0)], "a double, b double")
    assert aggregate.wilcoxon(w, "a", "b").first() == (4, 3.0)


def test_medians_of_long_columns(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=4001), np.full(300, 1e300), np.full(299, -1e300)])
    rows = [(float(v), float(i % 3) if i % 5 else None, None, int(i)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, few double, none double, whole long").repartition(6)
    got = {r.name: r for r in aggregate.column_stats(df, ["x", "few", "none", "whole"], 12).collect()}
    assert got["x"].med == round(float(np.median(x)), 12) and got["whole"].med == 2299.5 and got["whole"].n == 4600
    assert got["few"].med == 1.0 and got["few"].missing == 920 and got["none"].med is None and got["none"].n == 0
    sketches, n = [[5.0, 6.0], [0.0, 0.0]], [4600, 3680]  # beside the medians
    assert aggregate.medians(df, ["x", "few"], sketches, n) == [float(np.median(x)), 1.0]
    assert "percentile(" not in aggregate.column_stats(df, ["x"])._jdf.queryExecution().toString()  # which sends all values to one task
    assert [r.med for r in aggregate.column_stats(df.where("whole < 0"), ["x", "few"]).collect()] == [None, None]
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert aggregate.column_stats(odd, ["x"]).first().med == 2.0


# matrices --------------------------------------------------------------------------------------------------------------------


def test_matrices(spark):
    a, b = matrix.to_table(spark, np.array([[2, 17], [7, 19]])), matrix.to_table(spark, np.array([[11, 3], [5, 13]]))
    want = np.array([[107, 227], [172, 268]])
    ta, tb = matrix.transpose(a), matrix.transpose(b)
    for x, y, fa, fb in ((a, b, False, False), (ta, b, True, False), (a, tb, False, True), (ta, tb, True, True)):
        assert (matrix.dense(matrix.multiply(x, y, fa, fb)) == want).all()
    low = np.array([[3.0, 0, 0], [1, 4, 0], [2, 2, 7]])
    assert np.allclose(matrix.cholesky(low @ low.T), low)
    assert np.allclose(matrix.pseudo_inverse(np.array([[2.0, -1, 0], [-1, 2, -1], [0, -1, 2]])), [[0.75, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 0.75]])
    assert matrix.determinant(np.array([[1.0, 2, 3, 4], [5, 6, 7, 8], [2, 6, 4, 8], [3, 1, 1, 2]])) == pytest.approx(72)
    r, rank = matrix.reduced_row_echelon(np.array([[1, -1, 1, 0, 2], [2, -2, 0, 2, 2], [-1, 1, 2, -3, 1], [-2, 2, 1, -3, -1]]))
    assert rank == 2 and np.allclose(r[:2], [[1, -1, 0, 1, 1], [0, 0, 1, -1, 1]])
    assert matrix.trace(a).first()[0] == 21 and matrix.element(a, 0, 1) == 17 and matrix.element(matrix.with_element(a, 0, 1, 5.0), 0, 1) == 5
    assert matrix.squared_difference_with_identity(a, 2).first()[0] == 1 + 17**2 + 49 + 18**2
    assert matrix.dense_rows(a, 3).orderBy("row").first().vec == [2, 17, 0]
    assert (matrix.dense(matrix.mirrored(a)) == [[2, 17], [17, 19]]).all() and (matrix.dense(matrix.swapped(a, "row", 0, 1)) == [[7, 19], [2, 17]]).all()


def test_components_and_alignment(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ np.diag([5, 2, 0.1]) + [1, 2, 3]
    c, s = math.cos(0.4), math.sin(0.4)
    y = (x - 4) @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])
    df = spark.createDataFrame([tuple(map(float, (*p, *q))) for p, q in zip(x, y, strict=True)], [f"{n}{i}" for n in "ab" for i in range(3)])
    mean, basis, var = matrix.principal_components(df, ["a0", "a1", "a2"], 3)
    assert np.allclose(var, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1])
    back = matrix.restored(matrix.projected(df, ["a0", "a1", "a2"], mean, basis).drop("a0", "a1", "a2"), ["a0", "a1", "a2"], mean, basis)
    assert np.allclose(sorted(r.a0 for r in back.collect()), sorted(x[:, 0]))
    turned = matrix.aligned(df, ["a0", "a1", "a2"], ["b0", "b1", "b2"])
    assert turned.agg(F.max(F.abs(F.col("a0") - F.col("b0")) + F.abs(F.col("a1") - F.col("b1")))).first()[0] < 1e-6
    assert matrix.count_components(df, ["a0", "a1", "a2"], 0.1) == 2


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_terms_are_counted_once_and_numbered_by_stem(spark, monkeypatch, small):
    from seqloom import session

    monkeypatch.setattr(session, "SMALL", small)  # with and without broadcasts
    docs = spark.createDataFrame([(1, "Running runner runs; running! Being THERE"), (2, "runs walked walks"), (None, None), (3, "walking, runs into")], "doc_id long, text string")
    words = {1: ["running", "runner", "runs", "running"], 2: ["runs", "walked", "walks"], 3: ["walking", "runs"]}
    counts = {}
    for d, ws in words.items():
        for w in ws:
            counts[d, text.porter_stem(w)] = counts.get((d, text.porter_stem(w)), 0) + 1
    terms = sorted({t for _, t in counts})
    df = {t: sum(1 for _, x in counts if x == t) for t in terms}
    most = {t: max(n for (_, x), n in counts.items() if x == t) for t in terms}
    want = {(d, t): n * math.log(4 / df[t]) / most[t] for (d, t), n in counts.items()}  # a null id is a document too
    got = features.term_weights(docs, "doc_id", "text").collect()
    assert {(r.doc_id, r.term): r.weight for r in got} == pytest.approx({k: n * math.log(4 / df[k[1]]) / most[k[1]] for k, n in counts.items()}) and len(got) == len(want)
    rows = features.term_matrix(docs, "doc_id", "text").collect()
    assert {(r["row"], terms[r["col"]]): r["val"] for r in rows} == pytest.approx(want) and len(rows) == len(want)
    ones = features.term_matrix(docs, "doc_id", "text", stemming=False, binary=True)
    assert {(r["row"], r["col"], r["val"]) for r in ones.collect()} == {(d, sorted({x for v in words.values() for x in v}).index(w), 1.0) for d, ws in words.items() for w in ws}
    plan = ones._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan  # texts aren't read again


# neighbours, clusters, graphs --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 4096])
def test_neighbors(spark, block):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, size=(120, 2)).astype(float)  # many ties
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    q = df.where("vec_id % 10 = 0")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    got = {(r["query"], r["rank"]): r.neighbor for r in neighbors.nearest(q, df, 4, block=block).collect()}
    assert got == {(i, k + 1): int(j) for i in range(0, 120, 10) for k, j in enumerate(sorted((j for j in range(120) if j != i), key=lambda j: (d[i, j], j))[:4])}
    assert neighbors.within(q, df, 1.0, block=block).count() == sum((d[i] <= 1).sum() - 1 for i in range(0, 120, 10))
    edges = neighbors.nearest(df, df, 3)
    assert neighbors.patched(edges.where("rank < 3 or query % 2 = 0"), 3).groupBy("query").count().where("count > 3").count() == 0
    assert neighbors.scaled_by_local_mean(edges).count() == 360


def test_neighbors_hold_no_more_for_larger_batches():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(20_000, 8)), 1) + 100.0  # ties, and far from the origin
    ids, own = np.arange(20_000), np.arange(0, 20_000, 20)
    for of, bound in ((neighbors._nearest_of, 4), (neighbors._within_of, 2.25), (neighbors._count_of, 2.25)):
        peaks, out = [], []
        for n in (5_000, 20_000):
            batch = pa.RecordBatch.from_arrays([pa.array(ids[:n]), pa.array(list(x[:n]))], names=["i", "v"])
            tracemalloc.start()
            out = [[b.column(c).to_numpy() for c in range(b.num_columns)] for b in of([batch], own, x[own], bound, True) if n == 20_000 or b is None]
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < 60e6, of.__name__  # one estimate of every pair alone takes 160 MB
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        for q in own[:5]:
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            mine = cols[0] == q
            if of is neighbors._nearest_of:
                assert cols[1][mine].tolist() == sorted(ids, key=lambda j: (d[j], j))[:4]
            elif of is neighbors._within_of:
                assert sorted(cols[1][mine]) == np.flatnonzero(d <= 2.25).tolist()
            else:
                assert cols[1][mine].sum() == (d <= 2.25).sum()


def test_clusters(spark):
    df = generate.clustered_gauss_points(spark, 2000, 2, 5, 0.01, seed=3)
    centres, loss = clusters.kmeans(df, "point", 5, "id", seed=1, restarts=3)
    better, loss2 = clusters.kmeans_swap(df, "point", 5, "id", seed=1, swaps=6, lloyd=2, temperature=0.05)
    assert min(loss, loss2) / 2000 < 0.05 and len(centres) == len(better) == 5
    mix = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.randn(1)).otherwise(F.randn(2) + 8).alias("x"))
    (w0, m0, _), (_, m1, _) = clusters.gaussian_mixture(mix, "x", 2)
    assert abs(w0 - 0.25) < 0.03 and abs(m0) < 0.2 and abs(m1 - 8) < 0.2
    x = np.array([[0.0], [0.1], [5], [5.1], [9], [9.2]])
    assert clusters.agglomerative(x, 3).tolist() == [0, 0, 1, 1, 2, 2]
    assert sorted(i // 2 for i in clusters.kmedoids(x, 3)[0]) == [0, 1, 2]
    assert clusters.self_organising_map(x, 3, 1).shape == (3, 1, 1)


@pytest.mark.parametrize("kind", ["spread", "ties", "two"])
def test_quantiles_are_values_at_their_rank(spark, kind):
    rng = np.random.default_rng(6)
    x = {"spread": rng.normal(size=30_000), "ties": rng.integers(0, 40, 30_000) / 8, "two": np.concatenate([np.zeros(9_000), np.ones(9_000), rng.random(300)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    shares = [0.0, 0.25, 1 / 3, 0.4999, 0.75, 0.99995, 1.0]
    want = [float(np.sort(x)[max(1, math.ceil(round(s * len(x), 6))) - 1]) for s in shares]
    for most in (20, 10_000):
        assert clusters.quantiles(df, "x", shares, most) == want
    assert clusters.quantiles(df.where("x > 1e9"), "x", shares) == [] == clusters.gaussian_mixture(df.where("x > 1e9"), "x", 2)


def test_mixture_rounds_of_more_rows(spark):
    """Enough rows that approximate quantiles miss the SQL's start."""
    import duckdb

    from seqloom.plans import catalog

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["mixture_rounds"](spark, folder).collect()))
    assert got == sorted(con.execute(catalog.ORACLES["mixture_rounds"]).fetchall())


def test_graphs(spark):
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]
    _, load = graphs.betweenness(6, edges)
    assert load == {(0, 1): 1, (1, 2): 4, (0, 2): 4, (2, 3): 9, (3, 4): 4, (4, 5): 1, (3, 5): 4}
    weighted = [(a, b, 1.0 + a) for a, b in edges] + [(b, a, 0.5 + b) for a, b in edges]
    cost, prev = graphs.dijkstra(6, weighted, 5)
    df = spark.createDataFrame(weighted, "src long, dst long, cost double")
    got = {r.node: (r.cost, -1 if r.previous is None else r.previous) for r in graphs.shortest_paths(df, 5).collect()}
    assert {n: c for n, (c, _) in got.items()} == dict(enumerate(cost))
    full = np.full((6, 6), np.inf)
    for a, b, c in weighted:
        full[a, b] = c
    assert graphs.all_pairs(full)[0][5].tolist() == cost
    assert sorted(graphs.atomic_cycles(6, edges)) == [(0, 1, 2), (3, 4, 5)]
    assert graphs.min_cut(6, [(a, b, 1.0) for a, b in edges], 0, 5) == (1.0, {0, 1, 2})
    assert not graphs.is_connected(spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long")) and graphs.is_connected(df)
    ring = [(i, (i + 1) % 8, 1.0) for i in range(8)]
    assert len(graphs.cut_large_cycles(8, ring, 6)) == 7
    t = np.linspace(0, 3, 40)
    for f in (graphs.isomap, graphs.locally_linear, graphs.breadth_first_unfolding):
        y = f(np.stack([np.cos(t), np.sin(t)], 1), 4, 1)[:, 0]
        assert abs(np.corrcoef(y, t)[0, 1]) > 0.99


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_shortest_paths_make_their_edges_once(spark, monkeypatch, small):
    monkeypatch.setattr(graphs, "SMALL", small)  # with and without broadcasts
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def cost(a, b):
        made.add(1)
        return float((a * 7 + b * 3) % 11) / 4

    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, size=(120, 2)) if a != b})
    df = spark.createDataFrame(pairs, "src long, dst long").withColumn("cost", cost("src", "dst"))
    got = {r.node: (r.cost, r.previous) for r in graphs.shortest_paths(df, 3).collect()}
    price = {(a, b): float((a * 7 + b * 3) % 11) / 4 for a, b in pairs}
    want, _ = graphs.dijkstra(40, [(a, b, c) for (a, b), c in price.items()], 3)
    assert {n: c for n, (c, _) in got.items()} == {i: c for i, c in enumerate(want) if c < np.inf}
    assert all(p is None if n == 3 else c == got[p][0] + price[p, n] for n, (c, p) in got.items())
    assert made.value == len(pairs)


# sequences -------------------------------------------------------------------------------------------------------------------


def test_alignment_and_thinning(spark):
    a, b = [[1, 0], [0, 1], [1, 1]], [[0, 1], [1, 1]]
    assert sequences.local_alignment(a, b) == pytest.approx(2) and sequences.local_alignment(a, []) == 0
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 3)), rng.normal(size=(7, 3))
    h = np.zeros((10, 8))
    for i in range(9):
        for j in range(7):
            c = x[i] @ y[j] / np.linalg.norm(x[i]) / np.linalg.norm(y[j])
            h[i + 1, j + 1] = max(0, h[i, j] + c, h[i, j + 1] - 0.2, h[i + 1, j] - 0.2)
    assert sequences.local_alignment(x, y, 0.2) == pytest.approx(h.max())
    pts = F.array(*(arr(v, 0) for v in (0, 1, 2, 3, 3.5, 9)))
    assert one(spark, sequences.thinned(pts)) == [[0, 0], [2, 0], [9, 0]]
    assert len(one(spark, sequences.resampled_sequence(pts, 4))) == 4
    rows = [(i, "PUSH" if i % 2 else "WAVE", [[1.0, float(i % 2), 0.1 * k] for k in range(5)]) for i in range(12)]
    df = spark.createDataFrame(rows, "seq_id long, label string, points array<array<double>>")
    got = {r["query"]: r.prediction for r in sequences.recognise(df.where("seq_id < 2"), df.where("seq_id >= 2"), 3).collect()}
    assert got == {0: "WAVE", 1: "PUSH"}


def test_recognition_searches_all_but_itself(spark, monkeypatch):
    from seqloom.plans import learning

    rows = [(i, "A", [[1.0, 0.0]] * 4) for i in (0, 20, 40)] + [(i, "B", [[0.0, 1.0]] * 4) for i in (1, 2, 3)] + [(60, "C", [[0.0, 1.0]] * 4)]
    df = spark.createDataFrame(rows, "seq_id long, label string, points array<array<double>>").repartition(3)
    monkeypatch.setattr(learning, "_tracks", lambda spark, sf_dir: df)
    want = {0: "A", 20: "A", 40: "A", 60: "B"}
    assert {r["query"]: r.prediction for r in learning.recognise_sequences(spark, None).collect()} == want
    assert {r["query"]: r.prediction for r in sequences.recognise(df.where("seq_id % 20 = 0"), df, 3, block=3).collect()} == want
    assert sequences.recognise(df.limit(0), df, 3).count() == 0


@pytest.mark.parametrize("gap", [0.05, 4.7])
def test_recognition_by_definition(spark, gap):
    rng = np.random.default_rng(8)
    seqs = [rng.normal(size=(int(n), 3)).round(1) for n in rng.integers(0, 12, 60)]
    seqs += seqs[:30]  # ties
    seqs[7] = seqs[7] * 0
    rows = [(i, "abc"[i % 3], p.tolist()) for i, p in enumerate(seqs)]
    df = spark.createDataFrame(rows, "seq_id long, label string, points array<array<double>>")
    want = {}
    for q in range(0, 90, 6):
        score = {i: sequences.local_alignment(seqs[q], p, gap) for i, p in enumerate(seqs) if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:4]
        labels = [rows[i][1] for i in best]
        want[q] = min(set(labels), key=lambda x: (-labels.count(x), x))
    got = {r["query"]: r.prediction for r in sequences.recognise(df.where("seq_id % 6 = 0"), df, 4, gap).collect()}
    assert got == want


def test_recognition_of_many_pairs(spark):
    import time

    rng = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], rng.exponential(size=(60, 3)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "seq_id long, label string, points array<array<double>>").repartition(4)
    began = time.time()
    assert sequences.recognise(df.where("seq_id % 20 = 0"), df, 3).count() == 75
    assert time.time() - began < 60  # one pair at a time takes minutes


def test_hidden_markov_model(spark):
    from itertools import product

    m = sequences.HiddenMarkovModel([0.4, 0.6], [[0.4, 0.6], [0.6, 0.4]], [[0.5, 0.5], [0.3, 0.7]])
    obs = [1, 0, 1]
    weigh = lambda p: m.initial[p[0]] * m.emission[p[0], obs[0]] * np.prod([m.transition[p[i - 1], p[i]] * m.emission[p[i], obs[i]] for i in range(1, 3)])
    paths = list(product(range(2), repeat=3))
    assert m.log_likelihood(obs) == pytest.approx(math.log(sum(map(weigh, paths))))
    assert tuple(m.best_path(obs)) == max(paths, key=weigh)
    df = spark.createDataFrame([(obs,)], "s array<int>")
    t = m.trained(df, "s", passes=1)
    assert t.initial == pytest.approx([0.29849966020178786, 0.70150033979821202], abs=1e-12)
    total = sum(map(weigh, paths))
    steps = np.zeros((2, 2))
    for q in paths:
        for a, b in zip(q, q[1:], strict=False):
            steps[a, b] += weigh(q) / total
    assert np.allclose(t.transition, steps / steps.sum(1, keepdims=True), atol=1e-12)
    assert t.emission.ravel() == pytest.approx([0.49547467745041401, 0.50452532254958593, 0.19935077334351725, 0.80064922665648264], abs=1e-12)
    assert df.select(m.score(F.col("s")).alias("x")).first().x == pytest.approx(m.log_likelihood(obs))
    states, symbols = m.sample(50, 1)
    assert len(states) == len(symbols) == 50


# models ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(11)
    c = rng.integers(0, 3, 2000)
    x = rng.normal(size=(2000, 2)) + 2 * np.stack([c == 1, c == 2], 1)
    return spark.createDataFrame([(i, float(a), float(b), "xyz"[k]) for i, ((a, b), k) in enumerate(zip(x, c, strict=True))], "_ord long, a double, b double, c string").persist()


@pytest.mark.parametrize(("name", "floor"), [("baseline", 0.31), ("neighbors", 0.68), ("bayes", 0.7), ("normal", 0.76), ("tree", 0.64), ("bag", 0.72), ("net", 0.74), ("bucket", 0.66)])
def test_models(classes, name, floor):
    d = features.Discretize.fit(classes, ["a", "b"], 12)
    make = {
        "baseline": models.Baseline(), "neighbors": models.NearestNeighbors(9), "bayes": models.NaiveBayes(), "normal": models.MixtureByClass(), "tree": models.decision_tree(depth=5),
        "bag": models.bagged_trees(trees=12, depth=5), "net": models.neural_net((6,), 60), "bucket": models.Bucket([models.Baseline(), models.MixtureByClass()]),
    }
    df = d.apply(classes) if name == "bayes" else classes
    model = make[name].fit(df.where("_ord < 1000"), ["a", "b"], "c")
    score = models.accuracy(model.predict(df.where("_ord >= 1000")), "c").first()[0]
    assert floor <= score < 0.9


def test_regression_and_validation(spark, classes):
    df = spark.range(300).select(F.col("id").alias("_ord"), F.randn(1).alias("a"), F.randn(2).alias("b")).withColumn("y", 3 * F.col("a") - F.col("b") + 1)
    for m in (models.linear_regression(), models.ComponentRegressor()):
        assert models.accuracy(m.fit(df, ["a", "b"], "y").predict(df), "y", nominal=False).first()[0] < 1e-6
    scores = models.cross_validate(models.MixtureByClass(), classes, ["a", "b"], "c", 2).collect()
    assert len(scores) == 2 and all(r.score > 0.7 for r in scores)
    assert models.split_test(models.Baseline(), classes, ["a"], "c", reps=2).count() == 2
    q = spark.createDataFrame([(0, 0, 0.0), (1, 0, 2.0)], "state int, action int, value double")
    s = spark.createDataFrame([(0, 0, 1.0, 1), (1, 0, None, 0)], "state int, action int, reward double, next_state int")
    assert {r.state: r.value for r in models.q_step(q, s, 0.5, 0.9).collect()} == {0: pytest.approx(1.4), 1: 2.0}


def test_features(spark):
    df = spark.createDataFrame([(0.0, "a", "u"), (10.0, "b", "v"), (None, None, "u"), (4.0, "c", None)], "x double, c string, d string")
    n = features.Normalize.fit(df, ["x"])
    assert sorted(r.x for r in n.undo(n.apply(df)).where("x is not null").collect()) == pytest.approx([0, 4, 10])
    d = features.Discretize.fit(df, ["x"], 4)
    assert [r.x for r in d.apply(df).collect()] == [0, 3, None, 1] and d.undo(d.apply(df)).first().x == 1.25
    h = features.OneHot.fit(df, ["c", "d"])
    out = h.apply(df)
    assert out.columns == ["x", "d", "c_a", "c_b", "c_c"] and [r.d for r in out.collect()] == [0, 1, 0, 0.5] and out.collect()[2].c_a == pytest.approx(1 / 3)
    assert [r.c for r in h.undo(out).collect()][:2] == ["a", "b"]


def test_generated(spark):
    for df in (generate.swiss_roll(spark, 50), generate.s_curve(spark, 50), generate.fish_bowl(spark, 50), generate.ribbon(spark, 50), generate.entwined_spirals(spark, 50), generate.laplace_points(spark, 50, 3), generate.correlated_gauss_points(spark, 50, 3, 0.9)):
        assert df.where(F.exists("point", lambda x: x.isNull() | F.isnan(x))).count() == 0 and df.count() == 50
    assert generate.unit_cube(spark, 3).count() == 26
    r = generate.noise(spark, 25_000, "gamma", 2.0, 3.0, seed=1).agg(F.count("*"), F.avg("value")).first()
    assert r[0] == 25_000 and abs(r[1] - 6) < 0.2
    assert generate.gauss_points(spark, 4000, 1, 2.0).agg(F.stddev(F.get("point", 0))).first()[0] == pytest.approx(2, rel=0.1)
    assert generate.grid_walk(spark, 3, 2, 40).where("x not between 0 and 2 or y not between 0 and 1").count() == 0


def test_queries_use_whole_embeddings(spark, tmp_path):
    """Only the last of 64 numbers tells the two halves apart."""
    from seqloom.plans import learning

    rows = [(i, [float(i * j % 3) / 10 for j in range(63)] + [50.0 * (i % 2)], i % 2) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    groups = {(r.vec_id % 2, r.cluster) for r in learning.kmeans(spark, str(tmp_path)).collect()}
    assert len({c for _, c in groups}) == len(groups) > 1
    assert min(r.score for r in learning.cross_validation(spark, str(tmp_path)).collect()) > 0.9


# streams ---------------------------------------------------------------------------------------------------------------------


def test_stream_and_table_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("button", F.col("event_type") == "click").select("user_id", "ts", "event_id", "button", "value")
    want = segments.segments(events, "user_id", "ts", "event_id", "button", "value")
    half = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    schema = events.schema
    for i, part in enumerate((events.where(F.col("event_id") <= half), events.where(F.col("event_id") > half))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = segments.segment_stream(stream, "user_id", "ts", "event_id", "button", "value")
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    show = lambda df: sorted((r.key, r.segment, r.n, round(r.total, 4)) for r in df.collect())
    assert show(spark.table("closed")) == show(want)


def test_stream_counts_long_segments(spark, tmp_path):
    n = 100_500
    events = spark.range(n + 2).select(F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.col("id").isin(0, n + 1).alias("button"), F.lit(1.0).alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = segments.segment_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "event_id", "button", "value")
    out.writeStream.format("memory").queryName("long_segments").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    want = segments.segments(events, "user_id", "ts", "event_id", "button", "value").collect()
    assert list(map(tuple, spark.table("long_segments").collect())) == list(map(tuple, want))
    assert want[0].n == n


def test_kalman(spark):
    df = spark.createDataFrame([(1, i, 5.0 + (-1) ** i) for i in range(60)], "k long, t long, z double")
    last = segments.kalman(df, "k", ["t"], "z", 1e-4, 1.0).orderBy(F.desc("t")).first()
    assert abs(last.estimate - 5) < 0.1 and last.variance < 0.1
    x, p = np.zeros(1), np.eye(1)
    for _ in range(30):
        x, p = segments.extended_kalman_step(x, p, None, [4.0], lambda s, c: s, lambda s, c: np.eye(1), lambda s: s * s, lambda s: np.array([[2 * s[0] + 1e-3]]), np.eye(1) * 0.1, np.eye(1))
    assert abs(abs(x[0]) - 2) < 0.05


def test_wrapping(spark):
    assert one(spark, text.wrapped(F.lit("aa bb  ccc dddddddd e"), 6)) == ["aa bb", "ccc", "dddddddd", "e"]
    assert one(spark, text.wrapped(F.lit(""), 6)) == []
