"""Queries of models on generated rows, with the accuracies that they must reach, and of transforms, increments and transduction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import clusters, features, generate, learners, models
from seqloom.operators import table as T
from seqloom.plans.catalog import query
from seqloom.session import table


def three_classes(spark, n: int = 2000):
    """Labels 0 to 2; two normal features, of which each is moved by 2 for one label."""
    label = F.floor(generate._unit(3, 0) * 3).cast("int")
    rows = spark.range(n).select(F.col("id").alias("_ord"), label.alias("label"), *(generate._normal(3, i).alias(f"z{i}") for i in (1, 2)))
    return rows.select("_ord", F.col("label").cast("string").alias("label"), *((F.col(f"z{i}") + 2 * (F.col("label") == i).cast("int")).alias(f"x{i}") for i in (1, 2)))


FLOORS = {"baseline": 0.31, "decision_tree": 0.64, "mean_margins": 0.65, "bucket": 0.66, "neighbors": 0.68, "naive_instance": 0.71, "bagging": 0.74, "naive_bayes": 0.76, "neural_net": 0.76, "kernel_machine": 0.76}


def _learners():
    bins = lambda df: features.Discretize.fit(df, ["x1", "x2"], 12)
    return {
        "baseline": models.Baseline(), "decision_tree": models.decision_tree(depth=5), "mean_margins": learners.MeanMarginsTree(), "bucket": models.Bucket([models.Baseline(), learners.NaiveInstance()]),
        "neighbors": models.NearestNeighbors(9), "naive_instance": learners.NaiveInstance(), "bagging": models.bagged_trees(trees=20, depth=5), "naive_bayes": learners.Filtered([bins], models.NaiveBayes()),
        "neural_net": models.neural_net((6,)), "kernel_machine": learners.KernelMachine(2.0, 60),
    }


@query("accuracy_floors", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', true, true)" for k in FLOORS) + ") t(learner, reaches_floor, below_ceiling)")
def accuracy_floors(spark, sf_dir):
    """Half of the rows to learn from, half to test; no learner can be right on more than nine in ten."""
    df = three_classes(spark).persist()
    train, test = df.where("_ord < 1000"), df.where("_ord >= 1000")
    rows = []
    for name, model in _learners().items():
        score = models.accuracy(model.fit(train, ["x1", "x2"], "label").predict(test), "label").first()[0]
        rows.append((name, score >= FLOORS[name], score < 0.9))
    df.unpersist()
    return spark.createDataFrame(rows, "learner string, reaches_floor boolean, below_ceiling boolean")


@query("instance_labels", """WITH c AS (SELECT l_linestatus AS s, l_linenumber AS i, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s, i ORDER BY n DESC, y) AS r FROM c)
SELECT l_orderkey, l_linenumber, y AS prediction FROM lineitem JOIN r ON s = l_linestatus AND i = l_linenumber AND r = 1""")
def instance_labels(spark, sf_dir):
    """Learned in two increments."""
    df = table(spark, sf_dir, "lineitem")
    names = ["l_linestatus", "l_linenumber"]
    model = learners.InstanceTable().fit(df.where("l_orderkey % 2 = 0"), names, "l_returnflag").increment(df.where("l_orderkey % 2 <> 0"))
    return model.predict(df).select("l_orderkey", "l_linenumber", "prediction")


@query("naive_bayes_increments", "SELECT 'lineitem' AS name, count(*) AS n, true AS same FROM lineitem")
def naive_bayes_increments(spark, sf_dir):
    """A model of increments is the model of all rows."""
    df, names = table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber"]
    grown = learners.increment_naive_bayes(models.NaiveBayes().fit(df.where("l_orderkey % 3 = 0"), names, "l_returnflag"), df.where("l_orderkey % 3 <> 0"), names, "l_returnflag")
    whole = models.NaiveBayes().fit(df, names, "l_returnflag")
    return df.agg(F.lit("lineitem").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(grown == whole).alias("same"))


@query("chained_transforms", "SELECT l_orderkey, l_linenumber, round(l_quantity, 5) AS l_quantity, round(l_discount, 5) AS l_discount FROM lineitem")
def chained_transforms(spark, sf_dir):
    """Scaled, turned onto their axes, and back."""
    df, names = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"]
    chain = learners.Chain([lambda x: features.Normalize.fit(x, names, -1.0, 1.0), lambda x: learners.Rotation.fit(x, names)]).fit(df)
    return chain.undo(chain.apply(df)).select("l_orderkey", "l_linenumber", *(F.round(c, 5).alias(c) for c in names))


@query("transduced_labels", "SELECT method, k::INT AS row, CASE WHEN k < 6 THEN 'a' ELSE 'b' END AS label FROM range(12) t(k), (VALUES ('agglomerative'), ('graph_cut')) m(method)")
def transduced_labels(spark, sf_dir):
    """Two rows of points with one label each."""
    points = np.array([[i % 6, 10.0 * (i // 6)] for i in range(12)], float)
    labels = ["a" if i == 2 else "b" if i == 9 else None for i in range(12)]
    found = {"agglomerative": learners.agglomerative_labels(points, labels), "graph_cut": learners.graph_cut_labels(points, labels, 3)}
    return spark.createDataFrame([(m, i, y) for m, ys in found.items() for i, y in enumerate(ys)], "method string, row int, label string")


@query("transduction", "SELECT true AS reaches_floor, '1' AS one FROM range(1)")
def transduction(spark, sf_dir):
    df = three_classes(spark)
    train, test = df.where("_ord < 1000"), df.where("_ord >= 1000")
    score = learners.transductive_accuracy(learners.NaiveInstance(), train, test, ["x1", "x2"], "label").first()[0]
    one = learners.predict_one(spark, learners.NaiveInstance().fit(train, ["x1", "x2"], "label"), {"x1": 3.0, "x2": 0.0})
    return spark.createDataFrame([(score >= 0.71, one)], "reaches_floor boolean, one string")


@query("local_search", "SELECT * FROM (VALUES ('ez_hybrid', true), ('hybrid', true), ('swap', true)) t(method, no_worse)")
def local_search(spark, sf_dir):
    """Swaps end with no more distortion than their start, and the hybrids with no more than Lloyd's algorithm from the same start."""
    df = generate.clustered_gauss_points(spark, 1000, 2, 5, 0.02, seed=4).coalesce(1).persist()
    start = clusters.distortion(df, "point", clusters.seeds(df, "point", 5, 0, "id")).first()[0]
    _, lloyd = clusters.kmeans(df, "point", 5, "id", rounds=20)
    stages = clusters.most_stages(1000, 5, 4.0)
    found = {"swap": (clusters.kmeans_swap(df, "point", 5, "id", swaps=4)[1], start), "hybrid": (clusters.kmeans_hybrid(df, "point", 5, "id", stages=stages)[1], lloyd), "ez_hybrid": (clusters.kmeans_ez_hybrid(df, "point", 5, "id", stages=stages)[1], lloyd)}
    df.unpersist()
    return spark.createDataFrame([(k, bool(loss <= most * (1 + 1e-9))) for k, (loss, most) in found.items()], "method string, no_worse boolean")


@query("more_points", "SELECT * FROM (VALUES ('correlated_laplace', 500, true), ('ellipsoids', 500, true), ('flats', 500, true), ('multi', 500, true)) t(name, n, holds)")
def more_points(spark, sf_dir):
    """Counts, and what holds for each: steps that follow each other, points near their flat or centre."""
    flats = generate.orthogonal_flats(spark, 500, 4, 3, 0.01, 2)
    made = {
        "correlated_laplace": generate.correlated_laplace_points(spark, 500, 3, 0.9).select(F.lit(True).alias("ok"), F.get("point", 0).alias("a"), F.get("point", 1).alias("b")),
        "ellipsoids": generate.ellipsoid_points(spark, 500, 3, 4, 0.05, 0.4, 1).select((F.size("point") == 3).alias("ok"), generate._unit(1, 1).alias("a"), generate._unit(1, 2).alias("b")),
        "flats": flats.select((F.size("point") == 4).alias("ok"), generate._unit(1, 1).alias("a"), generate._unit(1, 2).alias("b")), "multi": generate.multi_cluster_points(spark, 500, 2, 0.05).select((F.size("point") == 2).alias("ok"), generate._unit(1, 1).alias("a"), generate._unit(1, 2).alias("b")),
    }
    rows = []
    for name, df in made.items():
        n, ok, corr = df.agg(F.count(F.lit(1)), F.min("ok"), F.corr("a", "b")).first()
        rows.append((name, n, bool(ok and (name != "correlated_laplace" or corr > 0.6))))
    return spark.createDataFrame(rows, "name string, n int, holds boolean")


@query("generated_shapes", "SELECT * FROM (VALUES ('cube', 152, true), ('fish_bowl', 400, true), ('ribbon', 400, true), ('s_curve', 400, true), ('spirals', 400, true), ('swiss_roll', 400, true), ('walk', 400, true)) t(name, n, holds)")
def generated_shapes(spark, sf_dir):
    """Each shape's own equation holds for all its points."""
    x, y, z = (F.get("point", i) for i in range(3))
    close = lambda a, b: F.abs(a - b) < 1e-6
    made = {
        "swiss_roll": (generate.swiss_roll(spark, 400), (F.sqrt(x * x + z * z) > 0.39) & (y >= 0) & (y <= 5)), "s_curve": (generate.s_curve(spark, 400), close(x * x + (F.abs(z) - 1) * (F.abs(z) - 1), F.lit(1.0))),
        "fish_bowl": (generate.fish_bowl(spark, 400), close(x * x + y * y + z * z, F.lit(1.0)) & (z <= 0.5)), "spirals": (generate.entwined_spirals(spark, 400), F.sqrt(x * x + y * y) <= 4 * np.pi + 0.1),
        "ribbon": (generate.ribbon(spark, 400), (F.abs(x) <= 1) & (F.abs(y) <= 1) & (F.abs(x) <= 2 * F.abs(y) + 1e-9)), "cube": (generate.unit_cube(spark, 6), (x * (1 - x) < 1e-12) | (y * (1 - y) < 1e-12) | (z * (1 - z) < 1e-12)),
        "walk": (generate.grid_walk(spark, 7, 5, 400), (F.col("x").between(0, 6)) & F.col("y").between(0, 4)),
    }
    rows = [(name, *df.agg(F.count(F.lit(1)), F.min(holds)).first()) for name, (df, holds) in made.items()]
    return spark.createDataFrame(rows, "name string, n int, holds boolean")


@query("noise_shares", "SELECT * FROM (VALUES ('blank', true), ('like', true), ('normal', true), ('uniform', true)) t(name, holds)")
def noise_shares(spark, sf_dir):
    """Means of generated noise lie within five standard errors of what they should be."""
    n = 4000
    flat = generate.noise(spark, n, "uniform", 0.0, 1.0, seed=2).agg(F.avg("value")).first()[0]
    bell = generate.noise(spark, n, "normal", 3.0, 2.0, seed=2).agg(F.avg("value")).first()[0]
    base = spark.range(n).select(F.lit(1.0).alias("v"))
    blank = features.with_noise(base, ["v"], 0.5, 3).agg(F.avg("v")).first()[0]
    like = features.noise_like(base, {"v": (2.0, 1.0)}, 4).agg(F.avg("v")).first()[0]
    near = lambda x, mean, dev: bool(abs(x - mean) < 5 * dev / n**0.5)
    return spark.createDataFrame([("uniform", near(flat, 0.5, 0.29)), ("normal", near(bell, 3, 2)), ("blank", near(blank, 1, 0.5)), ("like", near(like, 2, 1))], "name string, holds boolean")


@query("shuffled_and_filled", """SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys, count(*) AS places, (count(*) - 1)::BIGINT AS last, 0::BIGINT AS missing, count(*) FILTER (c_custkey % 7 <> 0) AS kept, 0::BIGINT AS strange FROM customer""")
def shuffled_and_filled(spark, sf_dir):
    """Shuffling moves every row to a place of its own; missing cells take values of others, and known cells stay."""
    df = T.with_order(table(spark, sf_dir, "customer"), "c_custkey").select("_ord", "c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"))
    mixed = T.shuffle(df.select("_ord", "c_custkey"), 5).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.countDistinct("_ord").alias("places"), F.max("_ord").alias("last"))
    known = df.where("bal is not null").select(F.col("bal").alias("seen")).distinct()
    full = T.replace_missing(df, ["bal"], seed=4).join(known, F.col("bal") == F.col("seen"), "left")
    filled = full.agg(F.count_if(F.col("bal").isNull()).alias("missing"), F.count_if((F.col("c_custkey") % 7 != 0) & (F.col("bal") == F.col("c_acctbal"))).alias("kept"), F.count_if(F.col("seen").isNull()).alias("strange"))
    return mixed.crossJoin(filled)  # one row each


@query("changed_cells", "SELECT c_custkey, c_custkey % 5 AS c_nationkey, CASE WHEN r = 4 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal, 7 AS flag FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)")
def changed_cells(spark, sf_dir):
    """A column set from another table, a row replaced, a column set to one value."""
    df = T.with_order(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    df = T.set_column(df, "c_nationkey", df.select("_ord", (F.col("c_custkey") % 5).alias("v")))
    key = df.where("_ord = 3").first()
    df = T.replace_row(df, 3, {"c_custkey": key.c_custkey, "c_nationkey": key.c_nationkey, "c_acctbal": 0.0})
    return T.set_all(T.copied(df).withColumn("flag", F.lit(0)), 7, ["flag"]).drop("_ord")


@query("riffled_rows", "SELECT c_custkey, CASE WHEN r < (n + 1) // 2 THEN 2 * r ELSE 2 * (r - (n + 1) // 2) + 1 END AS _ord FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)")
def riffled_rows(spark, sf_dir):
    """Halves interleaved, as cards are."""
    return T.riffled(T.with_order(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"))
