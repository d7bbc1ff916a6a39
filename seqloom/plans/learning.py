"""Queries of features, matrices, neighbours, clusters, graphs, sequences and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import clusters, features, generate, graphs, matrix, models, neighbors, sequences
from seqloom.plans.catalog import query
from seqloom.session import table

COLS = ["l_quantity", "l_discount", "l_tax"]


@query("normalize", "WITH s AS (SELECT " + ", ".join(f"min({c}) - 0.5 * ((max({c}) - min({c})) * (count(*) + 1) / (count(*) - 1) - (max({c}) - min({c}))) AS lo_{c}, max({c}) - min({c}) + 0.5 * ((max({c}) - min({c})) * (count(*) + 1) / (count(*) - 1) - (max({c}) - min({c}))) AS w_{c}" for c in COLS)
       + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - lo_{c}) / w_{c} * 2 - 1, 6) AS {c}" for c in COLS) + " FROM lineitem, s")
def normalize(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return features.Normalize.fit(df, COLS, -1.0, 1.0).apply(df).select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in COLS))


@query("discretize", "WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) - min(l_extendedprice) AS w FROM lineitem) SELECT l_orderkey, l_linenumber, greatest(0, least(9, floor((l_extendedprice - lo) * 10 / w)))::INT AS bucket FROM lineitem, s")
def discretize(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return features.Discretize.fit(df, ["l_extendedprice"], 10).apply(df).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("bucket"))


@query("one_hot", "SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT::DOUBLE AS l_returnflag_A, (l_returnflag = 'N')::INT::DOUBLE AS l_returnflag_N, (l_returnflag = 'R')::INT::DOUBLE AS l_returnflag_R, (l_linestatus = 'O')::INT::DOUBLE AS l_linestatus FROM lineitem")
def one_hot(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return features.OneHot.fit(df, ["l_returnflag", "l_linestatus"]).apply(df)


@query("pair_products", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS a, round(l_quantity * l_tax, 6) AS b, round(l_discount * l_tax, 6) AS c FROM lineitem")
def pair_products(spark, sf_dir):
    df = features.pair_products(table(spark, sf_dir, "lineitem"), COLS)
    return df.select("l_orderkey", "l_linenumber", F.round("`l_quantity*l_discount`", 6).alias("a"), F.round("`l_quantity*l_tax`", 6).alias("b"), F.round("`l_discount*l_tax`", 6).alias("c"))


@query("term_weights", """WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 4 AND term NOT IN ("""
       + ", ".join(f"'{w}'" for w in features.STOP_WORDS) + """) GROUP BY 1, 2), t AS (SELECT term, count(*) AS df, max(tf) AS most FROM c GROUP BY 1)
SELECT doc_id, c.term, tf, round(tf * ln((SELECT count(DISTINCT doc_id) FROM documents)::DOUBLE / df) / most, 6) AS weight FROM c JOIN t ON c.term = t.term""")
def term_weights(spark, sf_dir):
    return features.term_weights(table(spark, sf_dir, "documents"), "doc_id", "text", stemming=False).withColumn("weight", F.round("weight", 6))


@query("stemmed_terms")
def stemmed_terms(spark, sf_dir):
    return features.term_matrix(table(spark, sf_dir, "documents"), "doc_id", "text")


def _coo(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.groupBy((F.col("l_suppkey") % 50).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col")).agg(F.sum("l_linenumber").cast("double").alias("val"))


_COO = "WITH m AS (SELECT (l_suppkey % 50)::INT AS \"row\", (l_partkey % 40)::INT AS \"col\", sum(l_linenumber)::DOUBLE AS val FROM lineitem GROUP BY 1, 2) "


@query("matrix_multiply", _COO + 'SELECT a."row", b."row" AS "col", sum(a.val * b.val) AS val FROM m a JOIN m b ON a."col" = b."col" GROUP BY 1, 2')
def matrix_multiply(spark, sf_dir):
    m = _coo(spark, sf_dir)
    return matrix.multiply(m, m, transpose_b=True)


@query("matrix_add", _COO + 'SELECT "row", "col", sum(val) AS val FROM (SELECT "row", "col", val FROM m UNION ALL SELECT "col", "row", val FROM m) GROUP BY 1, 2')
def matrix_add(spark, sf_dir):
    m = _coo(spark, sf_dir)
    return matrix.add(m, matrix.transpose(m))


@query("matrix_trace", _COO + 'SELECT sum(val) AS trace FROM m WHERE "row" = "col"')
def matrix_trace(spark, sf_dir):
    return matrix.trace(_coo(spark, sf_dir))


@query("matrix_norm", _COO + "SELECT sum(val * val) AS norm2 FROM m")
def matrix_norm(spark, sf_dir):
    return matrix.squared_norm(_coo(spark, sf_dir))


@query("sub_matrix", _COO + 'SELECT "row" - 5 AS "row", "col" - 3 AS "col", val FROM m WHERE "row" BETWEEN 5 AND 14 AND "col" BETWEEN 3 AND 10')
def sub_matrix(spark, sf_dir):
    return matrix.sub_matrix(_coo(spark, sf_dir), 5, 3, 10, 8)


@query("singular_values")
def singular_values(spark, sf_dir):
    _, s, _ = matrix.svd(matrix.dense(_coo(spark, sf_dir)))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "i int, value double")


@query("principal_components")
def principal_components(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    mean, basis, _ = matrix.principal_components(df, COLS, 2)
    return matrix.projected(df, COLS, mean, basis).select("l_orderkey", "l_linenumber", "pc0", "pc1")


def _queries(df):
    return df.where(F.col("vec_id") % 20 == 0)


_PAIRS = """WITH p AS (SELECT q.vec_id AS query, e.vec_id AS neighbor, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE))) AS d2
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)"""


@query("nearest_neighbors", _PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbor) AS rank FROM p) SELECT query, rank, neighbor, round(d2, 6) AS d2 FROM r WHERE rank <= 5")
def nearest_neighbors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return neighbors.nearest(_queries(df), df, 5).withColumn("d2", F.round("d2", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("fixed_radius", _PAIRS + "SELECT query, count(*) AS n FROM p WHERE d2 <= 1.69 GROUP BY 1")
def fixed_radius(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return neighbors.counted_within(_queries(df), df, 1.3)


@query("neighbor_vote", _PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbor) AS rank FROM p), v AS (SELECT query, label, count(*) AS n FROM r JOIN embeddings ON vec_id = neighbor WHERE rank <= 5 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS k FROM v) SELECT query, label AS prediction FROM o WHERE k = 1""")
def neighbor_vote(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return neighbors.vote(neighbors.nearest(_queries(df), df, 5), df.select(F.col("vec_id").alias("neighbor"), "label"))


@query("sequence_neighbors", "SELECT a.event_id AS query, b.event_id AS neighbor, abs(a.event_id - b.event_id)::INT AS distance FROM events a JOIN events b ON b.event_id BETWEEN a.event_id - 2 AND a.event_id + 2 AND a.event_id <> b.event_id")
def sequence_neighbors(spark, sf_dir):
    return neighbors.sequence_neighbors(table(spark, sf_dir, "events"), "event_id", 2)


@query("kmeans")
def kmeans(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    centres, _ = clusters.kmeans(df, "v", 4, "vec_id")
    return clusters.assigned(df, "v", centres).select("vec_id", "cluster")


@query("gaussian_mixture")
def gaussian_mixture(spark, sf_dir):
    parts = clusters.gaussian_mixture(table(spark, sf_dir, "events"), "value", 2, rounds=10)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(parts)], "i int, weight double, mean double, variance double")


@query("components", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 7 AS a, 100 + l_suppkey % 7 AS b FROM lineitem) SELECT a AS node, a AS component FROM e UNION ALL SELECT b, a FROM e")
def components(spark, sf_dir):
    k = F.col("l_suppkey") % 7
    return graphs.components(table(spark, sf_dir, "lineitem").select(k.alias("src"), (k + 100).alias("dst")).distinct())


@query("shortest_paths")
def shortest_paths(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edges = li.groupBy((F.col("l_suppkey") % 30).alias("src"), (F.col("l_partkey") % 30).alias("dst")).agg(F.min("l_discount").alias("cost"))
    return graphs.shortest_paths(edges, 1)


@query("naive_bayes_counts", "SELECT l_returnflag AS label, feature, value, count(*) AS n FROM (SELECT l_returnflag, 'l_linestatus' AS feature, l_linestatus AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_linenumber', l_linenumber::VARCHAR FROM lineitem) GROUP BY 1, 2, 3")
def naive_bayes_counts(spark, sf_dir):
    return models.NaiveBayes.counts(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag")


@query("naive_bayes")
def naive_bayes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return models.NaiveBayes().fit(df, ["l_linestatus", "l_linenumber"], "l_returnflag").predict(df).groupBy("l_returnflag", "prediction").count()


@query("fold_assignment", "SELECT vec_id, (vec_id % 4)::INT AS fold FROM embeddings")
def fold_assignment(spark, sf_dir):
    return models.folds(table(spark, sf_dir, "embeddings"), 4, "vec_id").select("vec_id", "fold")


@query("cross_validation")
def cross_validation(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    names = [f"x{i}" for i in range(df.agg(F.max(F.size("embedding"))).first()[0])]
    df = df.select("vec_id", "label", *(F.get("embedding", i).alias(x) for i, x in enumerate(names)))
    return models.cross_validate(models.MixtureByClass(), df, names, "label", 3, key="vec_id")


@query("precision_curve", """WITH r AS (SELECT event_id, event_type = 'click' AS pos, row_number() OVER w AS seen, sum((event_type = 'click')::INT) OVER w AS recalled FROM events WINDOW w AS (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, recalled::BIGINT AS recalled, round(recalled / seen, 6) AS precision FROM r WHERE pos""")
def precision_curve(spark, sf_dir):
    from seqloom.operators.aggregate import precision_curve as curve

    return curve(table(spark, sf_dir, "events").withColumn("pos", F.col("event_type") == "click"), "value", "pos", "event_id").withColumn("precision", F.round("precision", 6))


def _symbols(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", kind.alias("s")))).alias("e"))
    return df.select("user_id", F.transform("e", lambda x: x["s"]).alias("symbols"))


_MODEL = ([0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])


@query("hmm_scores")
def hmm_scores(spark, sf_dir):
    m = sequences.HiddenMarkovModel(*_MODEL)
    return _symbols(spark, sf_dir).select("user_id", m.score(F.col("symbols")).alias("log_likelihood"), m.decode(F.col("symbols")).alias("path"))


@query("hmm_training")
def hmm_training(spark, sf_dir):
    m = sequences.HiddenMarkovModel(*_MODEL).trained(_symbols(spark, sf_dir), "symbols", passes=4)
    return spark.createDataFrame([(i, [float(x) for x in m.transition[i]], [float(x) for x in m.emission[i]]) for i in range(2)], "state int, transition array<double>, emission array<double>")


def _tracks(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seq_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.array("value", F.hour("ts") + F.lit(1.0), F.lit(3.0)).alias("p")))).alias("e"), F.min_by("event_type", F.struct("ts", "event_id")).alias("label"))
    return df.select("seq_id", "label", F.transform("e", lambda x: x["p"]).alias("points"))


@query("recognise_sequences")
def recognise_sequences(spark, sf_dir):
    df = _tracks(spark, sf_dir)
    return sequences.recognise(df.where("seq_id % 20 = 0"), df, 3)


@query("thinned_sequences")
def thinned_sequences(spark, sf_dir):
    p = sequences.thinned(F.col("points"), 2.0)
    return _tracks(spark, sf_dir).select("seq_id", F.size(p).alias("n"), sequences.resampled_sequence(p, 5).alias("five"))


@query("generated_points")
def generated_points(spark, sf_dir):
    return generate.swiss_roll(spark, 1000).unionByName(generate.s_curve(spark, 1000)).unionByName(generate.fish_bowl(spark, 1000))
