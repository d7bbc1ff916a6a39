"""Queries that write a table in each file format and read it again, and those of neighbours in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import features, models, neighbors
from seqloom.plans.catalog import query
from seqloom.plans.learning import _COO, _PAIRS, _coo, _tracks
from seqloom.session import scratch, table
from seqloom.sources import gesture, tables


@query("arff_file", "SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey::DOUBLE END AS n_nationkey, n_name FROM nation")
def arff_file(spark, sf_dir):
    path = scratch(spark)
    tables.write_arff(table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey").cast("double")).alias("n_nationkey"), "n_name"), path, "nations")
    return tables.read_arff(spark, path)


@query("delimited_file", "SELECT c_custkey::DOUBLE AS attr0, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS attr1, c_name AS attr2 FROM customer")
def delimited_file(spark, sf_dir):
    path = scratch(spark)
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_name")
    tables.write_delimited(df, path, ";")
    return tables.read_delimited(spark, path, ";")


@query("sparse_file", _COO + 'SELECT "row", "col", val FROM m')
def sparse_file(spark, sf_dir):
    path = scratch(spark)
    tables.write_sparse(_coo(spark, sf_dir), path, 50, 40)
    return tables.read_sparse(spark, path)


@query("gesture_file", "SELECT event_type AS label, count(*) AS points, round(sum(value), 3) AS x, sum(hour(ts) + 1)::DOUBLE AS y FROM (SELECT e.*, f.event_type AS first FROM events e JOIN (SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) f USING (user_id)) t GROUP BY 1".replace("SELECT event_type AS label", "SELECT first AS label"))
def gesture_file(spark, sf_dir):
    path = scratch(spark)
    points = _tracks(spark, sf_dir).select("seq_id", "label", F.posexplode("points").alias("pos", "point"))
    gesture.write_gestures(points, path)
    back = gesture.read_gestures(spark, path)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum(F.get("point", 0)), 3).alias("x"), F.sum(F.get("point", 1)).alias("y"))


@query("model_text", "SELECT * FROM (VALUES ('emission', 0.5::DOUBLE), ('initial', 0.6), ('symbols', 6.0), ('transition', 0.7)) t(part, first)")
def model_text(spark, sf_dir):
    """A hidden Markov model and a sequence as text and back."""
    back = tables.read_hmm(tables.write_hmm({"initial": [0.6, 0.4], "transition": [[0.7, 0.3], [0.4, 0.6]], "emission": [[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]]}))
    symbols = tables.read_symbols(tables.write_symbols([1, 2, 3]))
    rows = [("initial", back["initial"][0]), ("transition", back["transition"][0][0]), ("emission", back["emission"][0][0]), ("symbols", float(sum(symbols)))]
    return spark.createDataFrame(rows, "part string, first double")


@query("term_columns", """WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 4 AND term NOT IN ("""
       + ", ".join(f"'{w}'" for w in features.STOP_WORDS) + """) GROUP BY 1, 2) SELECT doc_id AS "row", dense_rank() OVER (ORDER BY term) - 1 AS "col", 1.0::DOUBLE AS val FROM c""")
def term_columns(spark, sf_dir):
    return features.term_matrix(table(spark, sf_dir, "documents"), "doc_id", "text", stemming=False, binary=True)


@query("running_scores", "SELECT event_id, round(avg((event_type = 'view')::INT) OVER (ORDER BY ts, event_id), 9) AS score FROM events")
def running_scores(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("prediction", F.lit("view"))
    return models.running_mean_score(df, ["ts", "event_id"], "event_type").select("event_id", F.round("score", 9).alias("score"))


@query("neighbors_in_time", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), p AS (SELECT q.vec_id AS query, o.vec_id AS neighbor, q.label = o.label AS same, list_sum(list_transform(range(1, len(q.a) + 1), lambda i: (q.a[i] - o.a[i]) * (q.a[i] - o.a[i]))) AS d2
FROM e q JOIN e o ON o.vec_id BETWEEN q.vec_id - 6 AND q.vec_id + 6 AND o.vec_id <> q.vec_id), r AS (SELECT 'temporal' AS kind, *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbor) AS rank FROM p UNION ALL SELECT 'dynamic', *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbor) FROM p WHERE same)
SELECT kind, query, rank, neighbor, round(d2, 6) AS d2 FROM r WHERE rank <= 3""")
def neighbors_in_time(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    both = {"temporal": neighbors.temporal(df, "vec_id", "embedding", 6, 3), "dynamic": neighbors.dynamic(df, "vec_id", "embedding", "label", 3, 6)}
    a, b = (x.select(F.lit(k).alias("kind"), "query", F.col("rank").cast("long").alias("rank"), "neighbor", F.round("d2", 6).alias("d2")) for k, x in both.items())
    return a.unionByName(b)


@query("scaled_distances", _PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbor) AS k FROM p), n AS (SELECT query, neighbor, sqrt(d2) AS d FROM r WHERE k <= 4), m AS (SELECT query, avg(d) AS m FROM n GROUP BY 1)
SELECT n.query, neighbor, round(2 * d / (m.m + coalesce(o.m, m.m)), 6) AS distance FROM n JOIN m ON m.query = n.query LEFT JOIN m o ON o.query = n.neighbor""")
def scaled_distances(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    near = neighbors.nearest(df.where("vec_id % 20 = 0"), df, 4)
    return neighbors.scaled_by_local_mean(near).withColumn("distance", F.round("distance", 6))
