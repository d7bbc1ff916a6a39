"""Nearest neighbours and fixed-radius searches of a query set against all rows.

Queries are cut into blocks of bounded size; each block meets all rows in one pass that keeps the best k of every partition in numpy, a slice of the queries
and of a batch at a time, and the partitions' best are merged by the group. Rows are never paired with each other as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.vectors import squared_distance


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


_QUERIES, _ROWS, _PAIRS = 512, 2048, 16_384  # queries and rows that meet at once, and pairs measured at once


def _parts(batches, own: np.ndarray, x: np.ndarray, exclude_self: bool):
    """Slices of the queries, each with ids and vectors of some rows, estimates of d2 and bounds of their errors; inf for a query itself."""
    norm = (x * x).sum(1)
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            at, data = np.asarray(part.column(0)), _matrix(part.column(1))
            square = (data * data).sum(1)
            for low in range(0, len(own), _QUERIES):
                q = slice(low, low + _QUERIES)
                near = x[q] @ data.T
                near *= -2
                near += norm[q, None]
                near += square
                slack = 1e-12 + 1e-14 * (x.shape[1] + 8) * (norm[q] + square.max())
                if exclude_self:
                    near[own[q, None] == at] = np.inf
                yield q, at, data, near, slack


def _exact(x: np.ndarray, i: np.ndarray, data: np.ndarray, j: np.ndarray) -> np.ndarray:
    cut = range(0, len(i), _PAIRS)
    return np.concatenate([((x[i[s : s + _PAIRS]] - data[j[s : s + _PAIRS]]) ** 2).sum(1) for s in cut] or [np.zeros(0)])


def _found(query: np.ndarray, neighbor: np.ndarray, d2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(neighbor), pa.array(d2)], names=["query", "neighbor", "d2"])


def _nearest_of(batches, own, x, k, exclude_self):
    """The best k of a partition for each query, ties to the smaller id. What is held grows with the queries of the block only."""
    best = {}  # by slice: places of queries, ids and d2, in order; and the k-th d2 of each query
    for q, at, data, near, slack in _parts(batches, own, x, exclude_self):
        i0, id0, d0, kth = best.get(q.start) or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(near), np.inf))
        if near.shape[1] > k:  # estimates bound what can be among the best
            kth = np.minimum(kth, np.partition(near, k - 1, axis=1)[:, k - 1] + slack) if np.isinf(kth).any() else kth
        i, j = np.nonzero((near <= (kth + slack)[:, None]) & (near < np.inf))
        if not len(i):
            continue
        d = _exact(x[q], i, data, j)
        i, ids, d = np.concatenate([i0, i]), np.concatenate([id0, at[j]]), np.concatenate([d0, d])
        order = np.lexsort((ids, d, i))
        i, ids, d = i[order], ids[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kth = np.full(len(near), np.inf)
        kth[i[place == k - 1]] = d[place == k - 1]
        keep = place < k
        best[q.start] = i[keep], ids[keep], d[keep], kth
    for start, (i, ids, d, _) in best.items():
        yield _found(own[start + i], ids, d)


def _within_of(batches, own, x, radius2, exclude_self):
    for q, at, data, near, slack in _parts(batches, own, x, exclude_self):
        i, j = np.nonzero(near <= (radius2 + slack)[:, None])
        for s in range(0, len(i), _PAIRS):
            a, b = i[s : s + _PAIRS], j[s : s + _PAIRS]
            d = _exact(x[q], a, data, b)
            keep = d <= radius2
            yield _found(own[q][a[keep]], at[b[keep]], d[keep])


def _count_of(batches, own, x, radius2, exclude_self):
    """As _within_of, counted: only pairs whose estimates don't decide are measured."""
    n = np.zeros(len(own), np.int64)
    for q, _, data, near, slack in _parts(batches, own, x, exclude_self):
        sure = near <= (radius2 - slack)[:, None]
        i, j = np.nonzero((near <= (radius2 + slack)[:, None]) & ~sure)
        n[q] += sure.sum(1) + np.bincount(i[_exact(x[q], i, data, j) <= radius2], minlength=len(near))
    yield pa.RecordBatch.from_arrays([pa.array(own[n > 0]), pa.array(n[n > 0])], names=["query", "n"])


def _search(rows: DataFrame, ids: np.ndarray, q: np.ndarray, id_col: str, vector: str, of, bound, exclude_self: bool, schema: str) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((ids, q))  # one block

    def run(batches):
        yield from of(batches, *held.value, bound, exclude_self)

    slim = rows.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>"))
    return slim.mapInArrow(run, schema)


def _blocks(queries: DataFrame, id_col: str, vector: str, block: int):
    """The query set in blocks, streamed to the driver one at a time."""
    ids, vs = [], []
    for r in queries.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>")).toLocalIterator():
        ids.append(r[0])
        vs.append(r[1])
        if len(ids) == block:
            yield np.array(ids), np.array(vs)
            ids, vs = [], []
    if ids:
        yield np.array(ids), np.array(vs)


def _all(queries, rows, id_col, vector, of, bound, exclude_self, block, schema="query long, neighbor long, d2 double"):
    out = None
    for ids, q in _blocks(queries, id_col, vector, block):
        part = _search(rows, ids, q, id_col, vector, of, bound, exclude_self, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, block: int = 4096) -> DataFrame:
    """query, rank (from 1), neighbor, d2: the k nearest, exactly; ties by the smaller id."""
    found = _all(queries, rows, id_col, vector, _nearest_of, k, exclude_self, block)
    w = Window.partitionBy("query").orderBy("d2", "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbor", "d2")


def within(queries: DataFrame, rows: DataFrame, radius: float, id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, block: int = 4096) -> DataFrame:
    """query, neighbor, d2 of all within radius."""
    return _all(queries, rows, id_col, vector, _within_of, radius * radius, exclude_self, block)


def counted_within(queries: DataFrame, rows: DataFrame, radius: float, id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, block: int = 4096) -> DataFrame:
    """query, n: how many rows are within radius, for queries that have any. No pair leaves Python."""
    found = _all(queries, rows, id_col, vector, _count_of, radius * radius, exclude_self, block, "query long, n long")
    return found.groupBy("query").agg(F.sum("n").alias("n"))


def approximate(queries: DataFrame, rows: DataFrame, k: int, eps: float, **options) -> DataFrame:
    """Neighbours whose distances are at most 1 + eps times the exact ones; the exact search meets that for every eps."""
    if eps < 0:
        raise ValueError("eps must not be negative")
    return nearest(queries, rows, k, **options)


def vote(neighbors: DataFrame, labels: DataFrame, label: str = "label", weighted: bool = False) -> DataFrame:
    """query, prediction: the most frequent label, or that of the largest sum of 1 / d2; ties to the least label. labels: neighbor and label."""
    w = F.sum(1 / F.greatest(F.col("d2"), F.lit(1e-12))) if weighted else F.count(F.lit(1)).cast("double")
    counts = neighbors.join(labels, "neighbor").groupBy("query", label).agg(w.alias("w"))
    return counts.groupBy("query").agg(F.min(F.struct((-F.col("w")).alias("a"), F.col(label).alias("b")))["b"].alias("prediction"))


def interpolated(neighbors: DataFrame, values: DataFrame, value: str, weighted: bool = True) -> DataFrame:
    """query, prediction: the mean of the neighbours' values, weighted by 1 / distance."""
    w = 1 / F.greatest(F.sqrt("d2"), F.lit(1e-9)) if weighted else F.lit(1.0)
    return neighbors.join(values, "neighbor").groupBy("query").agg((F.sum(F.col(value) * w) / F.sum(w)).alias("prediction"))


def sequence_neighbors(df: DataFrame, order: str, m: int) -> DataFrame:
    """query, neighbor, distance: rows at most m places before or after, by place; each row is repeated 2 m times and met by an equi join."""
    steps = F.array(*(F.lit(s) for s in [*range(-m, 0), *range(1, m + 1)]))
    a = df.select(F.col(order).alias("query"), F.explode(steps).alias("s")).withColumn("neighbor", F.col("query") + F.col("s"))
    return a.join(df.select(F.col(order).alias("neighbor")), "neighbor").select("query", "neighbor", F.abs("s").alias("distance"))


def temporal(df: DataFrame, order: str, vector: str, span: int, k: int) -> DataFrame:
    """query, rank, neighbor, d2: of the rows at most span places away, by place, the k nearest; ties by the smaller number."""
    pairs = sequence_neighbors(df, order, span).select("query", "neighbor")
    a, b = (df.select(F.col(order).alias(n), F.col(vector).cast("array<double>").alias(v)) for n, v in (("query", "_a"), ("neighbor", "_b")))
    near = pairs.join(a, "query").join(b, "neighbor").withColumn("d2", squared_distance(F.col("_a"), F.col("_b")))
    w = Window.partitionBy("query").orderBy("d2", "neighbor")  # 2 span rows
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbor", "d2")


def dynamic(df: DataFrame, order: str, vector: str, action: str, k: int, span: int) -> DataFrame:
    """The same among rows with the query's own action: neighbours by state in a system that is driven."""
    pairs = sequence_neighbors(df, order, span).select("query", "neighbor")
    a, b = (df.select(F.col(order).alias(n), F.col(vector).cast("array<double>").alias(v), F.col(action).alias(f"{v}_act")) for n, v in (("query", "_a"), ("neighbor", "_b")))
    near = pairs.join(a, "query").join(b, "neighbor").where("_a_act <=> _b_act").withColumn("d2", squared_distance(F.col("_a"), F.col("_b")))
    w = Window.partitionBy("query").orderBy("d2", "neighbor")  # 2 span rows
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbor", "d2")


def scaled_by_local_mean(edges: DataFrame) -> DataFrame:
    """Distances divided by the mean of both ends' mean distances."""
    own = edges.groupBy("query").agg(F.avg(F.sqrt("d2")).alias("m"))
    other = own.select(F.col("query").alias("neighbor"), F.col("m").alias("mn"))
    joined = edges.join(own, "query").join(other, "neighbor", "left")
    return joined.select("query", "neighbor", (2 * F.sqrt("d2") / (F.col("m") + F.coalesce("mn", "m"))).alias("distance"))


def patched(edges: DataFrame, k: int) -> DataFrame:
    """Missing places up to k filled with neighbours of neighbours, nearest sums first."""
    short = edges.groupBy("query").count().where(F.col("count") < k).select("query", (F.lit(k) - F.col("count")).alias("need"))
    via = edges.select(F.col("query").alias("mid"), F.col("neighbor").alias("far"), F.sqrt("d2").alias("d_far"))
    two = edges.join(short, "query").join(via, F.col("neighbor") == F.col("mid")).where("far <> query").groupBy("query", "need", "far").agg(F.min(F.sqrt("d2") + F.col("d_far")).alias("d"))
    new = two.join(edges.select("query", F.col("neighbor").alias("far")), ["query", "far"], "left_anti")
    new = new.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "far"))).where("r <= need")
    return edges.select("query", "neighbor", "d2").unionByName(new.select("query", F.col("far").alias("neighbor"), (F.col("d") * F.col("d")).alias("d2")))
