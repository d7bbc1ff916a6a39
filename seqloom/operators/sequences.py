"""Sequences of points and symbols: thinning, resampling, alignment similarity, recognition, and hidden Markov models."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from seqloom.functions.vectors import cosine, l_inf
from seqloom.session import stored as _kept


def thinned(points: Column, least: float = 2.0) -> Column:
    """A sequence without points whose largest coordinate difference to the last one kept is below least; the first is kept."""
    start = F.array().cast("array<array<double>>")
    return F.aggregate(points, start, lambda kept, p: F.when((F.size(kept) == 0) | (l_inf(F.element_at(kept, -1), p) >= least), F.concat(kept, F.array(p))).otherwise(kept))


def resampled_sequence(points: Column, n: int) -> Column:
    """n points at even places, repeating or skipping; evenly and not at random."""
    size = F.size(points)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(points, F.floor(i * size / F.lit(n)).cast("int")))


def common_prefix_l1(a: Column, b: Column) -> Column:
    """The sum of cosines over the common length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), cosine), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def common_prefix_l2(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), cosine), F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0))))


def local_alignment(a, b, gap: float = 4.7) -> float:
    """The best local alignment of two sequences of points, of cosines less gaps. Anti-diagonals are computed at once."""
    x, y = np.asarray([list(p) for p in a], float), np.asarray([list(p) for p in b], float)
    if not len(x) or not len(y):
        return 0.0
    with np.errstate(invalid="ignore", divide="ignore"):
        match = np.nan_to_num((x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :])
    n, m = match.shape
    score, best = np.zeros((n + 1, m + 1)), 0.0
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        cell = np.maximum(0.0, np.maximum(score[i, j] + match[i, j], np.maximum(score[i, j + 1], score[i + 1, j]) - gap))
        score[i + 1, j + 1] = cell
        best = max(best, float(cell.max()))
    return best


def _together(longest: int) -> int:
    """How many sequences are aligned at once: one anti-diagonal of all holds 65,536 cells or one sequence."""
    return max(1, min(512, (1 << 16) // max(1, longest)))


def _unit(p: np.ndarray) -> np.ndarray:
    """Points divided by their lengths; those without one, or with an unknown coordinate, are 0 and match nothing."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(p / np.linalg.norm(p, axis=-1, keepdims=True))


def _alignments(x: np.ndarray, y: np.ndarray, gap: float) -> np.ndarray:
    """The best local alignments of x (n, c) with each of y (c, m, B), unit points; ends of y filled with 0 add nothing. An anti-diagonal of all B at once.
    In the type of x. A result doesn't depend on what else is in the batch."""
    n, (dims, m, b) = len(x), y.shape
    before, last, best = np.zeros((n + 1, b), x.dtype), np.zeros((n + 1, b), x.dtype), np.zeros((n, b), x.dtype)
    spare, side = np.zeros((n + 1, b), x.dtype), np.empty((n, b), x.dtype)
    gap = x.dtype.type(gap)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        cell, near = spare[lo + 1 : hi + 1], side[lo:hi]
        rows = y[:, d - hi + 1 : d - lo + 1][:, ::-1]
        np.multiply(x[lo:hi, 0, None], rows[0], out=cell)
        for c in range(1, dims):
            cell += x[lo:hi, c, None] * rows[c]
        cell += before[lo:hi]
        np.maximum(last[lo:hi], last[lo + 1 : hi + 1], out=near)
        near -= gap
        np.maximum(cell, near, out=cell)
        np.maximum(cell, 0, out=cell)
        np.maximum(best[lo:hi], cell, out=best[lo:hi])
        if lo:
            spare[lo] = 0
        before, last, spare = last, spare, before
    return best.max(0)


def _filled(seqs: list[np.ndarray], dtype) -> np.ndarray:
    """Sequences of unit points as (c, m, B), ends filled with 0."""
    out = np.zeros((max(p.shape[1] for p in seqs), max(map(len, seqs)), len(seqs)), dtype)
    for i, p in enumerate(seqs):
        out[:, : len(p), i] = p.T
    return out


def _sequences(column: pa.Array) -> list[np.ndarray]:
    out = []
    for p in column:
        p = p.values
        flat = p.flatten().to_numpy(zero_copy_only=False).astype(float) if p is not None and len(p) else np.zeros(0)
        out.append(_unit(flat.reshape(len(p), -1)) if len(flat) else np.zeros((0, 1)))
    return out


class _Best:
    """What may be among a query's k best of a partition: estimates with bounds of their errors, measured when they are many and at the end."""

    def __init__(self, points: np.ndarray, k: int, gap: float):
        self.points, self.small, self.k, self.gap, self.held, self.least, self.exact = points, points.astype(np.float32), k, gap, [], -np.inf, {}

    def add(self, found: list) -> None:
        """found: (at least, at most, seq_id, label, points)."""
        self.held += found
        if len(self.held) > 8 * self.k + 8:
            self.prune()
        elif len(self.held) >= self.k:
            self.bound()

    def bound(self) -> None:
        if len(self.held) >= self.k:
            self.least = sorted((h[0] for h in self.held), reverse=True)[self.k - 1]
            self.held = [h for h in self.held if h[1] >= self.least]

    def prune(self) -> list:
        self.bound()
        open_ = sorted((h for h in self.held if h[0] < h[1]), key=lambda h: len(h[4]))
        done = [h for h in self.held if h[0] == h[1]]
        size = _together(max((len(h[4]) for h in open_), default=1))
        for s in range(0, len(open_), size):
            part = open_[s : s + size]
            done += [(v, v, *h[2:]) for v, h in zip(_alignments(self.points, _filled([h[4] for h in part], float), self.gap).tolist(), part, strict=True)]
        self.held = sorted(done, key=lambda h: (-h[0], h[2]))[: self.k]
        self.least = self.held[-1][0] if len(self.held) >= self.k else -np.inf
        return self.held


def _aligned(stored: DataFrame, asked: list, k: int, gap: float) -> DataFrame:
    held = stored.sparkSession.sparkContext.broadcast(asked)  # one block

    def run(batches):
        best = {}
        for q, points in held.value:
            best[q] = _Best(_unit(np.array([list(p) for p in points], float)) if points is not None and len(points) else np.zeros((0, 1)), k, gap)
        for batch in batches:
            ids, labels, seqs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sequences(batch.column(2))
            order, at = sorted(range(len(ids)), key=lambda i: -len(seqs[i])), 0  # the longest can score most
            while at < len(order):
                longest = len(seqs[order[at]])
                part = order[at : at + _together(longest)]
                at += len(part)
                y = _filled([seqs[i] for i in part], np.float32) if longest else None
                for q, b in best.items():
                    n = len(b.points)
                    most = min(n, longest) * (1 + 1e-12)  # a match adds 1 at most
                    if b.least > most:
                        continue
                    if y is None or not n:
                        b.add([(0.0, 0.0, ids[i], labels[i], seqs[i]) for i in part if ids[i] != q])
                        continue
                    score = _alignments(b.small, y, gap)
                    slack = 2.4e-7 * (n + longest + 8) * (min(n, longest) + abs(gap) + 1)
                    b.add([(float(score[c]) - slack, float(score[c]) + slack, ids[i], labels[i], seqs[i]) for c in np.flatnonzero(score >= b.least - slack) for i in [part[c]] if ids[i] != q])
        rows = [(q, h[2], h[3], h[0]) for q, b in best.items() for h in b.prune()]
        for s in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 10_000], strict=True), (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["query", "seq_id", "label", "score"])

    slim = stored.select(F.col("seq_id").cast("long"), F.col("label").cast("string"), "points")
    return slim.mapInArrow(run, "query long, seq_id long, label string, score double")


def _asked(queries: DataFrame, block: int):
    """The query set in blocks, streamed to the driver one at a time."""
    held = []
    for r in queries.select("seq_id", "points").toLocalIterator():
        held.append((r.seq_id, r.points))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def recognise(queries: DataFrame, stored: DataFrame, k: int = 5, gap: float = 4.7, block: int = 1024) -> DataFrame:
    """query, prediction: the label that most of the k best-aligned stored sequences have, ties to the least label. Both have seq_id, label and points; a stored
    sequence of a query's own seq_id is left out. Stored sequences are the large side, spread evenly and made once; queries, a stated set, go to each of their
    partitions in blocks. Sequences are aligned in batches, the longest first, in float32 with a bound of the error; what may be among the best is measured."""
    if gap < 0:
        raise ValueError("gap must not be negative")
    found = None
    stored = _kept(stored.select("seq_id", "label", "points").repartition(2 * stored.sparkSession.sparkContext.defaultParallelism))
    for asked in _asked(queries, block):
        part = _aligned(stored, asked, k, gap)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = stored.sparkSession.createDataFrame([], "query long, seq_id long, label string, score double")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "seq_id"))).where(F.col("r") <= k)
    votes = top.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("label").alias("b")))["b"].alias("prediction"))


class HiddenMarkovModel:
    """transition[i, j]: from i to j; symbols count from 0. Fits in the driver; sequences are scored and counted where they lie."""

    def __init__(self, initial, transition, emission):
        self.initial, self.transition, self.emission = (np.asarray(x, float) for x in (initial, transition, emission))

    def _scaled(self, obs):
        alpha, scale = np.zeros((len(obs), len(self.initial))), np.zeros(len(obs))
        for t, o in enumerate(obs):
            a = (self.initial if t == 0 else alpha[t - 1] @ self.transition) * self.emission[:, o]
            scale[t] = a.sum()
            alpha[t] = a / scale[t] if scale[t] else a
        return alpha, scale

    def _backward(self, obs, scale):
        beta = np.ones((len(obs), len(self.initial)))
        for t in range(len(obs) - 2, -1, -1):
            beta[t] = self.transition @ (self.emission[:, obs[t + 1]] * beta[t + 1]) / scale[t + 1]
        return beta

    def log_likelihood(self, obs) -> float:
        with np.errstate(divide="ignore"):
            return float(np.log(self._scaled(obs)[1]).sum())

    def posteriors(self, obs) -> np.ndarray:
        alpha, scale = self._scaled(obs)
        return alpha * self._backward(obs, scale)

    def best_path(self, obs) -> list[int]:
        """Ties to the lowest state."""
        if not len(obs):
            return []
        with np.errstate(divide="ignore"):
            a, b, pi = np.log(self.transition), np.log(self.emission), np.log(self.initial)
        d, back = pi + b[:, obs[0]], []
        for o in obs[1:]:
            step = d[:, None] + a
            back.append(step.argmax(0))
            d = step.max(0) + b[:, o]
        path = [int(d.argmax())]
        for p in reversed(back):
            path.append(int(p[path[-1]]))
        return path[::-1]

    def expected_counts(self, obs):
        alpha, scale = self._scaled(obs)
        beta = self._backward(obs, scale)
        gamma = alpha * beta
        first = gamma[0]
        trans = np.zeros_like(self.transition)
        for t in range(len(obs) - 1):
            trans += self.transition * alpha[t][:, None] * (self.emission[:, obs[t + 1]] * beta[t + 1])[None, :] / scale[t + 1]
        emit = np.zeros_like(self.emission)
        for t, o in enumerate(obs):
            emit[:, o] += gamma[t]
        return first, trans, emit, float(np.log(scale).sum())

    def sample(self, n: int, seed: int = 0) -> tuple[list[int], list[int]]:
        rng = np.random.default_rng(seed)
        states, symbols = [], []
        for t in range(n):
            states.append(int(rng.choice(len(self.initial), p=self.initial if t == 0 else self.transition[states[-1]])))
            symbols.append(int(rng.choice(self.emission.shape[1], p=self.emission[states[-1]])))
        return states, symbols

    def score(self, symbols: Column) -> Column:
        model = self

        @F.pandas_udf(DoubleType())
        def run(v: pd.Series) -> pd.Series:
            return v.map(lambda o: model.log_likelihood(o) if len(o) else 0.0, na_action="ignore")

        return run(symbols)

    def decode(self, symbols: Column) -> Column:
        model = self

        @F.pandas_udf(ArrayType(IntegerType()))
        def run(v: pd.Series) -> pd.Series:
            return v.map(lambda o: model.best_path(o), na_action="ignore")

        return run(symbols)

    def trained(self, sequences: DataFrame, column: str, passes: int = 20, least_gain: float = 1e-3, smoothing: float = 0.0) -> HiddenMarkovModel:
        """Expectation-maximisation over all sequences of a column. Each partition sends one row of expected counts."""
        model = self
        last = -np.inf
        n, m = self.emission.shape
        for _ in range(passes):
            held = model

            def count(batches, held=held):
                total, loss = np.zeros(n + n * n + n * m), 0.0
                for batch in batches:
                    for obs in batch[column]:
                        if obs is not None and len(obs):
                            first, trans, emit, ll = held.expected_counts(obs)
                            total += np.concatenate([first, trans.ravel(), emit.ravel()])
                            loss += ll
                yield pd.DataFrame({"i": np.arange(len(total) + 1), "v": np.append(total, loss)})

            rows = sequences.select(column).mapInPandas(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
            v = np.zeros(n + n * n + n * m + 1)
            for r in rows:
                v[r.i] = r.v
            first, trans, emit = v[:n], v[n : n + n * n].reshape(n, n), v[n + n * n : -1].reshape(n, m)
            share = lambda x: np.where(x.sum(-1, keepdims=True) > 0, x / np.maximum(x.sum(-1, keepdims=True), 1e-300), 1 / x.shape[-1])
            smooth = lambda x: smoothing + (1 - smoothing * x.shape[-1]) * share(x)
            model = HiddenMarkovModel(smooth(first[None])[0], smooth(trans), smooth(emit))
            if v[-1] - last <= least_gain:
                break
            last = v[-1]
        return model
