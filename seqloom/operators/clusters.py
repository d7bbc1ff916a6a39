"""Clustering. Points stay in their partitions; centres, k of them, go round."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.vectors import squared_distance


def _literal(c) -> Column:
    return F.array(*(F.lit(float(x)) for x in c))


def assigned(df: DataFrame, vector: str, centres: list) -> DataFrame:
    """df with cluster and d2; ties to the lowest number."""
    v = F.col(vector).cast("array<double>")
    best = F.array_min(F.array(*(F.struct(squared_distance(v, _literal(c)).alias("d2"), F.lit(i).alias("cluster")) for i, c in enumerate(centres))))
    return df.withColumn("_best", best).withColumns({"cluster": F.col("_best.cluster"), "d2": F.col("_best.d2")}).drop("_best")


def distortion(df: DataFrame, vector: str, centres: list) -> DataFrame:
    return assigned(df, vector, centres).agg(F.sum("d2").alias("distortion"), F.avg("d2").alias("mean"))


def _step(df: DataFrame, vector: str, centres: list, damping: float = 1.0) -> tuple[list, float]:
    d = len(centres[0])
    v = F.col(vector).cast("array<double>")
    rows = assigned(df, vector, centres).groupBy("cluster").agg(F.sum("d2").alias("loss"), *(F.avg(F.get(v, j)).alias(f"m{j}") for j in range(d))).collect()
    new, loss = [list(c) for c in centres], 0.0
    for r in rows:  # an empty cluster keeps its centre
        new[r.cluster] = [c + damping * (r[f"m{j}"] - c) for j, c in enumerate(centres[r.cluster])]
        loss += r.loss
    return new, loss


def seeds(df: DataFrame, vector: str, k: int, seed: int, key: str) -> list:
    """k rows by a hash of seed and key."""
    rows = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k).select(F.col(vector).cast("array<double>")).collect()
    return [list(r[0]) for r in rows]


def kmeans(df: DataFrame, vector: str, k: int, key: str, seed: int = 0, rounds: int = 50, tolerance: float = 1e-9, restarts: int = 1) -> tuple[list, float]:
    """Lloyd's algorithm with restarts: centres and distortion."""
    best = None
    for attempt in range(restarts):
        centres, last = seeds(df, vector, k, seed + attempt, key), np.inf
        for _ in range(rounds):
            new, loss = _step(df, vector, centres)
            if last - loss <= tolerance * max(1.0, loss):
                break
            centres, last = new, loss
        loss = distortion(df, vector, centres).first()[0]
        if best is None or loss < best[1]:
            best = (centres, loss)
    return best


def kmeans_swap(df: DataFrame, vector: str, k: int, key: str, seed: int = 0, swaps: int = 10, lloyd: int = 3, temperature: float = 0.0) -> tuple[list, float]:
    """Local search: a centre is swapped for a random point, a few Lloyd steps follow, and the better is kept; a temperature also accepts some worse ones, which
    falls by a tenth each time, and the best ever seen is returned."""
    rng = np.random.default_rng(seed)
    now = seeds(df, vector, k, seed, key)
    loss = distortion(df, vector, now).first()[0]
    best = (now, loss)
    for i in range(swaps):
        new = [list(c) for c in now]
        new[int(rng.integers(k))] = seeds(df, vector, 1, seed + 1000 + i, key)[0]
        for _ in range(lloyd):
            new, _ = _step(df, vector, new)
        new_loss = distortion(df, vector, new).first()[0]
        gain = (loss - new_loss) / max(loss, 1e-300)
        if gain > 0 or temperature > 0 and rng.random() < np.exp(gain / temperature):
            now, loss = new, new_loss
        if loss < best[1]:
            best = (now, loss)
        temperature *= 0.9
    return best


def most_stages(n: int, k: int, constant: float = 0.0, by_k: float = 0.0, by_root: float = 0.0) -> int:
    """How many stages a search may have: constant + by_k * k + by_root * the root of k * n."""
    return int(constant + by_k * k + by_root * (k * n) ** 0.5)


def kmeans_hybrid(df: DataFrame, vector: str, k: int, key: str, seed: int = 0, stages: int = 20, run: int = 3, temperature: float = 0.05) -> tuple[list, float]:
    """Runs of swaps with a few Lloyd steps each, accepted by annealing, then Lloyd steps to the end; the better of that and
    of Lloyd's algorithm from the same start is returned."""
    best, _ = kmeans_swap(df, vector, k, key, seed, stages, run, temperature)
    return min(_settled(df, vector, best), _settled(df, vector, seeds(df, vector, k, seed, key)), key=lambda x: x[1])


def kmeans_ez_hybrid(df: DataFrame, vector: str, k: int, key: str, seed: int = 0, stages: int = 20, least_gain: float = 0.1) -> tuple[list, float]:
    """One swap, then Lloyd steps as long as each gains least_gain; and again, from the best so far, which at first is what Lloyd's algorithm makes
    of the seeds."""
    rng = np.random.default_rng(seed)
    best = _settled(df, vector, seeds(df, vector, k, seed, key))
    now, left, swaps = best[0], stages, 0
    while left > 0:
        new = [list(c) for c in now]
        new[int(rng.integers(k))] = seeds(df, vector, 1, seed + 2000 + swaps, key)[0]
        swaps += 1
        moved, last = _step(df, vector, new)
        left -= 1
        while left > 0:
            further, loss = _step(df, vector, moved)
            left -= 1
            if last - loss < least_gain * max(last, 1e-300):
                break
            moved, last = further, loss
        loss = distortion(df, vector, moved).first()[0]
        if loss < best[1]:
            best, now = (moved, loss), moved
    return _settled(df, vector, best[0])


def _settled(df: DataFrame, vector: str, centres: list, rounds: int = 20) -> tuple[list, float]:
    last = np.inf
    for _ in range(rounds):
        new, loss = _step(df, vector, centres)
        if last - loss <= 1e-9 * max(1.0, loss):
            break
        centres, last = new, loss
    return centres, distortion(df, vector, centres).first()[0]


def kmedoids(points: np.ndarray, k: int, max_passes: int = 100) -> tuple[list[int], float]:
    """For a set that fits one machine: medoids from the first k rows, swapped while that lowers the sum of distances."""
    dist = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(-1), 0))
    medoids = list(range(min(k, len(points))))
    cost = lambda m: dist[:, m].min(1).sum()
    best = cost(medoids)
    for _ in range(max_passes):
        improved = False
        for i in range(len(medoids)):
            for p in range(len(points)):
                if p not in medoids:
                    trial = [*medoids[:i], p, *medoids[i + 1 :]]
                    if (c := cost(trial)) < best - 1e-12:
                        medoids, best, improved = trial, c, True
        if not improved:
            break
    return medoids, float(best)


def agglomerative(points: np.ndarray, k: int, balance: float = 0.0) -> np.ndarray:
    """For a set that fits one machine: the two clusters of the closest members, times their joint size to the power balance, merge until k are left."""
    groups = [[i] for i in range(len(points))]
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    while len(groups) > k:
        _, a, b = min((d[np.ix_(g, h)].min() * (len(g) + len(h)) ** balance, i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    out = np.empty(len(points), int)
    for i, g in enumerate(sorted(groups, key=min)):
        out[g] = i
    return out


def quantiles(df: DataFrame, column: str, shares: list[float], most: int = 10_000) -> list[float]:
    """The least values that at least these shares of the column's values don't exceed; none for a column without values. Approximate ones narrow the range
    of each, round by round, by counts of what is below them, until it has most values at most; those are sorted on the driver."""
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, found = rows.count(), []
    for share in shares if n else []:
        rank, below, size, inside = max(1, math.ceil(Fraction(share).limit_denominator(10**9) * n)), 0, n, rows
        while size > most:
            near = [min(1.0, max(0.0, (rank - below) / size + d)) for d in (-1e-3, 1e-3)]
            a, b = inside.agg(F.percentile_approx("x", near, 10_000)).first()[0]
            x = F.col("x")
            less_a, to_a, less_b, to_b = (below + c for c in inside.agg(*(F.count_if(c) for c in (x < a, x <= a, x < b, x <= b))).first())
            if less_a < rank <= to_a or less_b < rank <= to_b:
                found.append(a if rank <= to_a else b)
                break
            if rank <= less_a:
                inside, size = inside.where(x < a), less_a - below
            elif rank <= less_b:
                inside, below, size = inside.where((x > a) & (x < b)), to_a, less_b - to_a
            else:
                inside, below, size = inside.where(x > b), to_b, below + size - to_b
        else:
            found.append(inside.orderBy("x").collect()[rank - below - 1][0])
    return found


def gaussian_mixture(df: DataFrame, column: str, k: int, rounds: int = 30, least_variance: float = 1e-6) -> list[tuple[float, float, float]]:
    """Expectation-maximisation of one column: (weight, mean, variance) by rising mean, from its quantiles. One aggregation a round."""
    x = F.col(column).cast("double")
    spread = df.agg(F.var_pop(x)).first()[0]
    parts = [(1.0 / k, m, max(spread or 1.0, least_variance)) for m in quantiles(df, column, [(i + 0.5) / k for i in range(k)])]
    if not parts:
        return []
    for _ in range(rounds):
        dens = [F.lit(w) * F.exp(-(x - m) * (x - m) / (2 * v)) / (v**0.5) for w, m, v in parts]
        total = sum(dens[1:], dens[0])
        share = [F.coalesce(F.try_divide(p, total), F.lit(0.0)) for p in dens]
        r = list(df.where(x.isNotNull()).agg(*(F.sum(e) for s in share for e in (s, s * x, s * x * x))).first())
        n = sum(r[::3]) or 1.0
        parts = [(r[3 * i] / n, r[3 * i + 1] / max(r[3 * i], 1e-300), max(least_variance, r[3 * i + 2] / max(r[3 * i], 1e-300) - (r[3 * i + 1] / max(r[3 * i], 1e-300)) ** 2)) for i in range(k)]
    return sorted(parts, key=lambda p: p[1])


def self_organising_map(points: np.ndarray, width: int, height: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """For a set that fits one machine: a batch map; width x height x dimensions."""
    rng = np.random.default_rng(seed)
    nodes = points[rng.integers(len(points), size=width * height)].astype(float)
    place = np.array([(i, j) for i in range(width) for j in range(height)], float)
    for r in range(rounds):
        radius = max(0.5, max(width, height) / 2 * (1 - r / rounds))
        win = ((points[:, None] - nodes[None]) ** 2).sum(-1).argmin(1)
        w = np.exp(-((place[:, None] - place[win][None]) ** 2).sum(-1) / (2 * radius * radius))
        nodes = w @ points / w.sum(1, keepdims=True)
    return nodes.reshape(width, height, -1)
