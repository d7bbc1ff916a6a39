"""Optimisers for small parameter vectors, linear programmes, curve fits and attribute ranking. Objectives that read a table do so with one aggregation each call."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.matrix import moments

Objective = Callable[[np.ndarray], float]


def hill_climb(f: Objective, start, rounds: int = 200, step: float = 0.1, grow: float = 1.25, shrink: float = 0.8) -> tuple[np.ndarray, float]:
    """Each dimension has a step of its own that grows when it helps and shrinks when neither way does."""
    x = np.array(start, float)
    best, steps = f(x), np.full(len(x), step)
    for _ in range(rounds):
        for i in range(len(x)):
            for sign in (1, -1):
                trial = x.copy()
                trial[i] += sign * steps[i]
                if (value := f(trial)) < best:
                    x, best = trial, value
                    steps[i] *= grow
                    break
            else:
                steps[i] *= shrink
    return x, best


def anneal(f: Objective, start, rounds: int = 2000, dev: float = 0.5, decay: float = 0.997, seed: int = 0) -> tuple[np.ndarray, float]:
    rng, x = np.random.default_rng(seed), np.array(start, float)
    now = f(x)
    best = (x, now)
    for _ in range(rounds):
        trial = x + rng.normal(0, dev, len(x))
        value = f(trial)
        if value < now or rng.random() < np.exp(-(value - now) / max(dev, 1e-12)):
            x, now = trial, value
        if now < best[1]:
            best = (x, now)
        dev *= decay
    return best


def empirical_gradient(f: Objective, start, rounds: int = 300, rate: float = 0.1, momentum: float = 0.8, h: float = 1e-5) -> tuple[np.ndarray, float]:
    x = np.array(start, float)
    move = np.zeros(len(x))
    for _ in range(rounds):
        g = np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(len(x))])
        move = momentum * move - rate * g
        x = x + move
    return x, f(x)


def random_search(f: Objective, low, high, rounds: int = 1000, seed: int = 0) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    points = rng.uniform(low, high, (rounds, len(low)))
    values = [f(p) for p in points]
    return points[int(np.argmin(values))], float(min(values))


def grid_search(f: Objective, low, high, steps: int = 11) -> tuple[np.ndarray, float]:
    points = np.stack(np.meshgrid(*(np.linspace(a, b, steps) for a, b in zip(low, high, strict=True))), -1).reshape(-1, len(low))
    values = [f(p) for p in points]
    return points[int(np.argmin(values))], float(min(values))


def particle_swarm(f: Objective, low, high, particles: int = 30, rounds: int = 100, seed: int = 0) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    x = rng.uniform(low, high, (particles, len(low)))
    v = np.zeros_like(x)
    own, own_value = x.copy(), np.array([f(p) for p in x])
    for _ in range(rounds):
        lead = own[own_value.argmin()]
        v = 0.7 * v + 1.4 * rng.random(x.shape) * (own - x) + 1.4 * rng.random(x.shape) * (lead - x)
        x = x + v
        value = np.array([f(p) for p in x])
        better = value < own_value
        own[better], own_value[better] = x[better], value[better]
    return own[own_value.argmin()], float(own_value.min())


def evolve(f: Objective, start, population: int = 40, rounds: int = 150, dev: float = 0.3, seed: int = 0) -> tuple[np.ndarray, float]:
    """Tournaments replace the worse of two by a mutated mix of the better and another."""
    rng = np.random.default_rng(seed)
    x = np.array(start, float) + rng.normal(0, dev, (population, len(start)))
    value = np.array([f(p) for p in x])
    for _ in range(rounds * population // 2):
        a, b, c = rng.choice(population, 3, replace=False)
        if value[a] > value[b]:
            a, b = b, a
        mask = rng.random(len(start)) < 0.7
        x[b] = np.where(mask, x[a], x[c]) + rng.normal(0, dev, len(start)) * (rng.random(len(start)) < 0.5)
        value[b] = f(x[b])
        dev *= 1 - 1 / (rounds * population)
    return x[value.argmin()], float(value.min())


def simplex(a, b, c) -> tuple[np.ndarray, float]:
    """The maximum of c x with a x <= b and x >= 0, for b >= 0; Bland's rule."""
    a, b, c = (np.asarray(x, float) for x in (a, b, c))
    if (b < 0).any():
        raise ValueError("b must not be negative")
    m, n = a.shape
    t = np.zeros((m + 1, n + m + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1], t[m, :n] = a, np.eye(m), b, -c
    basis = list(range(n, n + m))
    while (t[m, :-1] < -1e-12).any():
        j = int(np.flatnonzero(t[m, :-1] < -1e-12)[0])
        rows = np.flatnonzero(t[:m, j] > 1e-12)
        if not len(rows):
            raise ValueError("unbounded")
        ratio = t[rows, -1] / t[rows, j]
        i = int(min(rows[ratio <= ratio.min() + 1e-12], key=lambda r: basis[r]))
        t[i] /= t[i, j]
        for r in range(m + 1):
            if r != i:
                t[r] -= t[r, j] * t[i]
        basis[i] = j
    x = np.zeros(n + m)
    x[basis] = t[:m, -1]
    return x[:n], float(t[m, -1])


def polynomial(df: DataFrame, x: str, y: str, degree: int, ridge: float = 0.0) -> np.ndarray:
    """Least squares coefficients from degree 0 up, from one pass of power sums of x scaled to its largest magnitude."""
    s = float(df.agg(F.max(F.abs(F.col(x)))).first()[0] or 1.0) or 1.0
    u, v = F.col(x).cast("double") / s, F.col(y).cast("double")
    known = df.where(u.isNotNull() & v.isNotNull())
    r = list(known.agg(*(F.sum(F.pow(u, F.lit(float(k)))).alias(f"p{k}") for k in range(2 * degree + 1)), *(F.sum(v * F.pow(u, F.lit(float(k)))).alias(f"q{k}") for k in range(degree + 1))).first())
    a = np.array([[r[i + j] for j in range(degree + 1)] for i in range(degree + 1)]) + ridge * np.eye(degree + 1)
    return np.linalg.lstsq(a, np.array(r[2 * degree + 1 :]), rcond=None)[0] / s ** np.arange(degree + 1)


def growth(df: DataFrame, n: str, t: str) -> tuple[float, float, float]:
    """a, b, c of t = a (n ** b + c), by search over b and least squares for the others; one pass."""
    powers = np.linspace(0.1, 4.0, 79)
    x, y = F.col(n).cast("double"), F.col(t).cast("double")
    sums = [F.count(F.lit(1)), F.sum(y), F.sum(y * y)]
    for b in powers:
        z = F.pow(x, F.lit(float(b)))
        sums += [F.sum(z), F.sum(z * z), F.sum(z * y)]
    r = [float(v or 0) for v in df.where(x.isNotNull() & y.isNotNull()).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
    count, sy, syy = r[:3]
    best = None
    for k, b in enumerate(powers):
        sz, szz, szy = r[3 + 3 * k : 6 + 3 * k]
        d = count * szz - sz * sz
        a = (count * szy - sz * sy) / d if d else 0.0
        off = (sy - a * sz) / count if count else 0.0
        loss = syy - a * szy - off * sy
        if best is None or loss < best[0]:
            best = (loss, a, float(b), off / a if a else 0.0)
    return best[1:]


def ranked_attributes(df: DataFrame, features: list[str], label: str) -> list[str]:
    """Best first, by backward elimination: the feature whose standardised least-squares weight is least is dropped, and the rest are fitted again, from one pass of sums."""
    _, cov, _ = moments(df, [*features, label])
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = cov / np.outer(dev, dev)
    left, order = list(range(len(features))), []
    while left:
        w = np.linalg.lstsq(corr[np.ix_(left, left)], corr[left, -1], rcond=None)[0]
        order.append(left.pop(int(np.abs(w).argmin())))
    return [features[i] for i in reversed(order)]
