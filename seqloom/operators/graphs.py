"""Graphs: relaxation and labelling on edge tables of any size; all-pairs and flow algorithms on small graphs in numpy."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import SMALL, checkpointed, stored


def shortest_paths(edges: DataFrame, origin: int, most_rounds: int = 10_000) -> DataFrame:
    """node, cost, previous from origin over edges (src, dst, cost >= 0). Each round relaxes all edges out of what changed; edges are made once, and shuffled
    only in rounds where more has changed than is broadcast."""
    spark = edges.sparkSession
    edges = stored(edges.select(F.col("src").alias("previous"), F.col("dst").alias("node"), F.col("cost").alias("_step")))
    best = front = spark.createDataFrame([(origin, 0.0, None)], "node long, cost double, previous long")
    n = 1
    for _ in range(most_rounds):
        out = front.select(F.col("node").alias("previous"), F.col("cost").alias("_far"))
        step = edges.join(F.broadcast(out) if 2 * n <= SMALL else out, "previous").select("node", (F.col("_far") + F.col("_step")).alias("cost"), "previous")
        step = step.groupBy("node").agg(F.min(F.struct("cost", "previous")).alias("b")).select("node", "b.*")
        old = best.select("node", F.col("cost").alias("old"))
        front = checkpointed(step.join(old, "node", "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old"))).drop("old"))
        n = front.count()
        if n == 0:
            return best
        best = checkpointed(best.join(front.select("node"), "node", "left_anti").unionByName(front))
    raise ValueError("no end within the rounds allowed")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) over undirected edges (src, dst), by labels that spread and jump."""
    both = checkpointed(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("m"))
        new = label.join(near, F.col("node") == F.col("src")).select("node", F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = checkpointed(new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component")))
        if new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count() == 0:
            return new
        label = new


def is_connected(edges: DataFrame) -> bool:
    return components(edges).select("component").distinct().limit(2).count() <= 1


def all_pairs(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs (inf: no edge) and the next node on each path (-1: none)."""
    d = np.array(cost, float)
    np.fill_diagonal(d, 0.0)
    nxt = np.where(np.isfinite(d), np.arange(len(d))[None, :], -1)
    for k in range(len(d)):
        via = d[:, k, None] + d[None, k]
        better = via < d
        d = np.where(better, via, d)
        nxt = np.where(better, nxt[:, k, None], nxt)
    return d, nxt


def dijkstra(n: int, edges: list[tuple[int, int, float]], origin: int) -> tuple[list[float], list[int]]:
    out: list[list] = [[] for _ in range(n)]
    for a, b, c in edges:
        out[a].append((b, c))
    cost, prev, heap = [np.inf] * n, [-1] * n, [(0.0, origin)]
    cost[origin] = 0.0
    while heap:
        c, a = heapq.heappop(heap)
        if c > cost[a]:
            continue
        for b, w in out[a]:
            if c + w < cost[b]:
                cost[b], prev[b] = c + w, a
                heapq.heappush(heap, (cost[b], b))
    return cost, prev


def betweenness(n: int, edges: list[tuple[int, int]]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Brandes, undirected: of vertices, and of edges."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    vertex, edge = [0.0] * n, {(min(e), max(e)): 0.0 for e in edges}
    for s in range(n):
        dist, paths, before, order = {s: 0}, [0.0] * n, [[] for _ in range(n)], []
        paths[s] = 1.0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = [0.0] * n
        for w in reversed(order):
            for v in before[w]:
                c = paths[v] / paths[w] * (1 + share[w])
                share[v] += c
                edge[min(v, w), max(v, w)] += c / 2
            if w != s:
                vertex[w] += share[w] / 2
    return vertex, edge


def min_cut(n: int, edges: list[tuple[int, int, float]], source: int, sink: int) -> tuple[float, set[int]]:
    """The maximal flow over undirected capacities, and the nodes on the source's side."""
    room = np.zeros((n, n))
    for a, b, c in edges:
        room[a, b] += c
        room[b, a] += c
    flow = 0.0
    while True:
        prev, queue = {source: source}, deque([source])
        while queue and sink not in prev:
            v = queue.popleft()
            for w in np.flatnonzero(room[v] > 1e-12):
                if int(w) not in prev:
                    prev[int(w)] = v
                    queue.append(int(w))
        if sink not in prev:
            return flow, set(prev)
        path, v = [], sink
        while v != source:
            path.append((prev[v], v))
            v = prev[v]
        step = min(room[a, b] for a, b in path)
        for a, b in path:
            room[a, b] -= step
            room[b, a] += step
        flow += step


def atomic_cycles(n: int, edges: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """Chordless cycles, each from its least node."""
    near = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = []

    def grow(path):
        for w in sorted(near[path[-1]]):
            if w > path[0] and w not in path:
                chords = [v for v in path[:-1] if w in near[v]]
                if not chords:
                    grow([*path, w])
                elif chords == [path[0]] and len(path) >= 2 and path[1] < w:
                    out.append((*path, w))

    for s in range(n):
        grow([s])
    return out


def cut_large_cycles(n: int, edges: list[tuple[int, int, float]], longest: int) -> list[tuple[int, int, float]]:
    """Edges less those of most betweenness in cycles without chords of longest nodes or more."""
    edges = list(edges)
    while True:
        big = [c for c in atomic_cycles(n, [e[:2] for e in edges]) if len(c) >= longest]
        if not big:
            return edges
        _, load = betweenness(n, [e[:2] for e in edges])
        c = big[0]
        a, b = max(zip(c, (*c[1:], c[0]), strict=True), key=lambda e: load[min(e), max(e)])
        edges = [e for e in edges if {e[0], e[1]} != {a, b}]


def scaling(d2: np.ndarray, k: int) -> np.ndarray:
    """Classical multidimensional scaling of squared distances."""
    n = len(d2)
    c = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * c @ d2 @ c)
    order = np.argsort(-w)[:k]
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    return v * np.sqrt(np.maximum(w[order], 0))


def _knn(x: np.ndarray, k: int):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return d, np.argsort(d, 1, kind="stable")[:, 1 : k + 1]


def isomap(x: np.ndarray, neighbors: int, k: int) -> np.ndarray:
    d, near = _knn(x, neighbors)
    cost = np.full(d.shape, np.inf)
    for i, row in enumerate(near):
        cost[i, row] = cost[row, i] = d[i, row]
    full, _ = all_pairs(cost)
    if not np.isfinite(full).all():
        raise ValueError("the graph of neighbours isn't connected")
    return scaling(full**2, k)


def locally_linear(x: np.ndarray, neighbors: int, k: int, ridge: float = 1e-3) -> np.ndarray:
    _, near = _knn(x, neighbors)
    n = len(x)
    w = np.zeros((n, n))
    for i, row in enumerate(near):
        z = x[row] - x[i]
        g = z @ z.T
        g += np.eye(len(row)) * ridge * (np.trace(g) or 1.0)
        s = np.linalg.solve(g, np.ones(len(row)))
        w[i, row] = s / s.sum()
    m = (np.eye(n) - w).T @ (np.eye(n) - w)
    _, v = np.linalg.eigh(m)
    return v[:, 1 : k + 1]


def breadth_first_unfolding(x: np.ndarray, neighbors: int, k: int, seed: int = 0) -> np.ndarray:
    """Points placed breadth first: each by its distances to neighbours that are placed, within the local principal plane of its parent."""
    d, near = _knn(x, neighbors)
    start = int(np.random.default_rng(seed).integers(len(x)))
    out, seen, queue = np.zeros((len(x), k)), {start}, deque([start])
    mean = x[near[start]].mean(0)
    basis = np.linalg.svd(x[near[start]] - mean, full_matrices=False)[2][:k]
    bases = {start: basis}
    while queue:
        p = queue.popleft()
        for q in near[p]:
            q = int(q)
            if q not in seen:
                own = np.linalg.svd(x[near[q]] - x[near[q]].mean(0), full_matrices=False)[2][:k]
                u, _, vt = np.linalg.svd(own @ bases[p].T)
                bases[q] = (u @ vt).T @ own
                step = bases[p] @ (x[q] - x[p])
                size = np.linalg.norm(step)
                out[q] = out[p] + step * (d[p, q] / size if size > 1e-12 else 1.0)
                seen.add(q)
                queue.append(q)
    return out
