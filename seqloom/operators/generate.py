"""Generated tables: distributions and curves, by row number and seed, so that any partition can be made again alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(seed: int, salt: int, key: Column | None = None) -> Column:
    """Uniform in (0, 1), from a hash."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), key if key is not None else F.col("id")), 11)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 53))


def _normal(seed: int, salt: int) -> Column:
    return F.sqrt(-2 * F.log(_unit(seed, salt))) * F.cos(2 * math.pi * _unit(seed, salt + 500_000))


def uniform_points(spark: SparkSession, n: int, dims: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.array(*(2 * _unit(seed, d) - 1 for d in range(dims))).alias("point"))


def gauss_points(spark: SparkSession, n: int, dims: int, dev: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.array(*(dev * _normal(seed, d) for d in range(dims))).alias("point"))


def laplace_points(spark: SparkSession, n: int, dims: int, seed: int = 0) -> DataFrame:
    u = [_unit(seed, d) - 0.5 for d in range(dims)]
    return spark.range(n).select("id", F.array(*(-F.signum(x) * F.log(1 - 2 * F.abs(x)) / math.sqrt(2) for x in u)).alias("point"))


def correlated_gauss_points(spark: SparkSession, n: int, dims: int, correlation: float, seed: int = 0) -> DataFrame:
    cells, last = [], None
    for d in range(dims):
        z = _normal(seed, d)
        last = z if last is None else last * correlation + z * math.sqrt(1 - correlation**2)
        cells.append(last)
    return spark.range(n).select("id", F.array(*cells).alias("point"))


def clustered_gauss_points(spark: SparkSession, n: int, dims: int, clusters: int, dev: float, seed: int = 0) -> DataFrame:
    rows = spark.range(n).withColumn("cluster", F.floor(_unit(seed, 900_000) * clusters).cast("int"))
    centre = [2 * _unit(seed + 1, d, F.col("cluster")) - 1 for d in range(dims)]
    return rows.select("id", "cluster", F.array(*(c + dev * _normal(seed, d) for d, c in enumerate(centre))).alias("point"))


def correlated_laplace_points(spark: SparkSession, n: int, dims: int, correlation: float, seed: int = 0) -> DataFrame:
    cells, last = [], None
    for d in range(dims):
        u = _unit(seed, d) - 0.5
        z = -F.signum(u) * F.log(1 - 2 * F.abs(u)) / math.sqrt(2)
        last = z if last is None else last * correlation + z * math.sqrt(1 - correlation**2)
        cells.append(last)
    return spark.range(n).select("id", F.array(*cells).alias("point"))


def orthogonal_flats(spark: SparkSession, n: int, dims: int, clusters: int, dev: float, flat_dims: int, seed: int = 0) -> DataFrame:
    """Clusters that spread evenly over flat_dims axes of their own, and by dev across the others."""
    rows = spark.range(n).withColumn("cluster", F.floor(_unit(seed, 900_000) * clusters).cast("int"))
    place = lambda d: F.pmod(F.xxhash64(F.lit(seed + 2), F.col("cluster")) + d, F.lit(dims))
    centre = lambda d: 2 * _unit(seed + 1, d, F.col("cluster")) - 1
    cells = [F.when(place(d) < flat_dims, 2 * _unit(seed, d) - 1).otherwise(centre(d) + dev * _normal(seed, d)) for d in range(dims)]
    return rows.select("id", "cluster", F.array(*cells).alias("point"))


def ellipsoid_points(spark: SparkSession, n: int, dims: int, clusters: int, small: float, large: float, large_dims: int, seed: int = 0) -> DataFrame:
    """Gaussian clusters with a deviation of large on large_dims axes of their own and small on the others."""
    rows = spark.range(n).withColumn("cluster", F.floor(_unit(seed, 900_000) * clusters).cast("int"))
    place = lambda d: F.pmod(F.xxhash64(F.lit(seed + 2), F.col("cluster")) + d, F.lit(dims))
    cells = [2 * _unit(seed + 1, d, F.col("cluster")) - 1 + F.when(place(d) < large_dims, large).otherwise(small) * _normal(seed, d) for d in range(dims)]
    return rows.select("id", "cluster", F.array(*cells).alias("point"))


def multi_cluster_points(spark: SparkSession, n: int, dims: int, base: float, seed: int = 0) -> DataFrame:
    """Clusters of sizes that halve one after the other, with deviations of base over the root of the dimensions."""
    rows = spark.range(n).withColumn("cluster", F.floor(-F.log2(_unit(seed, 900_000))).cast("int"))
    centre = lambda d: 2 * _unit(seed + 1, d, F.col("cluster")) - 1
    return rows.select("id", "cluster", F.array(*(centre(d) + base / math.sqrt(dims) * _normal(seed, d) for d in range(dims))).alias("point"))


DISTRIBUTIONS = ["beta", "binomial", "cauchy", "chisquare", "exponential", "f", "gamma", "geometric", "gumbel", "laplace", "logistic", "lognormal", "normal", "poisson", "rayleigh", "standard_t", "uniform", "weibull"]


def noise(spark: SparkSession, n: int, distribution: str, *parameters: float, seed: int = 0, block: int = 10_000) -> DataFrame:
    """id, value of a numpy distribution; each block of rows has its own generator."""
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {distribution}")

    def run(batches):
        for batch in batches:
            for b in batch.id:
                size = min(block, n - b * block)
                yield pd.DataFrame({"id": b * block + np.arange(size), "value": getattr(np.random.default_rng([seed, b]), distribution)(*parameters, size=size).astype(float)})

    return spark.range(-(-n // block)).mapInPandas(run, "id long, value double")


def _curve(spark: SparkSession, n: int, make) -> DataFrame:
    return spark.range(n).select("id", F.array(*make).alias("point"))


def swiss_roll(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    t = F.lit(math.pi) * (0.5 + 3 * (F.col("id") + 0.5) / n)
    return _curve(spark, n, (t * F.cos(t) / 4, 5 * _unit(seed, 1), t * F.sin(t) / 4))


def s_curve(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    t = 3 * math.pi * ((F.col("id") + 0.5) / n - 0.5)
    return _curve(spark, n, (F.sin(t), 2 * _unit(seed, 1), F.signum(t) * (F.cos(t) - 1)))


def fish_bowl(spark: SparkSession, n: int, opening: float = 0.25, seed: int = 0) -> DataFrame:
    z = 1 - 2 * (opening + (1 - opening) * _unit(seed, 1))
    r, a = F.sqrt(1 - z * z), 2 * math.pi * _unit(seed, 2)
    return _curve(spark, n, (r * F.cos(a), r * F.sin(a), z))


def entwined_spirals(spark: SparkSession, n: int) -> DataFrame:
    side = F.pmod(F.col("id"), F.lit(2))
    t = 4 * math.pi * (F.col("id") + 1) / n
    return spark.range(n).select("id", F.array(t * F.cos(t + side * math.pi), t * F.sin(t + side * math.pi)).alias("point"), side.cast("int").alias("label"))


def ribbon(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A ribbon that crosses itself."""
    t = 2 * math.pi * ((F.col("id") + 0.5) / n - 0.5)
    return _curve(spark, n, (F.sin(2 * t), F.sin(t), 0.5 * _unit(seed, 1)))


def unit_cube(spark: SparkSession, n: int) -> DataFrame:
    """The points of an n x n x n grid on the surface of the unit cube."""
    step = F.lit(1.0 / max(1, n - 1))
    x, y, z = (F.floor(F.col("id") / d) % n for d in (n * n, n, 1))
    edge = lambda c: (c == 0) | (c == n - 1)
    return spark.range(n**3).where(edge(x) | edge(y) | edge(z)).select("id", F.array(x * step, y * step, z * step).alias("point"))


def grid_walk(spark: SparkSession, width: int, height: int, steps: int, seed: int = 0, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """t, x, y, action of a walk that stays where a step would leave the grid. One row after the other, as steps depend on each other."""
    rng, (x, y), rows = np.random.default_rng(seed), start, []
    for t in range(steps):
        a = int(rng.integers(4))
        rows.append((t, x, y, "ESWN"[a]))
        dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[a]
        x, y = min(width - 1, max(0, x + dx)), min(height - 1, max(0, y + dy))
    return spark.createDataFrame(rows, "t int, x int, y int, action string")


def equation_grid(spark: SparkSession, low: float, high: float, n: int, **functions) -> DataFrame:
    """x at n even places and functions of it."""
    x = F.lit(low) + F.col("id") * ((high - low) / max(1, n - 1))
    return spark.range(n).select(x.alias("x")).select("x", *(f(F.col("x")).alias(k) for k, f in functions.items()))
