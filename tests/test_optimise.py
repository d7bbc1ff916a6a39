"""Optimisers and fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import optimise as O


def bowl(x):
    return float(((np.asarray(x) - [1.0, -2.0]) ** 2).sum())


@pytest.mark.parametrize("run", [
    lambda: O.hill_climb(bowl, [0, 0]), lambda: O.anneal(bowl, [0, 0]), lambda: O.empirical_gradient(bowl, [0, 0]), lambda: O.random_search(bowl, [-3, -3], [3, 3], 4000),
    lambda: O.grid_search(bowl, [-3, -3], [3, 3], 7), lambda: O.particle_swarm(bowl, [-3, -3], [3, 3]), lambda: O.evolve(bowl, [0, 0]),
])
def test_minima(run):
    x, value = run()
    assert value < 0.02 and value == pytest.approx(bowl(x))


def test_simplex():
    x, value = O.simplex([[1, 1], [1, 3]], [4, 6], [3, 5])
    assert x == pytest.approx([3, 1]) and value == pytest.approx(14)
    with pytest.raises(ValueError):
        O.simplex([[-1.0]], [1], [1])


def test_fits(spark):
    df = spark.range(1, 60).select(F.col("id").cast("double").alias("n")).withColumns({"y": 2 - F.col("n") + 0.5 * F.col("n") * F.col("n"), "t": 3 * (F.pow("n", F.lit(1.5)) + 7)})
    assert O.polynomial(df, "n", "y", 2) == pytest.approx([2, -1, 0.5], abs=1e-6)
    assert O.growth(df, "n", "t") == pytest.approx((3, 1.5, 7), rel=1e-3)
    noise = df.select(F.randn(1).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("c")).withColumn("y", F.col("b") * 5 + F.col("c"))
    assert O.ranked_attributes(noise, ["a", "b", "c"], "y") == ["b", "c", "a"]
