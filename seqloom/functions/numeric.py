"""Numeric functions that Spark lacks. Those of one value run as Arrow UDFs; the plain versions serve small driver-side results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _vectorised(f):
    @F.pandas_udf(DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore").astype("float64")

    return run


def log_gamma(x: Column) -> Column:
    return _vectorised(math.lgamma)(x.cast("double"))


def gamma(x: Column) -> Column:
    return _vectorised(math.gamma)(x.cast("double"))


def erf(x: Column) -> Column:
    return _vectorised(math.erf)(x.cast("double"))


def log_factorial(n: Column) -> Column:
    """Exact up to 20, then by the gamma function."""
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(log_gamma(n + 1))


def inverse_erf_of(x: float) -> float:
    if x <= -1 or x >= 1:
        return math.copysign(math.inf, x) if abs(x) == 1 else math.nan
    a = 0.147
    ln = math.log(1 - x * x)
    t = 2 / (math.pi * a) + ln / 2
    y = math.copysign(math.sqrt(math.sqrt(t * t - ln / a) - t), x)
    for _ in range(3):  # Newton
        y -= (math.erf(y) - x) / (2 / math.sqrt(math.pi) * math.exp(-y * y))
    return y


def inverse_erf(x: Column) -> Column:
    return _vectorised(inverse_erf_of)(x.cast("double"))


def product_log_of(x: float) -> float:
    """The principal branch of Lambert's W."""
    if x < -1 / math.e:
        return math.nan
    w = math.log1p(x) if x > -0.3 else -0.9
    for _ in range(60):
        e = math.exp(w)
        step = (w * e - x) / (e * (w + 1) - (w + 2) * (w * e - x) / (2 * w + 2)) if w != -1 else 0.0
        w -= step
        if abs(step) < 1e-15 * (1 + abs(w)):
            break
    return w


def product_log(x: Column) -> Column:
    return _vectorised(product_log_of)(x.cast("double"))


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def incomplete_beta(x: float, a: float, b: float) -> float:
    return beta_share(a, b, x) * math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def t_test_alpha(v: float, t: float) -> float:
    """The two-tailed probability of |t| or more with v degrees of freedom."""
    return beta_share(v / 2, 0.5, v / (v + t * t)) if t else 1.0


def wilcoxon_alpha(n: int, w: float) -> float:
    """By the normal approximation, two-tailed."""
    if n < 1:
        return 1.0
    mean, dev = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return math.erfc(abs(w - mean) / dev / math.sqrt(2))


def pascal_row(n: int) -> list[int]:
    return [math.comb(n, k) for k in range(n + 1)]


def integrate(f, low, high, steps: int = 100) -> Column:
    """Simpson's rule for a function of columns."""
    steps += steps % 2
    low, high = F.lit(low), F.lit(high)
    h = (high - low) / steps
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, i: a + f(low + i * h) * F.when((i == 0) | (i == steps), 1).otherwise(2 + 2 * (i % 2))) * h / 3


# densities -------------------------------------------------------------------------------------------------------------------


def normal_density(x: Column, mean, variance) -> Column:
    return F.exp(normal_log_density(x, mean, variance))


def normal_log_density(x: Column, mean, variance) -> Column:
    mean, variance = F.lit(mean), F.lit(variance)
    return -0.5 * (F.log(2 * math.pi * variance) + (x - mean) * (x - mean) / variance)


def uniform_density(x: Column, low, high) -> Column:
    return F.when((x >= low) & (x < high), 1 / (F.lit(high) - F.lit(low))).otherwise(0.0)


def poisson_density(k: Column, rate) -> Column:
    return F.exp(k * F.log(F.lit(float(rate))) - F.lit(float(rate)) - log_factorial(k))


def gamma_density(x: Column, shape: float, scale: float) -> Column:
    return F.exp((shape - 1) * F.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale))


def inverse_gamma_density(x: Column, shape: float, scale: float) -> Column:
    return F.exp(shape * math.log(scale) - math.lgamma(shape) - (shape + 1) * F.log(x) - scale / x)


def beta_density(x: Column, a: float, b: float) -> Column:
    return F.exp((a - 1) * F.log(x) + (b - 1) * F.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def soft_impulse_cumulative(x: Column, steepness: float) -> Column:
    """1 / (1 + ((1 - x) / x) ** steepness) on (0, 1)."""
    return 1 / (1 + F.pow((1 - x) / x, F.lit(float(steepness))))


# kernels and activations -----------------------------------------------------------------------------------------------------


def polynomial_kernel(dot: Column, offset: float, order: int) -> Column:
    return F.pow(dot + offset, F.lit(float(order)))


def gaussian_kernel(squared_distance: Column, variance: float) -> Column:
    return F.exp(-0.5 * squared_distance / variance)


ACTIVATIONS = {
    "logistic": lambda x: 1 / (1 + F.exp(-x)),
    "arctan": F.atan,
    "tanh": F.tanh,
    "algebraic": lambda x: x / F.sqrt(x * x + 1),
    "identity": lambda x: x,
    "bend": lambda x: (F.sqrt(x * x + 0.01) - 0.1) / 2 + x,
    "bidir": lambda x: F.signum(x) * (F.sqrt(F.abs(x) + 0.25) - 0.5),
    "piecewise": lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)),
}


def multivariate_normal_density(x: list[Column], mean, covariance) -> Column:
    """Of a vector given as columns; the covariance, a small matrix, is inverted once in the driver."""
    inverse, (_, log_det) = np.linalg.inv(covariance), np.linalg.slogdet(covariance)
    d = [c - float(m) for c, m in zip(x, mean, strict=True)]
    square = sum((a * b * float(inverse[i, j]) for i, a in enumerate(d) for j, b in enumerate(d)), F.lit(0.0))
    return F.exp(-0.5 * (square + float(log_det) + len(d) * math.log(2 * math.pi)))
