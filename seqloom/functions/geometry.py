"""Quaternions as arrays (x, y, z, w), rotations, homogeneous matrices as flat arrays by row, Fourier transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from seqloom.functions.vectors import add, dot, normalized, scale


def conjugate(q: Column) -> Column:
    return F.transform(q, lambda x, i: F.when(i < 3, -x).otherwise(x))


def quaternion_product(a: Column, b: Column) -> Column:
    ax, ay, az, aw = (F.get(a, i) for i in range(4))
    bx, by, bz, bw = (F.get(b, i) for i in range(4))
    return F.array(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def about_axis(axis: Column, angle: Column) -> Column:
    n = normalized(axis)
    s = F.sin(angle / 2)
    return F.array(*(F.get(n, i) * s for i in range(3)), F.cos(angle / 2))


def rotated_about(point: Column, axis: Column, angle: Column) -> Column:
    q = about_axis(axis, angle)
    return F.slice(quaternion_product(quaternion_product(q, F.concat(point, F.array(F.lit(0.0)))), conjugate(q)), 1, 3)


def slerp(a: Column, b: Column, share: Column) -> Column:
    """Along the shorter arc; nearly equal ones are mixed linearly."""
    d = dot(a, b)
    b2 = F.when(d < 0, scale(b, -1.0)).otherwise(b)
    angle = F.acos(F.least(F.lit(1.0), F.abs(d)))
    wa = F.when(F.abs(d) > 1 - 1e-9, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * angle), F.sin(angle)))
    wb = F.when(F.abs(d) > 1 - 1e-9, share).otherwise(F.try_divide(F.sin(share * angle), F.sin(angle)))
    return add(scale(a, wa), scale(b2, wb))


def cross(a: Column, b: Column) -> Column:
    g = F.get
    return F.array(g(a, 1) * g(b, 2) - g(a, 2) * g(b, 1), g(a, 2) * g(b, 0) - g(a, 0) * g(b, 2), g(a, 0) * g(b, 1) - g(a, 1) * g(b, 0))


def cartesian(theta: Column, phi: Column) -> Column:
    return F.array(F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi))


def transformed(matrix: Column, point: Column, n: int) -> Column:
    """A homogeneous n x n matrix on a point of n - 1 coordinates."""
    full = F.concat(point, F.array(F.lit(1.0)))
    out = [dot(F.slice(matrix, i * n + 1, n), full) for i in range(n)]
    return F.array(*(F.try_divide(x, out[-1]) for x in out[:-1]))


def translation(*by: float) -> np.ndarray:
    m = np.eye(len(by) + 1)
    m[:-1, -1] = by
    return m


def scaling(*by: float) -> np.ndarray:
    return np.diag([*by, 1.0])


def shear(n: int, i: int, j: int, by: float) -> np.ndarray:
    m = np.eye(n + 1)
    m[i, j] = by
    return m


def rotation(angle: float, a: int = 0, b: int = 1, n: int = 2) -> np.ndarray:
    m, c, s = np.eye(n + 1), np.cos(angle), np.sin(angle)
    m[a, a] = m[b, b] = c
    m[a, b], m[b, a] = -s, s
    return m


def literal(matrix: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in np.asarray(matrix).ravel()))


@F.pandas_udf(ArrayType(DoubleType()))
def inverse_of(m: pd.Series) -> pd.Series:
    """Of a flat square matrix; null where it has none."""

    def one(x):
        n = int(round(len(x) ** 0.5))
        a = np.reshape(x, (n, n))
        return np.linalg.inv(a).ravel() if abs(np.linalg.det(a)) > 1e-12 else None

    return m.map(one, na_action="ignore")


@F.pandas_udf(ArrayType(DoubleType()))
def spectrum(v: pd.Series) -> pd.Series:
    """Real and imaginary parts in turn of the Fourier transform of a real signal."""
    return v.map(lambda x: np.fft.fft(x).view(float), na_action="ignore")


def spectrum_2d(width: int):
    """A function of a flat real image by row: real and imaginary parts in turn of its two-dimensional Fourier transform, by row."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.fft.fft2(np.reshape(x, (-1, width))).ravel().view(float), na_action="ignore")

    return run


def to_pixels(v: Column, low: float, high: float) -> Column:
    """Values in threes as red, green and blue of one number each, low as 0 and high as 255."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x - low) * (256 / (high - low))))).cast("int")
    pixels = F.sequence(F.lit(0), F.floor(F.size(v) / 3).cast("int") - 1)
    return F.transform(pixels, lambda i: level(F.get(v, 3 * i)) * 65536 + level(F.get(v, 3 * i + 1)) * 256 + level(F.get(v, 3 * i + 2)))


def from_pixels(p: Column, low: float, high: float) -> Column:
    """The middles of the levels of each pixel's red, green and blue."""
    value = lambda x: (x.cast("double") + 0.5) * ((high - low) / 256) + low
    return F.flatten(F.transform(p, lambda x: F.array(value(F.floor(x / 65536)), value(F.floor(x / 256) % 256), value(x % 256))))
