"""Kernels of two vectors, as functions of columns that can be combined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.numeric import gaussian_kernel, polynomial_kernel
from seqloom.functions.vectors import dot, squared_distance

Kernel = Callable[[Column, Column], Column]


def linear() -> Kernel:
    return dot


def polynomial(offset: float, order: int) -> Kernel:
    return lambda a, b: polynomial_kernel(dot(a, b), offset, order)


def gaussian(variance: float) -> Kernel:
    return lambda a, b: gaussian_kernel(squared_distance(a, b), variance)


def shifted(kernel: Kernel, by: float) -> Kernel:
    return lambda a, b: kernel(a, b) + by


def scaled(kernel: Kernel, by: float) -> Kernel:
    return lambda a, b: kernel(a, b) * by


def summed(first: Kernel, second: Kernel) -> Kernel:
    return lambda a, b: first(a, b) + second(a, b)


def multiplied(first: Kernel, second: Kernel) -> Kernel:
    return lambda a, b: first(a, b) * second(a, b)


def raised(kernel: Kernel, power: int) -> Kernel:
    return lambda a, b: F.pow(kernel(a, b), F.lit(float(power)))


def exponential(kernel: Kernel) -> Kernel:
    return lambda a, b: F.exp(kernel(a, b))


def normalised(kernel: Kernel) -> Kernel:
    """1 for a vector with itself; null where a kernel of a vector with itself is 0."""
    return lambda a, b: F.try_divide(kernel(a, b), F.sqrt(kernel(a, a) * kernel(b, b)))
