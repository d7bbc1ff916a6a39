"""Vector algebra on array<double> columns, as higher-order functions that stay in the JVM. A null element is a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Element by element; null where b is 0."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(v: Column, s) -> Column:
    return F.transform(v, lambda x: x * s)


def add_scaled(a: Column, s, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * s)


def add_log(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.log(y))


def cap(v: Column, most) -> Column:
    return F.transform(v, lambda x: F.when(x.isNotNull(), F.least(x, F.lit(float(most)))))


def floor(v: Column, least) -> Column:
    return F.transform(v, lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(float(least)))))


def dot(a: Column, b: Column) -> Column:
    return total(times(a, b))


def dot_known(origin: Column, target: Column, v: Column) -> Column:
    """The dot product of target - origin with v, without missing elements."""
    return total(F.transform(times(subtract(target, origin), v), lambda x: F.coalesce(x, F.lit(0.0))))


def squared_magnitude(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def magnitude(v: Column) -> Column:
    return F.sqrt(squared_magnitude(v))


def p_magnitude(v: Column, p: float) -> Column:
    return F.pow(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def known_squared_distance(a: Column, b: Column, far: float = 1e50) -> Column:
    """Over elements known on both sides, raised in proportion to those that aren't; far if there are none."""
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    known = F.filter(d, lambda x: x.isNotNull())
    return F.when(F.size(known) == 0, F.lit(far)).otherwise(total(known) * F.size(d) / F.size(known))


def p_distance(a: Column, b: Column, p: float) -> Column:
    return p_magnitude(subtract(a, b), p)


def l1(a: Column, b: Column) -> Column:
    return total(F.transform(subtract(a, b), F.abs))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def l_inf(a: Column, b: Column) -> Column:
    return F.array_max(F.transform(subtract(a, b), F.abs))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), magnitude(a) * magnitude(b))


def correlation(a: Column, b: Column) -> Column:
    """The cosine, 0 where the dot product is."""
    return F.when(dot(a, b) == 0, F.lit(0.0)).otherwise(cosine(a, b))


def sigmoid_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + F.exp(l2(a, b)))


def alignment_score(a: Column, b: Column, gap: float = -0.5) -> Column:
    """The cosine of two points; gap where one is null."""
    return F.when(a.isNull() | b.isNull(), F.lit(gap)).otherwise(cosine(a, b))


def normalized(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, magnitude(v)))


def safe_normalized(v: Column, eps: float = 1e-12) -> Column:
    """Unit length; a vector shorter than eps gives the first axis."""
    axis = F.transform(v, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.when(magnitude(v) < eps, axis).otherwise(normalized(v))


def p_normalized(v: Column, p: float) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, p_magnitude(v, p)))


def sum_to_one(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, total(v)))


def has_missing(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull())


def index_of(v: Column, value) -> Column:
    """From 0; -1 if it isn't there."""
    return (F.array_position(v, value) - 1).cast("int")


def index_of_max(v: Column) -> Column:
    """Ties go to the lowest index."""
    return index_of(v, F.array_max(v))


def index_of_min(v: Column) -> Column:
    return index_of(v, F.array_min(v))


def index_of_max_magnitude(v: Column) -> Column:
    return index_of_max(F.transform(v, F.abs))


def smallest(v: Column, k: int) -> Column:
    return F.slice(F.array_sort(v), 1, k)


def interpolate(v: Column, at: Column) -> Column:
    """The value at a fractional index from 0, between its neighbours; held at the ends."""
    low = F.floor(at)
    last = F.size(v) - 1
    pick = lambda i: F.get(v, F.greatest(F.lit(0), F.least(last, i)).cast("int"))
    return pick(low) + (pick(low + 1) - pick(low)) * (at - low)


def resampled(v: Column, n: int) -> Column:
    """The curve v at n even places from its first to its last element."""
    step = (F.size(v) - 1) / F.lit(max(1, n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: interpolate(v, i * step))


def rotated(v: Column, angle, a: int, b: int) -> Column:
    """In the plane of axes a and b."""
    c, s = F.cos(F.lit(angle)), F.sin(F.lit(angle))
    x, y = F.get(v, a), F.get(v, b)
    return F.transform(v, lambda e, i: F.when(i == a, x * c - y * s).when(i == b, x * s + y * c).otherwise(e))


def project(v: Column, origin: Column, basis: list[Column]) -> Column:
    return F.array(*(dot(subtract(v, origin), b) for b in basis))


def without_component(v: Column, basis: Column) -> Column:
    """v less its part along the unit vector basis."""
    return add_scaled(v, -dot(v, basis), basis)


def moved_towards(v: Column, neighbor: Column, distance: float, rate: float) -> Column:
    """v moved along the line to neighbor so that its distance nears the one given."""
    d = l2(v, neighbor)
    return add_scaled(v, F.try_divide(rate * (d - distance), d), subtract(neighbor, v))


def _crossed(heads: Column, n: int) -> Column:
    return F.flatten(F.transform(heads, lambda head: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(head, F.array(i)))))


def grid(*sizes: int) -> Column:
    """All coordinates of an integer grid, to be exploded."""
    out = F.array(F.array().cast("array<int>"))
    for n in sizes:
        out = _crossed(out, n)
    return out


def one_hot(value: Column, values: list[str]) -> Column:
    """Zeros where value is missing or unknown."""
    return F.array(*(F.coalesce((value == v).cast("double"), F.lit(0.0)) for v in values))


def mixed_squared_distance(pairs: list[tuple[Column, Column, bool]], scales: list[float] | None = None) -> Column:
    """Squared differences of reals and 1 for each nominal that differs; pairs: (a, b, is_nominal)."""
    out = F.lit(0.0)
    for i, (a, b, nominal) in enumerate(pairs):
        s = scales[i] if scales else 1.0
        d = F.when(a == b, 0.0).otherwise(1.0) if nominal else (a - b)
        out = out + d * d * (s * s)
    return out
