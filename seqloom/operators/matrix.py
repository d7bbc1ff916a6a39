"""Matrices: as coordinate tables (row, col, val) where they may be large, and as numpy arrays where an algorithm needs all of a small one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False) -> DataFrame:
    a, b = (transpose(a) if transpose_a else a), (transpose(b) if transpose_b else b)
    right = b.select(F.col("row").alias("k"), F.col("col").alias("c"), F.col("val").alias("w"))
    joined = a.join(right, a["col"] == right["k"])
    return joined.groupBy("row", F.col("c").alias("col")).agg(F.sum(F.col("val") * F.col("w")).alias("val"))


def add(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    return a.select("row", "col", "val").unionByName(b.select("row", "col", (F.col("val") * factor).alias("val"))).groupBy("row", "col").agg(F.sum("val").alias("val"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1.0)


def scale(a: DataFrame, s: float) -> DataFrame:
    return a.withColumn("val", F.col("val") * s)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def trace(a: DataFrame) -> DataFrame:
    return a.where(F.col("row") == F.col("col")).agg(F.coalesce(F.sum("val"), F.lit(0.0)).alias("trace"))


def squared_norm(a: DataFrame) -> DataFrame:
    return a.agg(F.sum(F.col("val") * F.col("val")).alias("norm2"))


def squared_difference_with_identity(a: DataFrame, n: int) -> DataFrame:
    return squared_norm(subtract(a, identity(a.sparkSession, n)))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("row"), F.col("id").cast("int").alias("col"), F.lit(1.0).alias("val"))


def mirrored(a: DataFrame, upper: bool = True) -> DataFrame:
    """The triangle above the diagonal (or below) copied to the other."""
    kept = a.where(F.col("row") <= F.col("col")) if upper else a.where(F.col("row") >= F.col("col"))
    return kept.unionByName(transpose(kept.where(F.col("row") != F.col("col"))))


def sub_matrix(a: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    inside = F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1)
    return a.where(inside).select((F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), "val")


def element(a: DataFrame, row: int, col: int) -> float:
    found = a.where((F.col("row") == row) & (F.col("col") == col)).first()
    return found.val if found else 0.0


def with_element(a: DataFrame, row: int, col: int, val: float) -> DataFrame:
    rest = a.where(~((F.col("row") == row) & (F.col("col") == col)))
    return rest.unionByName(a.sparkSession.createDataFrame([(row, col, val)], "row int, col int, val double").select(*(F.col(c).cast(t) for c, t in rest.dtypes)))


def swapped(a: DataFrame, axis: str, i: int, j: int) -> DataFrame:
    return a.withColumn(axis, F.when(F.col(axis) == i, j).when(F.col(axis) == j, i).otherwise(F.col(axis)))


def dense_rows(a: DataFrame, cols: int) -> DataFrame:
    """row, vec."""
    rows = a.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    return rows.select("row", F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def dense(a: DataFrame, most: int = 4_000_000) -> np.ndarray:
    """A small matrix in the driver; an error above most cells."""
    top = a.agg(F.max("row"), F.max("col")).first()
    n, m = (top[0] or 0) + 1, (top[1] or 0) + 1
    if n * m > most:
        raise ValueError(f"{n} x {m} is too large for the driver")
    out = np.zeros((n, m))
    for r in a.select("row", "col", "val").collect():
        out[r.row, r.col] = r.val
    return out


def to_table(spark, a: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(np.atleast_2d(a))], "row int, col int, val double")


def determinant(a: np.ndarray) -> float:
    return float(np.linalg.det(a))


def cholesky(a: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(a)


def inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.inv(a)


def pseudo_inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(a)


def reduced_row_echelon(a: np.ndarray) -> tuple[np.ndarray, int]:
    """With its rank."""
    a, r = np.array(a, float), 0
    for c in range(a.shape[1]):
        if r == len(a):
            break
        p = r + int(np.abs(a[r:, c]).argmax())
        if abs(a[p, c]) < 1e-9:
            continue
        a[[r, p]] = a[[p, r]]
        a[r] /= a[r, c]
        for i in range(len(a)):
            if i != r:
                a[i] -= a[r] * a[i, c]
        r += 1
    return a, r


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _signed(v: np.ndarray) -> np.ndarray:
    """Rows turned so that their largest element is positive."""
    at = np.abs(v).argmax(1)
    return v * np.where(v[np.arange(len(v)), at] < 0, -1.0, 1.0)[:, None]


def svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, s, v = np.linalg.svd(a, full_matrices=False)
    fixed = _signed(v)
    return u * (fixed * v).sum(1)[None, :], s, fixed


def eigen(a: np.ndarray, n: int, largest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix: n values and their vectors as rows."""
    w, v = np.linalg.eigh(a)
    order = np.argsort(-w if largest else w)[:n]
    return w[order], _signed(v.T[order])


def moments(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance (by n) and total weight, from one pass of sums; the table may be of any size."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cols = [F.col(c).cast("double") for c in columns]
    d = len(cols)
    sums = [F.sum(w), *(F.sum(w * x) for x in cols), *(F.sum(w * cols[i] * cols[j]) for i in range(d) for j in range(i, d))]
    r = list(df.na.drop("any", subset=columns).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first())
    n, mean = r[0] or 0.0, np.array([x or 0.0 for x in r[1 : d + 1]]) / (r[0] or 1.0)
    cov = np.zeros((d, d))
    it = iter(r[d + 1 :])
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (next(it) or 0.0) / (n or 1.0) - mean[i] * mean[j]
    return mean, cov, n


def principal_components(df: DataFrame, columns: list[str], k: int, about_origin: bool = False, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components as rows, variances."""
    mean, cov, _ = moments(df, columns, weight)
    if about_origin:
        cov, mean = cov + np.outer(mean, mean), np.zeros(len(mean))
    var, vec = eigen(cov, k)
    return mean, vec, var


def projected(df: DataFrame, columns: list[str], mean: np.ndarray, basis: np.ndarray, prefix: str = "pc") -> DataFrame:
    out = {f"{prefix}{i}": sum(((F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(m)) * float(b) for c, m, b in zip(columns, mean, v, strict=True)), F.lit(0.0)) for i, v in enumerate(basis)}
    return df.withColumns(out)


def restored(df: DataFrame, columns: list[str], mean: np.ndarray, basis: np.ndarray, prefix: str = "pc") -> DataFrame:
    return df.withColumns({c: F.lit(float(m)) + sum((F.col(f"{prefix}{i}") * float(basis[i, j]) for i in range(len(basis))), F.lit(0.0)) for j, (c, m) in enumerate(zip(columns, mean, strict=True))})


def count_components(df: DataFrame, columns: list[str], share: float) -> int:
    """The least number whose residual sum of squares is below share squared of all."""
    _, cov, _ = moments(df, columns)
    w = np.sort(np.linalg.eigvalsh(cov))[::-1]
    for k in range(len(w) + 1):
        if w[k:].sum() < share * share * w.sum() or k == len(w):
            return k
    return len(w)


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    mean = df.agg(*(F.avg(c) for c in columns)).first()
    return df.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(columns, mean, strict=True)})


def centred_on_row(df: DataFrame, columns: list[str], order: str, r: int) -> DataFrame:
    row = df.where(F.col(order) == r).select(*columns).first()
    return df.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(columns, row, strict=True)})


def alignment(zipped: DataFrame, a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of both and the rotation that best turns b onto a (Kabsch), from one pass of sums."""
    n = len(a)
    mean, cov, _ = moments(zipped, [*a, *b])
    u, _, vt = np.linalg.svd(cov[n:, :n])
    d = np.ones(n)
    d[-1] = np.sign(np.linalg.det(u @ vt)) or 1.0
    return mean[:n], mean[n:], (u * d) @ vt


def aligned(zipped: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """b moved and turned onto a."""
    ma, mb, r = alignment(zipped, a, b)
    new = {c: F.lit(float(ma[j])) + sum(((F.col(x) - float(mb[i])) * float(r[i, j]) for i, x in enumerate(b)), F.lit(0.0)) for j, c in enumerate(b)}
    return zipped.withColumns(new)


def blended(zipped: DataFrame, a: list[str], b: list[str], share: float = 0.5) -> DataFrame:
    return aligned(zipped, a, b).withColumns({x: F.col(x) * (1 - share) + F.col(y) * share for x, y in zip(a, b, strict=True)})


def dihedral_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """The smallest cosine of principal angles between the row spaces."""
    q = lambda m: np.linalg.qr(np.asarray(m, float).T)[0]
    return float(np.linalg.svd(q(a).T @ q(b), compute_uv=False).min())
