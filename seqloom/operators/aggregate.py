"""Aggregations over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.table import running
from seqloom.session import checkpointed


def medians(df: DataFrame, columns: list[str], sketches: list[list[float] | None], counts: list[int]) -> list[float | None]:
    """The exact medians of columns, with counts known values each: values between the two of a sketch are counted, and ranks follow from those below.
    No task sees all values. Where the sketch misses the median, all values are counted."""

    def ranked(between: dict[int, list[float]]) -> dict[int, list[float]]:
        """The values at the two middle ranks of those columns, where they lie between the bounds ([]: anywhere)."""
        x = lambda i: F.col(columns[i]).cast("double")
        bounded = {i: v for i, v in between.items() if v}
        under = df.agg(F.lit(0).alias("n"), *(F.count_if(x(i) < v[0]).alias(f"n{i}") for i, v in bounded.items())).first() if bounded else {}
        inside = lambda i: x(i).between(*between[i]) if between[i] else x(i).isNotNull()
        some = df.select(*columns).where(reduce(Column.__or__, (F.coalesce(inside(i), F.lit(False)) for i in between)))
        values = some.select(F.explode(F.array(*(F.when(inside(i), F.struct(F.lit(i).alias("i"), x(i).alias("x"))) for i in between))).alias("v")).where("v is not null")
        tally = checkpointed(values.groupBy("v.i", "v.x").agg(F.count(F.lit(1)).alias("n")))
        total = {r["i"]: r["n"] for r in tally.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # one for each column
        start, wanted = 0, []
        for i in sorted(between):
            low = under[f"n{i}"] if between[i] else 0
            for rank in ((counts[i] + 1) // 2, counts[i] // 2 + 1):
                if low < rank <= low + total.get(i, 0):
                    wanted.append((i, start + rank - low))
            start += total.get(i, 0)
        hit = running(tally, [F.col("i"), F.col("x")], upto=F.col("n"))
        at = F.filter(F.array(*(F.lit(r).cast("long") for _, r in wanted)), lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n")))
        found: dict[int, list[float]] = {i: [] for i in between}
        for r in hit.select("i", "x", F.explode(at).alias("r")).orderBy("r").collect() if wanted else []:  # two of a column at most
            found[r["i"]].append(r["x"])
        return found

    known = {i: list(v) for i, v in enumerate(sketches) if counts[i]}
    found = ranked(known) if known else {}
    missed = {i: [] for i, v in found.items() if len(v) < 2}
    if missed:
        found |= ranked(missed)
    return [0.5 * found[i][0] + 0.5 * found[i][1] if i in found else None for i in range(len(columns))]


def column_stats(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """One row per column: n, missing, mean, dev (0 for fewer than two values), med, lo, hi. A scan of those columns, and another for the medians."""
    cells, sketches = [], []
    for c in columns:
        x = F.col(c).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("name"), F.count(x).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("missing"),
                F.round(F.avg(x), digits).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), digits).alias("dev"), F.min(x).alias("lo"), F.max(x).alias("hi"),
            )
        )
        sketches.append(F.percentile_approx(x, [0.497, 0.503], 1_000))  # ranks within 0.001
    first = checkpointed(df.agg(F.array(*cells).alias("rows"), F.array(*sketches).alias("sketches")))  # one row
    rows, bounds = first.first()
    middle = medians(df, columns, bounds, [r["n"] for r in rows])
    med = df.sparkSession.createDataFrame([(middle,)], "med array<double>")
    out = first.select(F.posexplode("rows").alias("i", "r")).crossJoin(F.broadcast(med))  # one row
    return out.select("r.name", "r.n", "r.missing", "r.mean", "r.dev", F.round(F.get("med", F.col("i")), digits).alias("med"), "r.lo", "r.hi")


def nominal_stats(df: DataFrame, column: str) -> DataFrame:
    """n, missing, n_values, mode (ties to the least value), mode_share, entropy in bits."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col("_v").isNotNull()
    n = F.when(known, F.col("_n"))
    total = F.sum(n)
    return counts.agg(
        F.coalesce(total, F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("missing"), F.count(n).alias("n_values"),
        F.min(F.when(known, F.struct((-F.col("_n")).alias("a"), F.col("_v").alias("v"))))["v"].alias("mode"), F.round(F.max(n) / total, 6).alias("mode_share"),
        F.round(F.log2(total) - F.sum(n * F.log2(n)) / total, 6).alias("entropy"),
    )


def baseline(df: DataFrame, column: str, nominal: bool):
    """The mean, or the most frequent value (ties to the least)."""
    return nominal_stats(df, column).select(F.col("mode").alias("baseline")) if nominal else df.agg(F.avg(column).alias("baseline"))


def is_homogenous(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*((F.min(c).eqNullSafe(F.max(c))).alias(c) for c in columns))


def centroid(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in columns))


def ranges(df: DataFrame, columns: list[str], unbiased: bool = False) -> DataFrame:
    """name, low, width by column. unbiased: the range raised to that expected of one more sample, low lowered by half the difference, which is added to
    the range once."""
    rows = []
    for c in columns:
        x = F.col(c).cast("double")
        n, low, width = F.count(F.lit(1)), F.min(x), F.max(x) - F.min(x)
        d = F.when(n > 1, 0.5 * (width * (n + 1) / (n - 1) - width)).otherwise(0.0) if unbiased else F.lit(0.0)
        rows.append(F.struct(F.lit(c).alias("name"), (low - d).alias("low"), (width + d).alias("width")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def covariances(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """a, b, cov, corr of all pairs, over rows where both are known, from sums in one pass; 0 where they don't vary."""
    rows = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
            cov = F.coalesce(F.covar_samp(x, y), F.lit(0.0))
            dev = F.coalesce(F.sqrt(F.var_samp(x)) * F.sqrt(F.var_samp(y)), F.lit(0.0))
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(cov, digits).alias("cov"), F.round(F.coalesce(F.try_divide(cov, dev), F.lit(0.0)), digits).alias("corr")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def origin_correlation(df: DataFrame, a: str, b: str):
    """About the origin, not the means: the cosine of the columns."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return df.where(x.isNotNull() & y.isNotNull()).agg(F.coalesce(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), F.lit(0.0)).alias("corr"))


def t_test_pooled(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    """t of the means with both variances pooled, and its 2 n - 2 degrees of freedom. normalize: rows are divided by their midpoint first."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    mid = F.abs(x + y) / 2
    if normalize:
        x, y = F.coalesce(F.try_divide(x, mid), F.lit(0.0)), F.coalesce(F.try_divide(y, mid), F.lit(0.0))
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(x.alias("x"), y.alias("y"))
    n = F.count(F.lit(1))
    t = F.abs(F.avg("x") - F.avg("y")) / F.sqrt((F.var_samp("x") + F.var_samp("y")) / n)
    return df.agg(F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), t.alias("t"), (2 * n - 2).alias("v"))


def wilcoxon(df: DataFrame, a: str, b: str, tolerance: float = 0.0) -> DataFrame:
    """n, w: the smaller sum of signed ranks; differences within tolerance of the one before are a tie and share the mean rank, and zeros count half to
    either side. Ranks come from counts of distinct differences, so the one window is over those."""
    d = df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).where("d is not null")
    counts = d.groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    w = Window.orderBy("m")
    tied = counts.withColumn("new", F.coalesce((F.col("m") - F.lag("m").over(w) > tolerance), F.lit(True)).cast("int")).withColumn("g", F.sum("new").over(w))
    g = tied.groupBy("g").agg(F.sum("n").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    g = running(g, [F.col("g")], upto=F.col("n")).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    plus, minus = F.sum(F.col("rank") * (F.col("up") + (F.col("n") - F.col("up") - F.col("down")) / 2)), F.sum(F.col("rank") * (F.col("down") + (F.col("n") - F.col("up") - F.col("down")) / 2))
    return g.agg(F.sum("n").alias("n"), F.least(plus, minus).alias("w"))


def sign_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    n = F.count(F.lit(1))
    return df.where(x.isNotNull() & y.isNotNull()).agg((F.count_if(x < y) / n).alias("less"), (F.count_if(x == y) / n).alias("same"), (F.count_if(x > y) / n).alias("more"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, weight: str | None = None) -> DataFrame:
    """bin, middle, n (weight), density; values out of range count only in the total that densities are parts of."""
    x = F.col(column).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    at = F.floor((x - low) * bins / (high - low))
    rows = df.where(x.isNotNull()).groupBy(F.when((x >= low) & (x < high), at).alias("bin")).agg(F.sum(w).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(rows, "bin", "left").crossJoin(F.broadcast(total))  # one row
    width = (high - low) / bins
    return every.select("bin", (low + (F.col("bin") + 0.5) * width).alias("middle"), F.coalesce("n", F.lit(0.0)).alias("n"), (F.coalesce("n", F.lit(0.0)) / width / F.col("total")).alias("density"))


def autocorrelation(df: DataFrame, partition: list[str], order: list[str], column: str, lags: int) -> DataFrame:
    """lag, value: the mean of (x_k - m)(x_(k+lag) - m) over pairs, with the partition's mean m."""
    w = Window.partitionBy(*partition).orderBy(*order)
    x = df.withColumn("_d", F.col(column).cast("double") - F.avg(F.col(column).cast("double")).over(Window.partitionBy(*partition)))
    pairs = x.select(*partition, F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("_d") * F.lead("_d", k).over(w)).alias("p")) for k in range(1, lags + 1))).alias("pairs"))
    return pairs.select(*partition, F.inline("pairs")).where("p is not null").groupBy(*partition, "lag").agg(F.avg("p").alias("value"))


def mean_squared_errors(zipped: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return zipped.agg(*(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).alias(f"mse_{a}") for a, b in pairs))


def squared_distance(zipped: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    cell = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in pairs), F.lit(0.0))
    return zipped.agg(F.sum(cell).alias("sum"), F.avg(cell).alias("mean"))


def precision_curve(df: DataFrame, confidence: str, positive: str, tie: str) -> DataFrame:
    """For each positive by falling confidence, ties in the order of tie: recalled so far and precision."""
    out = running(df, [F.col(confidence).desc(), F.col(tie)], seen=F.lit(1), recalled=F.coalesce(F.col(positive).cast("int"), F.lit(0)))
    return out.where(F.col(positive)).select(tie, "recalled", (F.col("recalled") / F.col("seen")).alias("precision"))


def label_information(df: DataFrame, label: str, nominal: bool = True) -> DataFrame:
    """information: the entropy in bits of a nominal label, or the variance of a real one."""
    if not nominal:
        return df.agg(F.coalesce(F.var_samp(F.col(label).cast("double")), F.lit(0.0)).alias("information"))
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("information"))
