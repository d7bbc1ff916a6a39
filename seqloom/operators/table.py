"""Projection, filtering, order and set operations on tables whose row order means something; _ord numbers rows from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import checkpointed

ORD = "_ord"


def with_order(df: DataFrame, *keys: str) -> DataFrame:
    """df with _ord, from 0 without gaps, in the order of keys. Rows are sorted in ranges and counted by partition; no task sees them all."""
    ranged = checkpointed(df.sort(*(F.col(k).asc_nulls_first() for k in keys)).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = ranged.groupBy(part).count()  # one row for each partition
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    numbered = ranged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return numbered.withColumn(ORD, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")


def running(df: DataFrame, keys: list[Column], **sums: Column) -> DataFrame:
    """df with the sum of each of sums over its rows up to and with each, in the order of keys. Rows are sorted in ranges, and what the ranges before
    hold is added to the sums within each; no task sees all rows."""
    ranged = checkpointed(df.withColumns({f"_x_{n}": c for n, c in sums.items()}).sort(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums))  # one row for each range
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(up), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "_part").withColumns({n: F.col(f"_b_{n}") + F.sum(f"_x_{n}").over(own) for n in sums})
    return out.drop("_part", "_at", *(f"_{k}_{n}" for n in sums for k in "xb"))


def parse_columns(text: str, count: int) -> list[int]:
    """0,2-5,9-7: numbers and rising or falling ranges, without repeats, below count."""
    out: list[int] = []
    for part in text.replace(" ", "").split(","):
        a, _, b = part.partition("-")
        if not a.isdigit() or b and not b.isdigit():
            raise ValueError(f"not a column: {part}")
        a, b = int(a), int(b or a)
        out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
    if len(set(out)) < len(out) or any(i >= count for i in out):
        raise ValueError(f"repeated or missing columns: {text}")
    return out


def drop_columns(df: DataFrame, which: str) -> DataFrame:
    gone = set(parse_columns(which, len(df.columns)))
    return df.select(*(c for i, c in enumerate(df.columns) if i not in gone))


def swap_columns(df: DataFrame, a: int, b: int) -> DataFrame:
    names = list(df.columns)
    names[a], names[b] = names[b], names[a]
    return df.select(*names)


def columns_between(df: DataFrame, first: int, count: int) -> DataFrame:
    return df.select(*df.columns[first : first + count])


def labels_last(df: DataFrame, labels: list[str], ignore: list[str] = ()) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in labels and c not in ignore), *labels)


def add_index(df: DataFrame, start: float = 0, step: float = 1, name: str = "index") -> DataFrame:
    return df.select((F.lit(start) + F.col(ORD) * F.lit(step)).alias(name), *df.columns)


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def require_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, failing when run if one of those cells is null."""
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
    return df.withColumn(columns[0], F.when(bad, F.raise_error(F.lit("a value is missing")).cast(df.schema[columns[0]].dataType)).otherwise(F.col(columns[0])))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col(ORD) < n)


def last_rows(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col(ORD) >= df.agg(F.max(ORD) + 1 - n).first()[0])


def split_rows(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(ORD) < n), df.where(F.col(ORD) >= n)


def delete_row(df: DataFrame, i: int) -> DataFrame:
    """The rest move up."""
    return df.where(F.col(ORD) != i).withColumn(ORD, F.col(ORD) - (F.col(ORD) > i).cast("long"))


def split_by_pivot(df: DataFrame, column: str, pivot: float) -> tuple[DataFrame, DataFrame]:
    """Below, and the rest; missing values go to the larger side."""
    n = df.agg(F.count_if(F.col(column) < pivot), F.count_if(F.col(column) >= pivot)).first()
    low = F.coalesce(F.col(column) < pivot, F.lit(n[0] > n[1]))
    return df.where(low), df.where(~low)


def split_by_value(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """Equal, and the rest, missing ones too."""
    same = F.coalesce(F.col(column) == value, F.lit(False))
    return df.where(same), df.where(~same)


def replace_missing(df: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """Hot deck: a missing cell takes an observed value of its column, chosen by a hash of its row. Observed values are numbered in ranges and met by
    an equi join of the missing rows only."""
    for k, c in enumerate(columns):
        donors = with_order(df.where(F.col(c).isNotNull()).select(F.col(c).alias("_value")), "_value").withColumnRenamed(ORD, "_pick")
        n = donors.count()
        if not n:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)))
            continue
        known, open_ = df.where(F.col(c).isNotNull()), df.where(F.col(c).isNull())
        pick = F.pmod(F.xxhash64(F.col(ORD), F.lit(seed), F.lit(k)), F.lit(n))
        filled = open_.withColumn("_pick", pick).join(donors, "_pick").withColumn(c, F.col("_value")).drop("_pick", "_value")
        df = known.unionByName(filled)
    return df


def zip_join(*tables: DataFrame) -> DataFrame:
    """Side by side by _ord; an error when run unless all have as many rows. Names that come again get a suffix."""
    out = tables[0]
    for k, t in enumerate(tables[1:], 1):
        t = t.select(*(F.col(c).alias(c if c == ORD or c not in out.columns else f"{c}_{k}") for c in t.columns))
        out = out.withColumn("_left", F.lit(1)).join(t.withColumn("_right", F.lit(1)), ORD, "full")
        bad = F.col("_left").isNull() | F.col("_right").isNull()
        out = out.withColumn(ORD, F.when(bad, F.raise_error(F.lit("the tables have different numbers of rows")).cast("long")).otherwise(F.col(ORD))).drop("_left", "_right")
    return out


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of b after those of a, by position of the columns."""
    if len(a.columns) != len(b.columns):
        raise ValueError("different numbers of columns")
    b = b.toDF(*a.columns)
    if ORD in a.columns:
        b = b.withColumn(ORD, F.col(ORD) + (a.agg(F.max(ORD)).first()[0] + 1 if a.limit(1).count() else 0))
    return a.unionByName(b)


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Missing values first, or last if descending."""
    return df.sort(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first())


def reverse(df: DataFrame) -> DataFrame:
    top = df.agg(F.max(ORD)).first()[0]
    return df.withColumn(ORD, F.lit(top) - F.col(ORD))


def shuffle(df: DataFrame, seed: int = 0, *keys: str) -> DataFrame:
    """A permutation that depends on seed and keys (or _ord) only."""
    mixed = df.withColumn("_mix", F.xxhash64(F.lit(seed), *(keys or (ORD,))))
    return with_order(mixed.drop(ORD), "_mix").drop("_mix")


def line_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """side (a, b or both) and line, as bags."""
    left, right = a.select(column), b.select(column)
    tag = lambda df, s: df.select(F.lit(s).alias("side"), column)
    return tag(left.exceptAll(right), "a").unionByName(tag(right.exceptAll(left), "b")).unionByName(tag(left.intersectAll(right), "both"))


def transitions(df: DataFrame, partition: list[str], order: list[str], state: list[str], delta: bool = False) -> DataFrame:
    """df with next_<state>, its following row's state (or the difference to it); the last row of each partition is dropped."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in state}).withColumn("_more", F.lead(F.lit(1)).over(w)).where("_more = 1").drop("_more")
    return out.withColumns({f"next_{c}": F.col(f"next_{c}") - F.col(c) for c in state}) if delta else out


def set_column(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """df with a column's cells from values (_ord and one other column), which must have as many rows."""
    name = next(c for c in values.columns if c != ORD)
    both = zip_join(df.drop(column), values.select(ORD, F.col(name).alias(f"_set_{column}")))
    return both.select(*(F.col(f"_set_{c}").alias(c) if c == column else F.col(c) for c in df.columns))


def replace_row(df: DataFrame, i: int, row: dict) -> DataFrame:
    return df.withColumns({c: F.when(F.col(ORD) == i, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in row.items()})


def set_all(df: DataFrame, value, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.lit(value).cast(df.schema[c].dataType) for c in (columns or [c for c in df.columns if c != ORD])})


def copied(df: DataFrame) -> DataFrame:
    """A table of its own, which doesn't change with what df was made from."""
    return checkpointed(df)


def riffled(df: DataFrame) -> DataFrame:
    """The rows of both halves in turn, the first half first."""
    n = df.count()
    half = (n + 1) // 2
    return df.withColumn(ORD, F.when(F.col(ORD) < half, 2 * F.col(ORD)).otherwise(2 * (F.col(ORD) - half) + 1))
