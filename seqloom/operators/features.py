"""Feature transforms that are fitted with one aggregation and applied as projections."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.text import STOP_WORDS, letters_tokens, porter_stem, stem
from seqloom.operators.aggregate import ranges
from seqloom.operators.table import with_order
from seqloom.session import checkpointed, few, stored


@dataclass(frozen=True)
class Normalize:
    """Columns mapped by their unbiased ranges onto low to high; a range below 1e-12 counts as 1; null stays null."""

    columns: dict[str, tuple[float, float]]
    low: float
    high: float

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0, unbiased: bool = True) -> Normalize:
        rows = ranges(df, columns, unbiased).collect()  # one for each column
        return cls({r["name"]: (r["low"] or 0.0, r["width"] if r["width"] and r["width"] >= 1e-12 else 1.0) for r in rows}, low, high)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - a) / w * (self.high - self.low) + self.low for c, (a, w) in self.columns.items()})

    def undo(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.low) / (self.high - self.low) * w + a for c, (a, w) in self.columns.items()})


@dataclass(frozen=True)
class Discretize:
    """Columns cut into equal widths, numbered from 0; undo gives middles."""

    columns: dict[str, tuple[float, float]]
    buckets: int

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], buckets: int | None = None, unbiased: bool = False) -> Discretize:
        rows = ranges(df, columns, unbiased).collect()
        k = buckets or max(2, int(math.sqrt(df.count() + 0.5)))
        return cls({r["name"]: (r["low"] or 0.0, r["width"] if r["width"] else 1.0) for r in rows}, k)

    def apply(self, df: DataFrame) -> DataFrame:
        k = self.buckets
        bucket = lambda c, a, w: F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor((F.col(c).cast("double") - a) * k / w))).cast("int")
        return df.withColumns({c: F.when(F.col(c).isNotNull(), bucket(c, a, w)) for c, (a, w) in self.columns.items()})

    def undo(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) + 0.5) * w / self.buckets + a for c, (a, w) in self.columns.items()})


@dataclass(frozen=True)
class OneHot:
    """Nominals of three values or more as a column for each; those of two as one column of 0 and 1. Missing: equal parts. Above most values: left alone."""

    values: dict[str, list]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], most: int = 12) -> OneHot:
        found = {}
        for c in columns:
            own = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
            if len(own) <= most:
                found[c] = own
        return cls(found)

    def apply(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, own in self.values.items():
            if len(own) == 2:
                out[c] = F.coalesce((F.col(c) == own[1]).cast("double"), F.lit(0.5))
            else:
                out |= {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(1.0 / max(1, len(own)))) for v in own}
        return df.withColumns(out).drop(*(c for c, v in self.values.items() if len(v) != 2))

    def undo(self, df: DataFrame) -> DataFrame:
        for c, own in self.values.items():
            if len(own) == 2:
                df = df.withColumn(c, F.when(F.col(c) >= 0.5, own[1]).otherwise(own[0]))
            else:
                best = F.greatest(*(F.col(f"{c}_{v}") for v in own))
                pick = F.coalesce(*(F.when(F.col(f"{c}_{v}") == best, F.lit(v)) for v in own))
                df = df.withColumn(c, pick).drop(*(f"{c}_{v}" for v in own))
        return df


def pair_products(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)})


def with_noise(df: DataFrame, columns: list[str], dev: float, seed: int = 0) -> DataFrame:
    return df.withColumns({c: F.col(c) + dev * F.randn(seed + i) for i, c in enumerate(columns)})


def noise_like(df: DataFrame, columns: dict[str, tuple[float, float]], seed: int = 0) -> DataFrame:
    return df.withColumns({c: m + d * F.randn(seed + i) for i, (c, (m, d)) in enumerate(columns.items())})


def _term_counts(docs: DataFrame, id_col: str, text: str, stemming: bool, least_length: int) -> DataFrame:
    """id, term, tf, stored: texts are read once, and words are stemmed where they lie."""
    words = docs.select(id_col, F.explode(F.transform(letters_tokens(F.col(text)), F.lower)).alias("term")).where(F.length("term") >= least_length)
    if stemming:
        words = words.withColumn("term", stem("term"))
    words = words.where(~F.col("term").isin([porter_stem(w) for w in STOP_WORDS] if stemming else STOP_WORDS))
    return stored(words.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def _of_term(counts: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """counts with what terms, checkpointed, hold of each term; a large vocabulary is hashed in parts, so that counts aren't sorted."""
    return counts.join(few(terms.hint("shuffle_hash"), F.lit(size)), "term")


def _weight(docs: DataFrame, id_col: str, binary: bool):
    if binary:
        return F.lit(1.0)
    return F.col("tf") * F.log(F.lit(float(docs.select(id_col).distinct().count())) / F.col("df")) / F.col("most")


def term_weights(docs: DataFrame, id_col: str, text: str, stemming: bool = True, least_length: int = 4, binary: bool = False) -> DataFrame:
    """id, term, tf, weight: tf * ln(documents / df) / the largest tf of the term (or 1 if binary), of lower-case letter runs of least_length or more that aren't
    stop words, stemmed."""
    counts = _term_counts(docs, id_col, text, stemming, least_length)
    if not binary:
        counts = _of_term(counts, checkpointed(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most"))), 3)
    return counts.select(id_col, "term", "tf", _weight(docs, id_col, binary).alias("weight"))


def term_matrix(docs: DataFrame, id_col: str, text: str, stemming: bool = True, least_length: int = 4, binary: bool = False) -> DataFrame:
    """row (id), col (number of the term in alphabetical order), val (weight) of term_weights. The vocabulary is numbered in sorted ranges and met once."""
    counts = _term_counts(docs, id_col, text, stemming, least_length)
    terms = counts.groupBy("term").agg(*([] if binary else [F.count(F.lit(1)).alias("df")]), F.max("tf").alias("most"))
    terms = checkpointed(with_order(checkpointed(terms), "term").withColumnRenamed("_ord", "col"))
    return _of_term(counts, terms, 4).select(F.col(id_col).alias("row"), "col", _weight(docs, id_col, binary).alias("val"))
