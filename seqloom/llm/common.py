"""What several operators share: white space, exact normalisation and vectorised word hashes over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def one_space(text: Column) -> Column:
    """text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def words(text: Column) -> Column:
    """The words of text as an array, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E6D62D06F6A3D5B)
_SEQ = np.uint64(0xD1342543DE82EF95)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len+1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about that many bytes, in order; a longer text is alone in its range."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the len+1 offsets of each text's words among them. Works through whole texts in bounded pieces."""
    found, counts = [], np.zeros(len(off) - 1, np.int64)
    for a, b in pieces(off):
        d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        if len(d) == 0:
            continue
        isw = ~_IS_SPACE[d]
        start = isw.copy()
        start[1:] &= ~isw[:-1]
        heads = o[:-1][o[:-1] < o[1:]]
        start[heads] = isw[heads]
        starts = np.flatnonzero(start)
        if len(starts) == 0:
            continue
        at = np.searchsorted(starts, o)
        counts[a:b] = np.diff(at)
        reach = np.diff(np.append(starts, len(d)))
        local = np.arange(starts[0], len(d)) - np.repeat(starts, reach)
        power = np.full(int(local.max()) + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        value = _BYTE[d[starts[0] :]]
        value *= power[local]
        value *= isw[starts[0] :]
        found.append(mix64(np.add.reduceat(value, starts - starts[0])))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive elements of h (len(h) - k + 1 of them), by doubling. Not mixed."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    done, size, have, width = None, 0, h, 1
    base = _SEQ
    while True:
        if k & width:
            if done is None:
                done, size = have, width
            else:
                n = len(h) - size - width + 1
                done = done[:n] * base + have[size : size + n]
                size += width
        if width * 2 > k:
            return done
        n = len(have) - width
        have = have[:n] * base + have[width : width + n]
        base = np.uint64(int(base) ** 2 % 2**64)
        width *= 2


def boxed(docs: DataFrame) -> DataFrame:
    """_row (a struct of all columns of docs), doc_id (long) and text (string): names of other columns can't clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unboxed(rows: DataFrame, **changed: Column) -> DataFrame:
    """The columns of _row, with those in changed replaced, or added after them."""
    names = rows.schema["_row"].dataType.names
    own = [changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in names]
    return rows.select(*own, *(v.alias(k) for k, v in changed.items() if k not in names))


#: Numbers in a table that is broadcast, at most.
SMALL = 1_000_000


def few(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df, checkpointed already, with a hint to broadcast it if the sum of size (of numbers in a row, 1 by default) over its rows is SMALL at most."""
    total = df.agg(F.coalesce(F.sum(F.lit(1) if size is None else size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= SMALL else df
