"""Substring deduplication with fixed-block anchors.

A word is removed when it lies in a run of `window` words that also starts in a document with a smaller id. Such a run always
holds one whole block of a document cut into blocks of `window // 2` words. So:

1. every document's non-overlapping blocks are indexed and every rolling run of that length probes the index;
2. each hit is extended: all windows around it, on both sides, are compared by their own hash with the smallest id that has them;
   the windows found make up maximal repeats, whose words are removed.

Documents are held in buckets of bounded size by a hash of doc_id and text. A bucket sends each distinct hash once, however often a hot
passage stands in it, as sorted packed differences; an answer is one bit for each hash sent, so that neither pairs of documents nor lists
of members of a group ever exist. The texts move once, in one exchange which all three passes read.

Hashes meet in shards. There are as many shards as buckets while that leaves 1,000 hashes or more for each shard in a bucket; beyond, hashes
meet in regions first, where as many buckets as there are regions are merged into a node of a bucket's size, and nodes send what they
have to the shards of their region. So the hashes in a task stay in proportion to bucket_bytes up to a number of buckets of the third
power of (bucket_bytes / 6,000): some 10 ** 10 buckets, which is far beyond the 10 ** 7 of 100 TB.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import documents, mix64, rolling, text_buffers, word_hashes

_CELL = "shard int, bucket int, n int, payload binary"
_ANSWER = "bucket int, kind int, shard int, n int, bits binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


_PROBE, _WINDOW = 1, 2  # kinds of numbers that are exchanged


def _pack(v: np.ndarray) -> bytes:
    """Sorted numbers as 32-bit differences, or as they are if one doesn't fit."""
    d = np.diff(v, prepend=np.uint64(0))
    return b"\1" + d.astype("<u4").tobytes() if len(d) == 0 or d.max() < 2**32 else b"\0" + v.astype("<u8").tobytes()


def _unpack(b: bytes, n: int) -> np.ndarray:
    if b[:1] == b"\1":
        return np.cumsum(np.frombuffer(b, "<u4", n, 1).astype(np.uint64), dtype=np.uint64)
    return np.frombuffer(b, "<u8", n, 1).astype(np.uint64)


def _encode(kind: int, v: np.ndarray, x: np.ndarray) -> bytes:
    """Sorted numbers with what is told of each: whether it is a block (probes), or the smallest id (windows)."""
    if kind == _PROBE:
        return np.packbits(x).tobytes() + _pack(v)
    base = int(x.min()) if len(x) else 0
    wide = bool(len(x)) and int(x.max()) - base >= 2**32
    return np.array([base, int(wide)], "<i8").tobytes() + v.astype("<u8").tobytes() + (x - base).astype("<i8" if wide else "<u4").tobytes()


def _decode(kind: int, n: int, p: bytes) -> tuple[np.ndarray, np.ndarray]:
    if kind == _PROBE:
        return _unpack(p[-(-n // 8) :], n), np.unpackbits(np.frombuffer(p, np.uint8, -(-n // 8)), count=n).astype(np.int64)
    base, wide = np.frombuffer(p, "<i8", 2)
    return np.frombuffer(p, "<u8", n, 16).astype(np.uint64), np.frombuffer(p, "<i8" if wide else "<u4", n, 16 + 8 * n).astype(np.int64) + base


class _Meeting:
    """The numbers that several senders have sent. values: the distinct ones, sorted; told: of each; place: of each number sent among them;
    found: for each number sent, whether it is a hit by what is known here."""

    def __init__(self, kind: int, cells: pa.Table):
        parts = [_decode(kind, n, p) for n, p in zip(cells.column("n").to_pylist(), cells.column("payload").to_pylist(), strict=True)]
        v, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(v, kind="stable")
        s = v[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        begin = np.flatnonzero(new)
        self.values = s[begin]
        self.place = np.empty(len(v), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.told = (np.maximum if kind == _PROBE else np.minimum).reduceat(x[order], begin)
        if kind == _PROBE:
            self.found = ((np.diff(np.append(begin, len(v))) > 1) & (self.told > 0))[self.place]
        else:
            self.found = self.told[self.place] < x


class _Bucket:
    """Hashes of the documents of one bucket; the same content gives the same lists in any order of rows."""

    def __init__(self, ids, text, window: int, shards: int):
        self.window, self.block, self.shards = window, window // 2, shards
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.named = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.data, self.off = text_buffers(text)
        self.words, self.at = word_hashes(self.data, self.off)
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        self.left = self.at[1:][self.doc] - np.arange(n)  # words from here to the document's end
        self.left[~self.named[self.doc]] = 0  # a document without an id neither removes nor loses words
        self.runs = mix64(rolling(self.words, self.block))

    def probes(self):
        """Distinct hashes of all rolling runs, by shard and value; whether one is an aligned block; the place of each run in that list; whether a hit is inside the bucket."""
        where = np.flatnonzero(self.left[: len(self.runs)] >= self.block)
        h = self.runs[where]
        key = ((h % np.uint64(self.shards)) << np.uint64(40)) | (h >> np.uint64(24))
        keys, inverse = np.unique(key, return_inverse=True)
        aligned = (where - self.at[:-1][self.doc[where]]) % self.block == 0
        is_block = np.zeros(len(keys), bool)
        is_block[inverse[aligned]] = True
        low = np.full(len(keys), len(self.ids), np.int64)
        high = np.full(len(keys), -1, np.int64)
        np.minimum.at(low, inverse, self.doc[where])
        np.maximum.at(high, inverse, self.doc[where])
        return keys, is_block, where, inverse, is_block & (low < high)

    def candidates(self, hit: np.ndarray, where: np.ndarray, inverse: np.ndarray):
        """Starts of the windows that hold a hit; their distinct hashes, by shard and value, with the smallest id here."""
        mark = np.zeros(len(self.words) + 1, np.int32)
        mark[where[hit[inverse]] + 1] = 1
        mark = np.cumsum(mark, dtype=np.int32)
        n = max(0, len(self.words) - self.window + 1)
        span = self.window - self.block + 1
        start = np.flatnonzero((self.left[:n] >= self.window) & (mark[span : span + n] > mark[:n]))
        h = mix64(rolling(self.words, self.window)[start] if len(start) else np.zeros(0, np.uint64))
        order = np.lexsort((h, h % np.uint64(self.shards)))
        h, new = h[order], np.ones(len(order), bool)
        new[1:] = h[1:] != h[:-1]
        inverse2 = np.empty(len(order), np.int64)
        inverse2[order] = np.cumsum(new) - 1
        first = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse2, self.ids[self.doc[start]])
        return h[new], first, start, inverse2


def _bits(table: pa.Table, kind: int, shard: np.ndarray) -> np.ndarray:
    """The answers to what this bucket sent, in the order sent. shard: of each number sent."""
    told = np.zeros(len(shard), bool)
    if table.num_rows:
        for k, s, n, b in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "n", "bits")), strict=True):
            if k == kind:
                at = np.searchsorted(shard, s)
                told[at : at + n] = np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
    return told


def _cells(shard: np.ndarray, bucket: int, payload) -> pa.Table:
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(cuts, len(shard))[1:]
    rows = [(int(shard[a]), bucket, int(b - a), payload(a, b)) for a, b in zip(cuts, ends, strict=True)]
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["shard", "bucket", "n", "payload"])


def _answers(cells: pa.Table, kind: int, told: np.ndarray) -> pa.Table:
    n, out, at = cells.column("n").to_pylist(), [], 0
    for x in n:
        out.append(np.packbits(told[at : at + x]).tobytes())
        at += x
    return pa.table(
        [cells.column("bucket"), pa.array([kind] * len(n), pa.int32()), cells.column("shard"), cells.column("n"), pa.array(out, pa.binary())],
        names=["bucket", "kind", "shard", "n", "bits"],
    )


def remove_repeats(docs: DataFrame, window: int = 50, bucket_bytes: int = 10_000_000, with_text: bool = True) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by one space) and its kept_sha256.

    docs needs doc_id and text; other columns are not looked at. A null text has no words; an empty table gives none. A row with null doc_id
    loses no word and removes none, as no id is smaller or larger. Rows with the same doc_id don't remove each other's words. Equal
    rows give equal results. bucket_bytes: of text that one task holds at once, if no document is longer, and in proportion to which its
    memory grows. The number of packed cells falls with its square.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    most = max(2, bucket_bytes // 6 // 1000)
    shards = min(buckets, most)
    nodes = -(-buckets // most)  # for each region, which shards are if there are several nodes
    inner = min(nodes, most)  # shards of a region
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", F.xxhash64("text")))
    base = slim.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int")).repartition(buckets, "bucket")

    def shard1(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(40)).astype(np.int64)

    def send_probes(k, t):
        b = _Bucket(t.column("doc_id"), t.column("text"), window, shards)
        keys, is_block, _, _, _ = b.probes()
        low = keys & np.uint64((1 << 40) - 1)
        return _cells(shard1(keys), k[0].as_py(), lambda x, y: _encode(_PROBE, low[x:y], is_block[x:y]))

    def met(cells: DataFrame, kind: int) -> DataFrame:
        """The answers to what buckets have sent."""

        def inner_shard(k, values):
            top = values if kind == _PROBE else values >> np.uint64(24)  # 40 bits
            return k[0].as_py() // nodes * inner + ((top * np.uint64(inner)) >> np.uint64(40)).astype(np.int64)

        def lift(k, t):
            m = _Meeting(kind, t)
            return _cells(inner_shard(k, m.values), k[0].as_py(), lambda x, y: _encode(kind, m.values[x:y], m.told[x:y]))

        def lower(k, t, answers):
            m = _Meeting(kind, t)
            return _answers(t, kind, m.found | _bits(answers, kind, inner_shard(k, m.values))[m.place])

        def join(t):
            return _answers(t, kind, _Meeting(kind, t).found)

        if nodes == 1:
            return cells.repartition(shards, "shard").groupBy("shard").applyInArrow(join, _ANSWER)
        node = (F.col("shard") * nodes + F.pmod("bucket", F.lit(nodes))).cast("int")
        below = cells.withColumn("node", node).repartition(shards * nodes, "node")
        sent = below.groupBy("node").applyInArrow(lift, _CELL).repartition(shards * inner, "shard")
        back = sent.groupBy("shard").applyInArrow(join, _ANSWER).withColumnRenamed("bucket", "node").repartition(shards * nodes, "node")
        return below.groupBy("node").cogroup(back.groupBy("node")).applyInArrow(lower, _ANSWER)

    def extended(t, answers):
        b = _Bucket(t.column("doc_id"), t.column("text"), window, shards)
        keys, _, where, inverse, here = b.probes()
        hit = here | _bits(answers, _PROBE, shard1(keys))
        return b, *b.candidates(hit, where, inverse)

    def send_windows(k, t, answers):
        b, h, first, _, _ = extended(t, answers)
        return _cells((h % np.uint64(shards)).astype(np.int64), k[0].as_py(), lambda x, y: _encode(_WINDOW, h[x:y], first[x:y]))

    def clean(k, t, answers):
        b, h, first, start, inverse = extended(t, answers)
        told = _bits(answers, _WINDOW, (h % np.uint64(shards)).astype(np.int64))
        gone = start[told[inverse] | (first[inverse] < b.ids[b.doc[start]])]
        step = np.zeros(len(b.words) + 1, np.int32)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + window, -1)
        keep = np.cumsum(step[:-1]) == 0
        n_words = np.diff(b.at)
        n_keep = np.diff(np.concatenate([[0], np.cumsum(keep)])[b.at])
        kept, sha, data = [], [], b.data.tobytes()
        for i in range(len(n_words)):
            w = data[b.off[i] : b.off[i + 1]].split()
            if n_keep[i] < n_words[i]:
                w = [w[j] for j in np.flatnonzero(keep[b.at[i] : b.at[i + 1]])]
            joined = b" ".join(w)
            sha.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept.append(joined.decode("utf-8", "surrogatepass"))
        cols = [t.column("doc_id"), pa.array(n_words), pa.array(n_words - n_keep), pa.array(kept, pa.string()) if with_text else pa.nulls(len(sha), pa.string()), pa.array(sha, pa.string())]
        return pa.table(cols, names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    told1 = met(base.groupBy("bucket").applyInArrow(send_probes, _CELL), _PROBE)
    told2 = met(base.groupBy("bucket").cogroup(told1.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(send_windows, _CELL), _WINDOW)
    told = told1.unionByName(told2).repartition(buckets, "bucket")
    return base.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(clean, _RESULT)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False).drop("kept_text")
