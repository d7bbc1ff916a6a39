"""Best-fit packing with certified bin counts.

Documents become token pieces of at most `capacity` ids. Pieces are packed partition by partition with best-fit decreasing, on counts of
equal lengths; lower bounds from dual-feasible functions certify a partition's number of sequences where they meet it. Partitions with a
gap exchange the documents of their unfilled sequences and run best-fit decreasing again, as long as that saves sequences.
"""

from __future__ import annotations

import array
import json
import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import documents
from seqloom.session import checkpointed

#: How the tokenizer's byte-level vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class Encoder:
    """Token ids of a byte-level BPE read from a tokenizers JSON file, the same ids as that library gives by default with
    add_special_tokens=False: added tokens that stand in a text are ids by themselves, and the text between them is encoded part by part.

    A space between two other characters always begins a new part, so that text is cut there and the ids of most words come from a table
    of at most `table` words. Parts whose spaces don't lie so are encoded whole.
    """

    def __init__(self, path: str, table: int = 300_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(visible))}
        added = spec.get("added_tokens", [])
        if any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be plain literals")
        special = {t["content"]: array.array("I", [t["id"]]).tobytes() for t in added}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Table(dict):
            def __missing__(self, word):
                if not word or word[0].isspace() or word[-1].isspace():
                    raise LookupError
                ids = array.array("I", encode(" " + word)).tobytes()
                if len(self) < table and len(word) < 64:
                    self[word] = ids
                return ids

        self._encode, self._ids, self._special = encode, Table().__getitem__, special
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda text: [text]

    def _part(self, text: str) -> bytes:
        try:
            first, *rest = text.split(" ")
            if first and first[-1].isspace():
                raise LookupError
            return array.array("I", self._encode(first)).tobytes() + b"".join(map(self._ids, rest))
        except LookupError:
            return array.array("I", self._encode(text)).tobytes()

    def encode(self, text: str, most: int = 500_000) -> bytes:
        """The ids as unsigned 32-bit numbers."""
        return b"".join(self._special[x] if i % 2 else self._plain(x, most) for i, x in enumerate(self._split(text)))

    def _plain(self, text: str, most: int) -> bytes:
        """Of a text without added tokens. Long texts are cut at spaces between other characters."""
        out, at = [], 0
        while len(text) - at > most and (cut := _CUT.search(text, at + most)):
            out.append(self._part(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self._part(text[at:])])


def _encoder(path: str) -> Encoder:
    """One for each Python process, which serves many tasks. This module is sent by value and made anew for each task, so that the encoders
    are kept in a module of their own."""
    held = sys.modules.setdefault("_seqloom_encoders", types.ModuleType("_seqloom_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and a final 0, of which longer ones are cut into pieces of capacity; the first may be shorter.
    One row per piece: doc_id, piece, start, length, ids_crc32, ids (little-endian 32-bit; null without with_ids). A null text is empty; repeated
    rows have pieces of their own; an empty table has none. Only doc_id and text are read, so other columns may have any name. A long text
    is encoded whole, in parts that don't change its ids."""

    def run(batches):
        enc = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    begin, end, k = 0, n % capacity or capacity, 0
                    while begin < n:
                        cut = ids[4 * begin : 4 * end]
                        out.append((doc_id, k, begin, end - begin, zlib.crc32(cut), cut if with_ids else None))
                        begin, end, k = end, end + capacity, k + 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of each item, and the number of bins. Items of a length are placed together, as one after the other would be."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: dict[int, list[np.ndarray]] = {}
    mask, used = 0, 0
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts, len(order))[1:], strict=True):
        s, a, b = int(lengths[order[a]]), int(a), int(b)
        while a < b:
            if fits := mask >> s:
                room = (fits & -fits).bit_length() - 1 + s
                own = np.concatenate(free.pop(room))
                mask ^= 1 << room
            else:
                room = capacity
                need = -(-(b - a) // (room // s))
                own = np.arange(used, used + need)
                used += need
            each = room // s
            take = min(len(own), -(-(b - a) // each))
            n = min(b - a, take * each)
            at = order[a : a + n]
            bins[at] = np.repeat(own[:take], each)[:n]
            offsets[at] = capacity - room + s * (np.arange(n) % each)
            last = n - (take - 1) * each
            for left, which in ((room - each * s, own[: take - 1]), (room - last * s, own[take - 1 : take]), (room, own[take:])):
                if left > 0 and len(which):
                    free.setdefault(left, []).append(which)
                    mask |= 1 << left
            a += n
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int, most: int = 50) -> int:
    """The largest bound on the number of bins that these dual-feasible functions give: for each threshold up to half the capacity, larger
    items counted whole and smaller ones not at all; and for each k up to most, sizes rounded down to k-ths."""
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    k = np.arange(capacity // 2 + 1)
    whole = n[-1] - n[capacity - k + 1]
    best = int((whole * capacity + total[capacity - k + 1] - total[k] + capacity - 1).max() // capacity)
    for k in range(1, most + 1):
        f = np.where((k + 1) * size % capacity == 0, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((f * count).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = 2048, part_items: int = 200_000, rounds: int = 3) -> DataFrame:
    """pieces (with length, at most capacity) and where each goes: sequence_id, offset (gapless from 0), certified (its partition's number of
    sequences is proven least), lower_bound and sequences of that partition. Pieces of full length are sequences by themselves. Pieces of equal
    length go in the order of a checkpoint, so that lost tasks give the same places again. Other columns stay; those named like a result clash."""
    pieces = checkpointed(pieces.withColumn("_uid", F.monotonically_increasing_id()))
    names = [c for c in pieces.columns if c != "_uid"]
    full = pieces.where(F.col("length") == capacity).select(
        *names, (-1 - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"), F.lit(1).cast("long").alias("lower_bound"), F.lit(1).cast("long").alias("sequences")
    )
    open_ = pieces.where(F.col("length") < capacity)
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*names, "_uid"]), "sequence_id long, offset long, certified boolean, lower_bound long, sequences long, _fill long"])

    def run_round(rows: DataFrame, parts: int, number: int) -> DataFrame:
        def bfd(key, t):
            length = np.asarray(t.column("length").combine_chunks()).astype(np.int64)
            order = np.argsort(np.asarray(t.column("_uid").combine_chunks()), kind="stable")
            t, length = t.take(pa.array(order)), length[order]
            b, off, used = best_fit_decreasing(length, capacity)
            bound = lower_bound(length, capacity)
            fill = np.bincount(b, weights=length, minlength=used).astype(np.int64)
            one = np.ones(len(b), np.int64)
            more = [(number << 58) + (key[0].as_py() << 32) + b, off, pa.array(one * (bound == used), pa.int64()).cast(pa.bool_()), one * bound, one * used, fill[b]]
            return pa.table([*(t.column(c) for c in [*names, "_uid"]), *(pa.array(x) for x in more)], names=[*names, "_uid", "sequence_id", "offset", "certified", "lower_bound", "sequences", "_fill"])

        rows = rows.select(*names, "_uid", F.pmod(F.xxhash64("_uid", F.lit(number)), F.lit(parts)).alias("_part"))
        return checkpointed(rows.groupBy("_part").applyInArrow(bfd, schema))

    done = run_round(open_, max(1, -(-open_.count() // part_items)), 0)
    settled = []
    for number in range(1, rounds + 1):
        loose = (~F.col("certified")) & (F.col("_fill") < capacity)
        old = done.where(loose).agg(F.countDistinct("sequence_id"), F.count(F.lit(1)), F.countDistinct(F.shiftright("sequence_id", 32))).first()
        if old[2] < 2:  # nobody to exchange with
            break
        again = run_round(done.where(loose), max(1, -(-old[1] // part_items)), number)
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= old[0]:
            break
        settled.append(done.where(~loose))
        done = again
    for other in settled:
        done = done.unionByName(other)
    return done.select(*full.columns).unionByName(full)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """The token pieces of docs and where each goes: what token_pieces() and pack() return, ids only with with_ids. Null texts are documents of one
    id, repeated rows are packed each, an empty table gives nothing, and columns but doc_id and text are not looked at."""
    found = pack(token_pieces(docs, tokenizer or default_tokenizer(), capacity, with_ids), capacity)
    return found if with_ids else found.drop("ids")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
