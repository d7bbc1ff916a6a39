"""Exact deduplication that splits off heavy hitters.

Texts are compared by the SHA-256 digest of their text with each run of white space made one space. Misra-Gries summaries of the
partitions, merged, find every digest held by more than 2 / (counters + 1) of the rows; at most counters + 1 digests come out, so their
verified winners are broadcast and such rows are decided where they lie. The other digests go through an ordinary shuffle, in
which no group is large.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import boxed, documents, few, one_space, unboxed
from seqloom.session import checkpointed


def heavy_hitters(keys: DataFrame, counters: int) -> DataFrame:
    """The values of the one binary column of keys that more than 2 / (counters + 1) of its rows hold, and some others: (key, least), where
    least is at most the true count. There are at most counters + 1 rows."""
    total = keys.count()

    def summarise(batches):
        held: dict = {}
        for batch in batches:
            for x in batch.column(0).value_counts().to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > counters:  # take the count of rank counters + 1 from all
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["key", "least"])

    merged = keys.mapInArrow(summarise, "key binary, least long").groupBy("key").agg(F.sum("least").alias("least"))
    # a value above 2 n / (counters + 1) keeps more than n / (counters + 1) in the merged summary, and no more than counters + 1 values can
    return merged.where(F.col("least") * (counters + 1) > total)


def _digest() -> Column:
    return F.unhex(F.sha2(one_space(F.col("text").cast("string")).cast("binary"), 256))


def _split(docs: DataFrame, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of heavy hitters and other rows, both with doc_id, raw, digest, best, group_size and kept; and the heavy hitters: digest, best, group_size,
    counters + 1 rows at most."""
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("raw"),
        _digest().alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = checkpointed(keys)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "raw")
    hot = F.broadcast(heavy_hitters(keys.select("digest"), counters).select(F.col("key").alias("digest")))
    winners = keys.join(hot, "digest").groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = F.broadcast(checkpointed(winners))
    w = Window.partitionBy("digest")
    there = keys.join(winners, "digest", "left_anti").withColumns({"best": F.min(rank).over(w), "group_size": F.count(F.lit(1)).over(w)})
    kept = (F.col("row") == F.col("best.row")).alias("kept")
    columns = ["doc_id", "raw", "digest", "best", "group_size", kept]
    return keys.join(winners, "digest").select(*columns), there.select(*columns), winners


def decide(docs: DataFrame, counters: int = 16_384) -> DataFrame:
    """One row per row of docs: doc_id, raw (hash of the text as it is), digest, keep_id, group_size, kept.

    Of rows with equal normalised texts the smallest doc_id stays (null ids come last); of repeated rows with that id exactly one does.
    A null text is an empty one; long texts are read whole; an empty table gives none. Only doc_id and text are read, so that other columns
    may have any name.
    """
    here, there, _ = _split(docs, counters)
    return here.unionByName(there).select("doc_id", "raw", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", "kept")


def drop_exact(docs: DataFrame, counters: int = 16_384) -> DataFrame:
    """The rows of docs that stay, with all their columns. Copies of heavy hitters are dropped where they lie; of the others those to drop are
    broadcast if they are few, else rows and they meet by id. Odd rows: as decide() says."""
    here, there, winners = _split(docs, counters)
    twin = ~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))  # repeats an id with an equal text
    cold = checkpointed(there.where(~F.col("kept")).select("doc_id", "raw", twin.alias("twin")))
    best = winners.select(F.col("digest").alias("_digest"), F.col("best.doc_id").alias("_best"), F.col("best.raw").alias("_best_raw"))
    stays = F.col("_digest").isNull() | (F.col("doc_id").eqNullSafe(F.col("_best")) & (F.xxhash64("text") == F.col("_best_raw")))
    rest = boxed(docs).join(best, _digest() == F.col("_digest"), "left").where(stays).select("_row", "doc_id", "text") if winners.limit(1).count() else boxed(docs)
    dropped = cold.where(~F.col("twin")).select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"))
    same_id = F.col("doc_id").eqNullSafe(F.col("_id"))
    rest = rest.join(few(dropped, F.lit(2)), same_id & F.xxhash64("text").eqNullSafe(F.col("_raw")), "left_anti")
    twins = cold.where("twin").unionByName(here.select("doc_id", "raw", twin.alias("twin")).where("twin")).select(F.col("doc_id").alias("_id")).distinct()
    twins = checkpointed(twins)
    if twins.limit(1).count():  # rows that repeat an id with an equal text: one of each stays
        repeated = rest.join(twins, same_id, "left_semi").withColumn("_d", _digest())
        rest = rest.join(twins, same_id, "left_anti").unionByName(repeated.dropDuplicates(["doc_id", "_d"]).drop("_d"))
    return unboxed(rest)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = decide(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t
"""
