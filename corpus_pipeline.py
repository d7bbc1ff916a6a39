"""The corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from dataclasses import replace

from seqloom.llm import exact, minhash, mixing, packing, quality
from seqloom.session import release, stored

#: Nine tenths of what the earlier stages keep, each document once at most.
MIXTURE = replace(mixing.PRODUCTION, ratio=0.9, max_epochs=1)

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality.keep_good(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact.drop_exact(docs)),
    ("near dedup", lambda spark, docs, sf_dir: minhash.drop_near(docs)),
    ("source mixing", lambda spark, docs, sf_dir: mixing.take(docs, MIXTURE)),
    ("best-fit packing", lambda spark, docs, sf_dir: packing.pack_documents(docs)),
]

#: Near-duplicate classes and token ids can't be expressed in SQL; tests/llm hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage. What a stage has written is deleted when the next one's rows are; the last stage's input stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        release(spark, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
