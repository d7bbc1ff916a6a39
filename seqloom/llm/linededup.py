"""Line deduplication by overlapping windows of three lines.

Consecutive lines are hashed three at a time. A window that was seen before, in an earlier document or further up, covers its three lines;
covered lines are removed. The first occurrence of each window is found by a minimum, taken before the shuffle; only windows that repeat are
joined back, each on one of several salts. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SPACE, boxed, documents, unboxed

_SIZE = 3


def covered_lines(docs: DataFrame, salts: int = 8) -> DataFrame:
    """doc_id, raw (hash of the text), covered: sorted numbers from 1 of the lines that repeated windows cover, for rows that have any."""
    trimmed = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x, i: F.struct(F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "").alias("line"), (i + 1).alias("at")))
    lines = F.filter(trimmed, lambda x: x["line"] != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), lines.alias("lines")).where(F.col("doc_id").isNotNull() & (F.size("lines") >= _SIZE))
    window = lambda i: F.struct(
        F.xxhash64(*(F.col("lines")[i + k]["line"] for k in range(_SIZE))).alias("h1"),
        F.hash(*(F.col("lines")[i + k]["line"] for k in range(_SIZE))).alias("h2"),
        F.array(*(F.col("lines")[i + k]["at"] for k in range(_SIZE))).alias("at"),
    )
    windows = rows.select("doc_id", "raw", F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - _SIZE), window)))
    place = F.struct("doc_id", F.col("at")[0].alias("start"))
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last"))
    firsts = firsts.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    later = windows.withColumn("salt", F.pmod(F.hash("doc_id", "at"), F.lit(salts))).join(firsts, ["h1", "h2", "salt"]).where(place > F.col("first"))
    return later.select("doc_id", "raw", F.explode("at").alias("n")).groupBy("doc_id", "raw").agg(F.array_sort(F.collect_set("n")).alias("covered"))  # lines of one document


def remove_repeated_lines(docs: DataFrame, salts: int = 8) -> DataFrame:
    """docs with text less its covered lines, and n_lines and n_removed.

    Lines are parted by \\n and compared without white space at their ends; blank lines belong to no window and stay. The first occurrence is
    that of the smallest doc_id, then of the smallest line number; rows with the same doc_id and text keep or lose the same lines. A null
    text has no lines and stays null; a row with null doc_id neither loses lines nor covers others'.
    """
    own = covered_lines(docs, salts).select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), "covered")
    df = boxed(docs).join(own, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_raw")), "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("at"))), lambda s: ~F.array_contains("covered", s["at"]))
    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    n_removed = F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered"))
    return unboxed(df, text=text, n_lines=n_lines.cast("long"), n_removed=n_removed.cast("long"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, pos, x, regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g') AS line FROM raw),
windows AS (
  SELECT doc_id, pos, lead(pos, 1) OVER w AS pos2, lead(pos, 2) OVER w AS pos3, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS r FROM windows WHERE l3 IS NOT NULL),
covered AS (
  SELECT doc_id, pos FROM ranked WHERE r > 1 UNION SELECT doc_id, pos2 FROM ranked WHERE r > 1 UNION SELECT doc_id, pos3 FROM ranked WHERE r > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed, coalesce(string_agg(CASE WHEN c.pos IS NULL THEN l.x END, chr(10) ORDER BY l.pos), '') AS body
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
