"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities: email addresses, IP addresses, payment cards, telephone numbers. A term discloses an entity when the
corpus hardly shows the one without the other: with document counts n over the corpus, the information of an entity is
IC(e) = log(N / n(e)), what a term tells of it is PMI(t, e) = log(N n(t, e) / (n(t) n(e))), and the term is taken out where PMI reaches
`disclosure` times IC and that many texts don't show both by chance: texts * (PMI - 1), a Chernoff bound on -log of that probability, must
reach -log(`chance`). What two or more texts show counts over whole documents; what a single one shows counts only within `near` terms of
the entity, on any line, as elsewhere in a document chance can't be told from a link. A term that discloses is taken out wherever it
stands in any document, but not from within an entity, which is generalised. Terms and entities are compared by 64-bit hashes. DataFrame
expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import boxed, documents, few, unboxed
from seqloom.llm.spans import find_all, in_order, is_head, joined, let, no_spans, reach, replaced, running
from seqloom.session import checkpointed

KINDS = ["email", "ip", "card", "phone"]

# Java recurses for each repetition of a group, but not of a possessive one; nothing that follows could need what such a group has taken.
_LOCAL = "[A-Za-z0-9._%+-]"
#: A match begins at the end of the last one or at the beginning of a run of local characters, which keeps the search linear.
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"[\p{L}\p{N}]+"
_MARK = ""  # stands for an entity among terms


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _is_ip(m: Column) -> Column:
    def small(part: Column) -> Column:
        d = F.regexp_replace(part, "^0+", "")
        return (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))

    return F.forall(F.split(m, r"\."), small)


def _luhn(m: Column) -> Column:
    def check(d: Column) -> Column:
        values = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
        return F.when(F.length(d).between(16, 19), F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0).otherwise(False)

    return let(_digits(m), check)


def entities(text: Column) -> Column:
    """The protected entities of a text as spans, by kind as listed, then start."""
    finds = [
        (F.contains(text, F.lit("@")), _EMAIL, "email", None),
        (text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), _IP, "ip", _is_ip),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _CARD, "card", _luhn),
        (text.rlike(r"\+[0-9]"), _PHONE, "phone", lambda m: F.length(_digits(m)).between(8, 15)),
    ]
    return F.concat(*(F.when(there, find_all(text, p, k, ok)).otherwise(no_spans()) for there, p, k, ok in finds))


def _masked(text: Column, spans: Column) -> Column:
    """text with a mark and line feeds in the place of its entities, of which each has five characters or more."""
    label = lambda s: F.concat(F.lit("\n" + _MARK), F.repeat(F.lit("\n"), s["end"] - s["start"] - 2))
    return F.when(F.size(spans) > 0, replaced(F.translate(text, _MARK, " "), spans, label)).otherwise(text)


def _key(term: Column) -> Column:
    return F.xxhash64(F.lower(term))


def _near(tokens: Column, spans: Column, near: int) -> Column:
    """For each entity its hash and those of the terms within near places of it. tokens: terms and marks, in order."""
    some = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    marks = some(F.transform(tokens, lambda t, i: F.when(t == _MARK, i + 1)))
    keys = F.transform(tokens, lambda t: F.when(t != _MARK, _key(t)))
    name = lambda s: F.xxhash64(F.concat_ws(":", s["kind"], s["value"])).alias("entity")

    def around(s: Column, i: Column, ms: Column, ks: Column, own: Column) -> Column:
        low = lambda at: F.greatest(F.lit(1), at - near)
        terms = let(F.get(ms, F.get(own, i) - 1), lambda at: F.array_distinct(some(F.slice(ks, low(at), at + near + 1 - low(at)))))
        return F.struct(name(s), terms.alias("terms"))

    def of(ordered: Column) -> Column:  # entities that overlap share a mark
        own = let(reach(ordered), lambda far: running(F.transform(ordered, lambda s, i: F.when(is_head(s, i, far), 1).otherwise(0))))
        return let(own, lambda o: let(marks, lambda ms: let(keys, lambda ks: F.transform(ordered, lambda s, i: around(s, i, ms, ks, o)))))

    return let(in_order(spans), of)


def _told(spans: Column, sorted_keys: Column) -> Column:
    """The spans whose key is in the array, by halving."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(sorted_keys))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def among(key: Column, steps: Column) -> Column:
        at = F.aggregate(steps, F.lit(-1), lambda at, s: F.when(F.get(sorted_keys, at + s) <= key, at + s).otherwise(at))
        return F.coalesce(F.get(sorted_keys, at) == key, F.lit(False))

    return let(steps, lambda st: F.filter(spans, lambda s: let(_key(s["value"]), lambda k: among(k, st))))


def _disclosing(seen: DataFrame, disclosure: float, chance: float) -> DataFrame:
    """term, n_term (documents): the hashes of the terms that disclose an entity."""
    total = float(max(1, seen.count()))
    holders = seen.where(F.size("base") > 0)
    firsts = holders.groupBy("raw").agg(F.min("row").alias("row")).select("row", F.lit(1).alias("first"))
    near = holders.select("row", F.inline("near"))
    held = near.select("row", "entity").distinct().join(firsts, "row", "left")
    n_entity = checkpointed(held.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"), F.count("first").alias("texts"), F.expr("bit_xor(xxhash64(row))").alias("where"), F.expr("bit_xor(xxhash64(row, 1))").alias("where2")
    ))
    n_term = seen.select(F.explode("own").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counts = (F.count(F.lit(1)).alias("n_both"), F.count("first").alias("n_texts"))

    # within reach: each entity meets 2 * near terms at most
    pairs = near.select("row", "entity", F.explode("terms").alias("term")).distinct().join(firsts, "row", "left")
    close = pairs.groupBy("entity", "term").agg(*counts).join(n_entity.select("entity", "n_entity"), "entity").select("n_entity", "term", "n_both", "n_texts")

    # over whole documents: entities of two texts or more; those that stand in the same documents are one, and PMI can't reach its mark for
    # a term in more than N ** (1 - disclosure) * n_entity ** disclosure documents
    most = lambda n: F.lit(total ** (1 - disclosure)) * F.pow(n, F.lit(disclosure)) * (1 + 1e-9)
    classes = held.join(n_entity.where("texts > 1"), "entity").select("row", "first", "n_entity", "where", "where2").distinct()
    rows = classes.groupBy("row", "first").agg(F.collect_list(F.struct("n_entity", "where", "where2")).alias("classes"), F.max("n_entity").alias("top"))  # of one document
    terms = holders.select("row", F.explode("own").alias("term")).join(rows.select("row", "top"), "row").join(n_term.where("n_term > 1"), "term").where(F.col("n_term") <= most(F.col("top")))
    met = terms.join(rows.drop("top"), "row").select("first", "term", "n_term", F.inline("classes")).where(F.col("n_term") <= most(F.col("n_entity")))
    wide = met.groupBy("n_entity", "where", "where2", "term").agg(*counts).where("n_texts > 1").select("n_entity", "term", "n_both", "n_texts")

    pmi = F.log(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    told = (pmi >= disclosure * F.log(F.lit(total) / F.col("n_entity"))) & (F.col("n_texts") * (pmi - 1) >= -math.log(chance))
    return close.unionByName(wide).join(n_term, "term").where(told).select("term", "n_term").distinct()


def find_private(docs: DataFrame, disclosure: float = 0.9, chance: float = 0.01, near: int = 16) -> DataFrame:
    """doc_id, raw (hash of the text), base (spans of the entities), terms (spans of the disclosing terms), one row per row of docs.

    A null text is empty. Repeated rows are reported alike, and count as documents, but as one text. Rows with null doc_id are rows like
    others. An empty table gives none. Only doc_id and text are read, so other columns may have any name. Texts of any length are read
    whole, in time and memory that grow in proportion to them.
    """
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("_text")).withColumn("raw", F.xxhash64("_text"))
    rows = slim.withColumn("base", entities(F.col("_text"))).withColumn("_tokens", F.regexp_extract_all(_masked(F.col("_text"), F.col("base")), F.lit(f"{_TERM}|{_MARK}"), F.lit(0)))
    own = F.array_distinct(F.transform(F.filter("_tokens", lambda t: t != _MARK), _key))
    around = F.when(F.size("base") > 0, _near(F.col("_tokens"), F.col("base"), near))
    seen = checkpointed(rows.select("doc_id", "raw", "base", own.alias("own"), around.alias("near"), F.monotonically_increasing_id().alias("row")))

    telling = checkpointed(_disclosing(seen, disclosure, chance))
    terms_of = lambda rows, some: rows.select("doc_id", "raw", F.explode("own").alias("term")).join(few(some, F.lit(2)), "term")
    held = checkpointed(terms_of(seen.where(F.size("base") > 0), telling))
    # most of these terms stand in documents with an entity only; only the others are looked for elsewhere
    n_held = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_held"))
    wide = checkpointed(telling.join(n_held, "term", "left").where(F.col("n_term") > F.coalesce("n_held", F.lit(0))).select("term", "n_term"))
    gone = held.unionByName(terms_of(seen.where(F.size("base") == 0), wide)).groupBy("doc_id", "raw").agg(F.array_sort(F.collect_set("term")).alias("gone"))  # of one document
    gone = checkpointed(gone.select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), "gone"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw"))
    affected = slim.join(few(gone, F.size("gone") + 4), same).withColumn("base", entities(F.col("_text"))).withColumn("_masked", _masked(F.col("_text"), F.col("base")))
    places = _told(find_all(F.col("_masked"), _TERM, "term"), F.col("gone"))
    terms = checkpointed(affected.select("_id", "_raw", places.alias("terms")).dropDuplicates(["_id", "_raw"]))
    out = seen.select("doc_id", "raw", "base").join(few(terms, 8 * F.size("terms") + 4), same, "left")
    return out.select("doc_id", "raw", "base", F.coalesce("terms", no_spans()).alias("terms"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with entities generalised to their kind and disclosing terms removed; other rows and columns as they are. Null texts, ties, repeated
    rows and clashing columns: as find_private() says; a null text stays null."""
    found = find_private(docs, **options).select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), F.concat("base", "terms").alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_id", "_raw"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_raw"))
    label = lambda s: F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rows = boxed(docs).join(found, same, "left")
    return unboxed(rows, text=F.when(F.col("_spans").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("_spans"), label)))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_private(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term"))
