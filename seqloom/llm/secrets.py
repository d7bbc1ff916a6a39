"""Secret scanning over a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived that every matching text satisfies. The index holds, for each
trigram that some query names, the sorted keys (64-bit hashes) of the texts that have it, in shards of the keys, so that no list grows with
the corpus. A query is answered shard by shard by intersecting and uniting its lists, and the texts found are verified by the rule's
expression; a rule without mandatory trigrams scans all texts. Texts that share a key share candidates, never matches. DataFrame
expressions only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import boxed, documents, few, unboxed
from seqloom.llm.spans import by_start, find_all, joined, let, no_spans, replaced
from seqloom.session import checkpointed

_parse, _MAX = re._parser, 48

ALL = ("all",)


def _and(parts: Iterable[tuple]) -> tuple:
    parts = sorted({p for x in parts for p in (x[1:] if x[0] == "and" else [x]) if p != ALL}, key=repr)
    return parts[0] if len(parts) == 1 else ("and", *parts) if parts else ALL


def _or(parts: Iterable[tuple]) -> tuple:
    parts = sorted(set(parts), key=repr)
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _literals(words: Iterable[str]) -> tuple:
    return _or(_and(("tri", w[i : i + 3]) for i in range(len(w) - 2)) for w in words)


def trigram_query(pattern: str) -> tuple:
    """A query ("tri", t), ("and", ...), ("or", ...) or ALL over lower-case trigrams that every text with a match satisfies."""

    def sequence(items) -> tuple[tuple, list[str] | None]:
        """Its query, and all strings it can be if those are few."""
        queries, run, exact = [], [""], True
        for op, arg in items:
            name, words = str(op), None
            if name == "LITERAL":
                words = [chr(arg).lower()]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                words = sorted({chr(a).lower() for _, a in arg})
            elif name == "SUBPATTERN":
                query, words = sequence(arg[-1])
                queries.append(query)
            elif name == "BRANCH":
                subs = [sequence(x) for x in arg[1]]
                queries.append(_or(q for q, _ in subs))
                words = None if any(w is None for _, w in subs) else [x for _, w in subs for x in w]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                query, words = sequence(arg[2])
                queries.append(query)
                if words is not None and arg[0] == arg[1] and len(words) == 1:
                    words = [words[0] * arg[0]]
                else:
                    words = None
            elif name == "AT":
                words = [""]
            longer = None if words is None else sorted({a + b for a in run for b in words})
            if longer is None or len(longer) > _MAX:
                queries.append(_literals(run))
                run, exact = [""], False
                if words is not None:
                    run = words
            else:
                run = longer
        return _and([*queries, _literals(run)]), run if exact else None

    return sequence(_parse.parse(pattern))[0]


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else {t for x in query[1:] for t in trigrams_of(x)}


@dataclass(frozen=True)
class SecretRule:
    """pattern: read alike by Python (to derive the query) and Java. passes: of a match, further conditions."""

    kind: str
    pattern: str
    passes: Callable[[Column], Column] | None = None


_ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE_RULES = [
    SecretRule("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 16),
    SecretRule("hex", r"[0-9a-f]{32,}"),  # the same spans as [0-9a-f]+ of 32 characters or more
]
MORE_RULES = [
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("bearer", r"[bB]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    SecretRule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@"),
]


@dataclass(frozen=True)
class TrigramIndex:
    """postings: trigram, shard, keys (of the texts that have the trigram, lower case, sorted; null where a shard has none)."""

    trigrams: list[str]
    postings: DataFrame

    @classmethod
    def build(cls, texts: DataFrame, queries: Iterable[tuple], shard_texts: int = 20_000) -> TrigramIndex:
        """Over texts (_key, _whole), for the trigrams of queries. A list has about shard_texts keys at most."""
        names = sorted({t for q in queries for t in trigrams_of(q)})
        among = F.array(*map(F.lit, names))
        held = let(F.lower("_whole"), lambda low: F.filter(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.contains(low, F.element_at(among, i))))
        hits = checkpointed(texts.select("_key", held.alias("held")))
        shards = max(1, -(-hits.count() // shard_texts))
        rows = hits.select("_key", F.pmod("_key", F.lit(shards)).alias("shard"), F.explode("held").alias("i")).groupBy("i", "shard").agg(F.array_sort(F.collect_set("_key")).alias("keys"))
        return cls(names, rows.select(F.element_at(among, F.col("i")).alias("trigram"), "shard", "keys"))

    def candidates(self, queries: Mapping[str, tuple]) -> DataFrame:
        """_key and kinds: the names of the queries that the text may satisfy. Queries that every text satisfies aren't looked up."""
        asked = {k: q for k, q in queries.items() if q != ALL}
        places = {t: i for i, t in enumerate(self.trigrams)}
        lists = [F.flatten(F.collect_list(F.when(F.col("trigram") == t, F.col("keys")))).alias(f"t{i}") for t, i in places.items()]  # one list each

        def answer(query: tuple) -> Column:
            if query[0] == "tri":
                return F.col(f"t{places[query[1]]}")
            out, *rest = map(answer, query[1:])
            for x in rest:
                out = F.array_intersect(out, x) if query[0] == "and" else F.array_union(out, x)
            return out

        found = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), answer(q).alias("keys")) for k, q in asked.items())))
        rows = self.postings.groupBy("shard").agg(*lists).select(found).select("kind", F.explode("keys").alias("_key"))
        return rows.groupBy("_key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # of one text


def find_secrets(docs: DataFrame, rules: list[SecretRule] | None = None) -> DataFrame:
    """docs with secrets: an array of (kind, start, end, value), sorted by start and then the order of the rules. A null text has none.
    Rows alike in text are answered alike, whatever their doc_id; an empty table gives none; a column of docs named secrets is replaced, and
    others may have any name. Long texts are read whole, in time and memory in proportion to them."""
    rows = _scanned(docs, rules)
    return unboxed(rows, secrets=F.col("_found"))


def _scanned(docs: DataFrame, rules: list[SecretRule] | None) -> DataFrame:
    rules = rules or [*BASE_RULES, *MORE_RULES]
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    df = boxed(docs).withColumn("_whole", F.coalesce("text", F.lit(""))).withColumn("_key", F.xxhash64("_whole"))
    if all(q == ALL for q in queries.values()):
        df = df.withColumn("kinds", F.lit(None).cast("array<string>"))
    else:
        found = TrigramIndex.build(df.select("_key", "_whole"), queries.values()).candidates(queries)
        df = df.join(few(checkpointed(found), 4 * F.size("kinds") + 1), "_key", "left")
    asked = lambda r: F.lit(True) if queries[r.kind] == ALL else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
    spans = [F.when(asked(r), find_all(F.col("_whole"), r.pattern, r.kind, r.passes)).otherwise(no_spans()) for r in rules]
    df = df.withColumn("_spans", F.concat(*spans))
    some = F.when(F.size("_spans") > 1, by_start(F.col("_spans"), [r.kind for r in rules])).otherwise(F.col("_spans"))
    # the always true condition keeps filters on the result from being pushed below and computing it twice
    return df.withColumn("_found", F.when(F.monotonically_increasing_id() >= 0, some))


def redact(docs: DataFrame, rules: list[SecretRule] | None = None) -> DataFrame:
    """docs with each secret in text, and what overlaps it, replaced by its kind in brackets. Odd rows: as find_secrets() says; a null text stays null."""
    label = lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))
    return unboxed(_scanned(docs, rules), text=F.when(F.size("_found") > 0, replaced(F.col("text"), F.col("_found"), label)).otherwise(F.col("text")))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = [r.kind for r in BASE_RULES]
    base = found.withColumn("_base", F.filter("secrets", lambda s: s["kind"].isin(kinds)))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return base.select("doc_id", *map(count, kinds), F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
