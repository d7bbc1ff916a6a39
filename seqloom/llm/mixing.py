"""Mixing sources to target weights by hierarchical budgeting.

Weights lie on a tree of domains, languages and sources. A token budget flows down it in proportion to weight; a child that can't use its share
(its documents, repeated max_epochs times, hold fewer tokens) leaves the rest to its siblings, and only what a whole family can't use goes to
the siblings of their parent. A leaf takes whole epochs and then a prefix of one more, in that epoch's seeded order.

Prefixes are found without sorting a leaf: tokens are summed by leaf and slice of the order, and only the slice in which a budget ends is
ordered. The tree stays a table, of any number of leaves; one of few is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import boxed, documents, few, unboxed, words
from seqloom.session import checkpointed

_SLICES = 4096
_KEYS = ["_domain", "_lang", "_source"]


@dataclass(frozen=True)
class Mixture:
    """domains: which sources each domain has; others are of domain `other`. weights: of a path, (domain,), (domain, lang) or
    (domain, lang, source), where * stands for any name; without one `default`. ratio: tokens taken, as a share of all. Among siblings only the
    ratio of weights matters."""

    domains: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    default: float = 1.0
    ratio: float = 1.0
    max_epochs: int = 2
    seed: int = 20

    def weight(self, depth: int) -> Column:
        """Of the nodes with so many names: that of their path, or with * for the first name, or the first two."""
        names = _KEYS[:depth]
        out = F.lit(float(self.default))
        for stars in reversed(range(3)):
            stars = min(stars, depth)
            for path, w in self.weights.items():
                if len(path) == depth and path[:stars] == ("*",) * stars:
                    same = F.lit(True)
                    for c, x in zip(names[stars:], path[stars:], strict=True):
                        same &= F.col(c) == x
                    out = F.when(same, float(w)).otherwise(out)
        return out


PRODUCTION = Mixture(
    domains={"web": tuple(f"src{i}" for i in range(10)), "reference": tuple(f"src{i}" for i in range(10, 15)), "forum": tuple(f"src{i}" for i in range(15, 20))},
    weights={("web",): 0.5, ("reference",): 0.3, ("forum",): 0.2, ("*", "en"): 0.5, ("*", "de"): 0.2, ("*", "fr"): 0.2, ("*", "es"): 0.1},
)


def _shares(nodes: DataFrame, parents: list[str], weight: Column) -> DataFrame:
    """nodes (with room, and _own of their parent) with given instead of _own: shares by weight, but no more than room, where what a node can't
    use goes to its siblings; those of weight 0 get what the others can't use. In the order of room by weight the full ones come first."""
    same = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))  # the domains of a mixture are few
    nodes = nodes.withColumn("_w", F.greatest(weight, F.lit(0.0))).withColumns({"_last": F.col("_w") == 0, "_w": F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0)})
    order = ["_last", F.col("room") / F.col("_w"), *(c for c in _KEYS if c in nodes.columns)]
    up = same.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*(parents or [F.lit(0)]), "_last").orderBy(*(x.desc() if isinstance(x, Column) else F.desc(x) for x in order[1:])).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({"_left": F.col("_own") - F.coalesce(F.sum("room").over(up), F.lit(0.0)), "_total": F.sum("_w").over(down), "_rank": F.row_number().over(same.orderBy(*order))})
    nodes = nodes.withColumn("_rate", F.greatest(F.col("_left"), F.lit(0.0)) / F.col("_total"))
    nodes = nodes.withColumn("_cut", F.min(F.when(F.col("_rate") * F.col("_w") < F.col("room"), F.struct("_rank", "_rate", "_last"))).over(same))
    open_ = F.when(F.col("_cut._last") == F.col("_last"), F.col("_cut._rate") * F.col("_w")).otherwise(0.0)
    given = F.when(F.col("_cut").isNull() | (F.col("_rank") < F.col("_cut._rank")), F.col("room")).otherwise(open_)
    return nodes.withColumn("given", given).drop("_w", "_last", "_left", "_total", "_rank", "_rate", "_cut", "_own")


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """leaves (_domain, _lang, _source, supply) with budget: the tokens each gets of ratio times all tokens."""
    leaves = leaves.withColumn("room", F.col("supply") * float(mixture.max_epochs))
    supply, room = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)), F.coalesce(F.sum("room"), F.lit(0.0))).first()
    own = leaves.groupBy("_domain").agg(F.sum("room").alias("room")).withColumn("_own", F.lit(min(mixture.ratio * supply, room)))
    for depth in (1, 2, 3):
        own = _shares(own, _KEYS[: depth - 1], mixture.weight(depth))
        if depth < 3:
            down = own.select(*_KEYS[:depth], F.col("given").alias("_own"))
            next_ = leaves if depth == 2 else leaves.groupBy(*_KEYS[:2]).agg(F.sum("room").alias("room"))
            own = next_.join(down, _KEYS[:depth])
    return own.withColumn("budget", F.floor(F.col("given") + 1e-6)).drop("given", "room")


def _leaf(mixture: Mixture) -> dict[str, Column]:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    domain = F.lit("other")
    for d, sources in mixture.domains.items():
        domain = F.when(name("source").isin(*sources), d).otherwise(domain)
    return {"_domain": domain, "_lang": name("lang"), "_source": name("source")}


def _order(mixture: Mixture) -> Column:
    """The place of a row in the epoch that its leaf begins last; rows alike in doc_id and text share it."""
    return F.xxhash64(F.lit(mixture.seed), F.col("_full"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), F.col("_raw"))


def _slice() -> Column:
    return F.shiftrightunsigned("_h", 52)


def plan(docs: DataFrame, mixture: Mixture) -> tuple[DataFrame, DataFrame]:
    """The rows without texts, with tokens (words) and their leaf's plan and place; and the leaves with their plan: _full epochs, then the slices
    before _edge, and of that slice what fits _rest."""
    rows = docs.select("doc_id", "text", "lang", "source").withColumns({**_leaf(mixture), "_raw": F.xxhash64(F.col("text").cast("string")), "tokens": F.size(words(F.col("text").cast("string"))).cast("long")})
    rows = checkpointed(rows.select("doc_id", "_raw", "_domain", "_lang", "_source", "tokens"))
    keys = _KEYS
    leaves = budgets(rows.groupBy(*keys).agg(F.sum("tokens").alias("supply")), mixture)
    epochs = F.when(F.col("supply") > 0, F.least(F.floor(F.col("budget") / F.col("supply")), F.lit(mixture.max_epochs))).otherwise(0)
    leaves = checkpointed(leaves.withColumn("_full", epochs.cast("int")))
    placed = rows.join(few(leaves, F.lit(8)), keys).withColumn("_h", _order(mixture))
    placed = placed.withColumns({"_slice": _slice(), "_rest": F.col("budget") - F.col("_full") * F.col("supply")})
    sums = placed.groupBy(*keys, "_slice", "_rest").agg(F.sum("tokens").alias("n"))
    upto = sums.withColumn("_upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("_slice")))
    edges = upto.where(F.col("_upto") > F.col("_rest")).groupBy(*keys).agg(F.min(F.struct("_slice", (F.col("_upto") - F.col("n")).alias("before"))).alias("e"))
    edges = edges.select(*keys, F.col("e._slice").alias("_edge"), F.col("e.before").alias("_before"))
    leaves = leaves.join(edges, keys, "left").withColumns({"_edge": F.coalesce("_edge", F.lit(_SLICES).cast("long")), "_before": F.coalesce("_before", F.lit(0).cast("long"))})
    leaves = checkpointed(leaves)
    placed = placed.join(few(leaves.select(*keys, "_edge", "_before"), F.lit(8)), keys)
    return placed, leaves


def decide(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """One row per row of docs: doc_id, domain, lang, source, tokens, copies (how often it is taken).

    A null lang or source is the name "". A null text has no tokens. Rows alike in doc_id and text are taken or left together. Columns of docs
    but doc_id, text, lang and source are not looked at. Rows with null doc_id are rows like others; an empty table gives none. Long texts
    are counted whole.
    """
    return _copies(plan(docs, mixture)[0], mixture)


def _copies(placed: DataFrame, mixture: Mixture) -> DataFrame:
    w = Window.partitionBy("_domain", "_lang", "_source").orderBy("_h")  # a slice only, with ties together
    edge = placed.where(F.col("_slice") == F.col("_edge")).withColumn("_in", F.col("_before") + F.sum("tokens").over(w) <= F.col("_rest"))
    other = placed.where(F.col("_slice") != F.col("_edge")).withColumn("_in", F.col("_slice") < F.col("_edge"))
    both = edge.unionByName(other)
    copies = F.least(F.col("_full") + F.col("_in").cast("int"), F.lit(mixture.max_epochs))
    return both.select("doc_id", "_raw", "_slice", "_edge", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "tokens", copies.alias("copies"))


def take(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """The rows of docs, each as often as it is taken, with all their columns. Only rows of the slices where budgets end are moved. Odd rows: as
    decide() says."""
    placed, leaves = plan(docs, mixture)
    decided = checkpointed(_copies(placed, mixture).where(F.col("_slice") == F.col("_edge")).select(F.col("doc_id").alias("_id"), F.col("_raw").alias("_r"), "copies").distinct())
    keys = _KEYS
    rows = boxed(docs).select("_row", "doc_id", "text", F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source"))
    rows = rows.select("_row", "doc_id", F.xxhash64("text").alias("_raw"), *(c.alias(k) for k, c in _leaf(mixture).items()))
    rows = rows.join(few(leaves.select(*keys, "_full", "_edge"), F.lit(8)), keys).withColumn("_h", _order(mixture)).withColumn("_slice", _slice())
    inner = rows.where(F.col("_slice") != F.col("_edge")).withColumn("copies", F.least(F.col("_full") + (F.col("_slice") < F.col("_edge")).cast("int"), F.lit(mixture.max_epochs)))
    edge = rows.where(F.col("_slice") == F.col("_edge")).join(decided, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_raw").eqNullSafe(F.col("_r")))
    chosen = inner.select("_row", "copies").unionByName(edge.select("_row", "copies")).where("copies > 0")
    if mixture.max_epochs > 1:
        chosen = chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unboxed(chosen)


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir)).select("doc_id", "domain", "lang", "source", "tokens", "copies")
