"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Every rule reads a statistic of a text and votes good (1), bad (-1) or not at all (0). The votes of all documents, counted by pattern,
are at most 3 to the number of rules rows; expectation-maximisation on those estimates how often each rule is right and how many documents
are good. A document is kept if its posterior probability of being good is large enough. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SPACE, WORD, boxed, documents, unboxed, words
from seqloom.session import checkpointed, stored

_RUN = 5


def _run_hashes(h: str) -> Column:
    """64-bit hashes of all runs of five of the hashes in column h."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (_RUN - 1)))
    return F.when(F.size(h) >= _RUN, F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(h), i + (k - 1)) for k in range(_RUN))))).otherwise(F.array().cast("array<bigint>"))


def _covered(runs: str) -> Column:
    """How many words lie in a run that occurs twice or more among the runs in that column. Only texts with a repeated run sort theirs."""
    pairs = F.array_sort(F.transform(F.col(runs), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        return F.array_sort(F.filter(F.transform(p, lambda v, k: F.when((F.get(p, k - 1)["x"] == v["x"]) | (F.get(p, k + 1)["x"] == v["x"]), v["i"])), lambda i: i.isNotNull()))

    def words_of(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-_RUN).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(_RUN), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  # evaluates value once
    dup = F.size(F.array_distinct(runs)) < F.size(runs)
    # the always true condition keeps filters on this column above it; pushed below, they would inline it and the arrays it reads
    return F.when(F.monotonically_increasing_id() >= 0, F.coalesce(F.when(dup, let(let(pairs, repeated), words_of)), F.lit(0)).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns of _STATS, counted over whole texts; a null text has no words."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = docs.withColumn("_text", F.col("text").cast("string"))
    df = df.withColumns({"_words": words(F.col("_text")), "_lines": lines})
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_runs", _run_hashes("_hashes"))
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _covered("_runs"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_upper": F.length(F.regexp_replace(text, r"[^A-ZÀ-ÖØ-Þ]+", "")).cast("long"),
            "_n_other": F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")).cast("long"),
            "_n_marks": (F.length(text) - F.length(F.regexp_replace(text, "[!?=_~^{}\\\\]+", ""))).cast("long"),
            "_n_distinct": F.size(F.array_distinct("_hashes")).cast("long"),
            "_n_ended": F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;\"')\]…。]" + SPACE + "*$"))).cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_hashes", "_runs")


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_n_lines", "_n_upper", "_n_other", "_n_marks", "_n_distinct", "_n_ended"]


@dataclass(frozen=True)
class Rule:
    """value is compared with two bounds: votes good on one side of `good`, bad on one side of `bad`, abstains between and where value is null."""

    name: str
    value: Callable[[], Column]
    good: float
    bad: float

    def vote(self) -> Column:
        v = self.value()
        low = self.good < self.bad
        is_good = v <= self.good if low else v >= self.good
        is_bad = v >= self.bad if low else v <= self.bad
        return F.when(v.isNull(), 0).when(is_bad, -1).when(is_good, 1).otherwise(0)


def _ratio(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(b) > 0, F.col(a) / F.col(b))


RULES = [
    Rule("symbols", _ratio("n_symbols", "n_words"), 0.05, 0.25),
    Rule("marks", _ratio("_n_marks", "n_words"), 0.1, 0.4),
    Rule("upper", _ratio("_n_upper", "word_chars"), 0.12, 0.35),
    Rule("dup_lines", _ratio("n_dup_lines", "_n_lines"), 0.1, 0.5),
    Rule("repeats", _ratio("n_repeat_words", "n_words"), 0.05, 0.18),
    # by Heaps' law this ratio of logarithms hardly depends on length
    Rule("distinct", lambda: F.when(F.col("n_words") >= 2, F.log("_n_distinct") / F.log("n_words")), 0.7, 0.55),
    Rule("word_length", lambda: F.when(F.col("n_words") > 0, F.abs(F.col("word_chars") / F.col("n_words") - 6.0)), 2.5, 5.0),
    Rule("other_chars", _ratio("_n_other", "word_chars"), 0.1, 0.2),
    Rule("line_ends", lambda: F.when(F.col("_n_lines") >= 2, F.col("_n_ended") / F.col("_n_lines")), 0.7, 0.3),
]


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents. on_good, on_bad: how often each rule's votes are right on good and on bad documents; a bad document
    often breaks one rule only, so that the two differ much. rounds: of expectation-maximisation run."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]
    rounds: int

    def weights(self) -> list[tuple[float, float]]:
        """What a good and a bad vote of each rule add to the log odds."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad, strict=True)]

    def log_odds(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def posterior(self, votes: list[Column]) -> Column:
        logit = F.lit(self.log_odds())
        for vote, (up, down) in zip(votes, self.weights(), strict=True):
            logit = logit + F.when(vote > 0, up).when(vote < 0, down).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def _accuracies(right: list[list[float]], voted: list[list[float]], j: int, old: tuple[float, float]) -> tuple[float, float]:
    """How often rule j's votes are right on good and on bad documents. Bad documents break a rule at least as often as good ones: where the
    counts say otherwise, both get the common rate, and the rule tells nothing."""
    if not voted[0][j] or not voted[1][j]:
        return tuple(right[k][j] / voted[k][j] if voted[k][j] else old[k] for k in (0, 1))
    good, bad = right[0][j] / voted[0][j], right[1][j] / voted[1][j]
    if good + bad < 1:
        bad = (voted[0][j] - right[0][j] + right[1][j]) / (voted[0][j] + voted[1][j])
        good = 1 - bad
    return good, bad


def fit_patterns(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 1000) -> LabelModel:
    """Expectation-maximisation on vote patterns with their counts. Accuracies follow the corpus: a rule that good documents break by habit is
    told by its bad votes that come alone, a defect by two or more rules that see it. Votes on good documents are right with 0.5 to 0.9995,
    those on bad ones with 0.02 to 0.98 and break no rule less often than good ones, the prior lies within 0.05 and 0.999. So good and bad
    can't change places. A rule that never votes keeps its start."""
    prior, good, bad = 0.8, [0.995] * rules, [0.15] * rules
    model = LabelModel(prior, tuple(good), tuple(bad), 0)
    for done in range(1, rounds + 1):
        weights, odds = model.weights(), model.log_odds()
        mass, total = 0.0, 0
        right, voted = [[0.0] * rules, [0.0] * rules], [[0.0] * rules, [0.0] * rules]
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-odds - sum(w[0] if v > 0 else w[1] for v, w in zip(votes, weights, strict=True) if v)))
            mass += n * p
            total += n
            for j, v in enumerate(votes):
                if v:
                    voted[0][j] += n * p
                    voted[1][j] += n * (1 - p)
                    right[v < 0][j] += n * (p if v > 0 else 1 - p)
        if not total:
            break
        found = [_accuracies(right, voted, j, x) for j, x in enumerate(zip(model.on_good, model.on_bad, strict=True))]
        within = lambda x, low, high: min(high, max(low, x))
        new = LabelModel(within(mass / total, 0.05, 0.999), tuple(within(g, 0.5, 0.9995) for g, _ in found), tuple(within(b, 0.02, 0.98) for _, b in found), done)
        moved = max(abs(x - y) for x, y in zip((new.prior, *new.on_good, *new.on_bad), (model.prior, *model.on_good, *model.on_bad), strict=True))
        model = new
        if moved < 1e-9:
            break
    return model


def fit(stats: DataFrame, rules: list[Rule] = RULES) -> LabelModel:
    """The model of the rules' votes on all rows of stats that pass the base. At most 3 ** len(rules) counts come to the driver."""
    votes = [r.vote().alias(f"v{j}") for j, r in enumerate(rules)]
    rows = stats.groupBy(*votes).agg(F.count_if(~_base_failed()).alias("n")).collect()
    return fit_patterns(sorted((tuple(x[:-1]), x[-1]) for x in rows if x[-1]), len(rules))


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule] = RULES, threshold: float = 0.5, model: LabelModel | None = None) -> DataFrame:
    """docs with the statistics of the base, base_failed, posterior (of being good) and kept: false if base_failed, else posterior >= threshold.

    The statistics are computed once and written to the shared folder beside the columns of docs; the fit reads only them. Columns of docs that
    have a name of a result are replaced; others stay. Nulls: a null text has no words and fails the base; a null doc_id is an id like
    others. Repeated rows are judged alike, and each counts in the fit; an empty table fits nothing and returns nothing. Whole texts
    of any length are read; a task holds the words of one text at a time.
    """
    stats = stored(statistics(docs))
    return verdict(stats, model or fit(stats, rules), rules, threshold)


def verdict(stats: DataFrame, model: LabelModel, rules: list[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """judge() from statistics that are there already."""
    found = stats.withColumns({"base_failed": _base_failed(), "posterior": model.posterior([r.vote() for r in rules])})
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, threshold: float = 0.5, model: LabelModel | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns. Odd rows: as judge() says."""
    stats = stored(statistics(boxed(docs)).drop("doc_id", "text"))
    return unboxed(verdict(stats, model or fit(stats, rules), rules, threshold).where("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    stats = checkpointed(statistics(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    found = verdict(stats, fit(stats))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
