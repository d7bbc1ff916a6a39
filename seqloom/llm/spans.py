"""Spans of pattern matches as column expressions, in code points. Work grows in proportion to text and matches (but for a factor of 128)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, plus: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each element of an array of ints, plus() over it and all before it. An accumulator that grew by one element a step would be
    copied at each, so blocks of 128 are added up by themselves, and their totals to them."""

    def plain(xs: Column, low: Column, high: Column) -> Column:
        longer = lambda acc, i: let(F.get(xs, i), lambda x: F.concat(acc, F.array(F.coalesce(plus(F.get(acc, F.size(acc) - 1), x), x))))
        return F.aggregate(F.sequence(low, high), F.array().cast("array<int>"), longer)

    def scan(xs: Column) -> Column:
        last = F.size(xs) - 1
        blocks = F.transform(F.sequence(F.lit(0), F.floor(last / _BLOCK).cast("int")), lambda b: plain(xs, b * _BLOCK, F.least(last, b * _BLOCK + (_BLOCK - 1))))
        return let(blocks, lambda bs: F.when(F.size(bs) == 1, F.get(bs, 0)).otherwise(let(
            let(F.transform(bs, lambda b: F.get(b, F.size(b) - 1)), lambda ends: plain(ends, F.lit(0), F.size(ends) - 1)),
            lambda ends: F.flatten(F.transform(bs, lambda b, k: F.transform(b, lambda x: F.coalesce(plus(F.get(ends, k - 1), x), x)))),
        )))

    return let(values, lambda xs: F.when(F.size(xs) > 0, scan(xs)).otherwise(F.array().cast("array<int>")))


def find_all(text: Column, pattern: str, kind: str, passes: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches of a Java pattern that pass, as an array of (kind, start, end, value), in order. The lengths of the
    matches and of the parts between them give the places."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(ms: Column) -> Column:
        lengths = let(parts, lambda ps: F.transform(ms, lambda m, i: F.length(F.get(ps, i)) + F.length(m)))
        return let(running(lengths), lambda ends: F.transform(ms, lambda m, i: F.struct(
            F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value")
        )))

    spans = let(found, lambda ms: F.when(F.size(ms) > 0, place(ms)).otherwise(no_spans()))
    return spans if passes is None else F.filter(spans, lambda s: passes(s["value"]))


def joined(spans: Column) -> Column:
    """kind:start:end of all, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Sorted by start, then the order of kinds."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i)))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.coalesce(F.element_at(order, s["kind"]), F.lit(len(kinds))).alias("b"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def in_order(spans: Column) -> Column:
    """(start, end, kind, value) of all, sorted."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "kind", "value")))))


def reach(ordered: Column) -> Column:
    """For each of the spans in order, the furthest end up to it."""
    return running(F.transform(ordered, lambda s: s["end"]), F.greatest)


def is_head(s: Column, i: Column, far: Column) -> Column:
    """Whether span number i in order begins outside all before it."""
    return F.coalesce(s["start"] >= F.get(far, i - 1), F.lit(True))


def merged(spans: Column) -> Column:
    """(start, end, kind) of the stretches that spans cover, in order; a stretch has the kind of its first span."""

    def stretches(s: Column, far: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when(is_head(x, i, far), i)), lambda i: i.isNotNull())
        return let(heads, lambda hs: F.transform(hs, lambda h, k: F.struct(
            F.get(s, h)["start"].alias("start"), F.coalesce(F.get(far, F.get(hs, k + 1) - 1), F.get(far, F.size(far) - 1)).alias("end"), F.get(s, h)["kind"].alias("kind")
        )))

    return let(in_order(spans), lambda s: let(reach(s), lambda far: stretches(s, far)))


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """text with each stretch that spans cover replaced by label of its (start, end, kind)."""

    def pieces(cs: Column, ms: Column) -> Column:
        since = lambda i: F.coalesce(F.get(ms, i - 1)["end"], F.lit(0))
        part = lambda m, i: F.concat(F.array_join(F.slice(cs, since(i) + 1, m["start"] - since(i)), ""), label(m))
        return F.concat(F.transform(ms, part), F.array(F.array_join(F.slice(cs, since(F.size(ms)) + 1, F.size(cs)), "")))

    return let(F.split(text, ""), lambda cs: let(merged(spans), lambda ms: F.array_join(pieces(cs, ms), "")))
