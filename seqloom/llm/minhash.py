"""Near-duplicate classes by BagMinHash.

A text is the multiset of its runs of five words. Its signature holds, for each of `bands * rows` registers, the first point of Poisson
processes over weight: an element of weight w has one process on each of the dyadic ranges (0, 1], (1, 2], (2, 4] ... that begin below
w, whose points above w are thinned out, so that two texts agree in a register with the probability of their weighted Jaccard
similarity. A process ends as soon as it passes the text's largest register.

Signatures are cut into bands. In a bucket of texts that share a band, all are compared with one, the pivot; those outside its class are then
compared with the bucket's members outside theirs: few outsiders pair by pair, but for pairs that the triangle inequality of the Jaccard
distance rules out; more of them in blocks, which read each text once and take all overlaps at once as products of matrices. A bucket with
very many (pages that share half their text, say) is split: its texts' shingles are ordered, those that the
pivot has last, and texts that could be near share one of the first shingles of theirs (prefix filtering, which is exact). The texts that
share one are a bucket of the next round, with a pivot of its own; but if that would leave much of the work (edits of one text that the
pivot is far from), the bucket is compared in blocks. So no link between texts that share a bucket is lost, and a bucket of near copies costs
one comparison for each. Blocks are quadratic in the outsiders, at well below a microsecond a pair. Comparisons are exact multiset overlaps. Equal texts are one node.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import boxed, documents, mix64, pieces, rolling, text_buffers, unboxed, word_hashes
from seqloom.llm.components import connected_components
from seqloom.session import checkpointed

_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words, and the text of each. A text with fewer words has one, of all of them; one without words none."""
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    left = at[1:][doc] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    run = rolling(words, size)
    whole = np.flatnonzero(left[: len(run)] >= size)
    hashes, owner = [mix64(run[whole])], [doc[whole]]
    for n in range(1, size):
        short = at[:-1][count == n]
        if len(short):
            hashes.append(mix64(rolling(words, n)[short] + np.uint64(n)))
            owner.append(doc[short])
    return np.concatenate(hashes), np.concatenate(owner)


def _weights(hashes, owner):
    """Distinct (text, hash) with their counts, in the order of hash then text."""
    order = np.lexsort((owner, hashes))
    h, d = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


def bag_min_hash(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """docs x m registers; infinite for a text without elements."""
    registers = np.full(docs * m, np.inf)
    seed, doc, w, low, width = [mix64(hashes)], [owner], [weight], [np.zeros(len(owner))], [np.ones(len(owner))]
    begin = 1
    while (over := weight > begin).any():
        seed.append(mix64(hashes[over] + np.uint64(begin * int(_GAMMA) % 2**64)))
        doc.append(owner[over])
        w.append(weight[over])
        low.append(np.full(int(over.sum()), float(begin)))
        width.append(np.full(int(over.sum()), float(begin)))
        begin *= 2
    seed, doc, w, low, width = (np.concatenate(x) for x in (seed, doc, w, low, width))
    t, step = np.zeros(len(seed)), 0
    while len(seed):
        # several points of each at once when few processes are left
        many = int(np.clip(200_000 // len(seed), 1, 64)) if step else 1
        k = (np.arange(many, dtype=np.uint64) + np.uint64(step)) * np.uint64(2)
        step += many
        gap = mix64(seed[:, None] + k * _GAMMA)
        kind = mix64(seed[:, None] + (k + np.uint64(1)) * _GAMMA)
        u = ((gap >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = t[:, None] + np.cumsum(-np.log(u) / width[:, None], 1)
        register = ((kind & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        level = low[:, None] + (kind >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[:, None]
        counts = level < w[:, None]
        place = doc[:, None] * m + register.astype(np.int64)
        np.minimum.at(registers, place[counts], time[counts])
        t = time[:, -1]
        go = t < registers.reshape(docs, m).max(1)[doc]
        seed, doc, w, low, width, t = seed[go], doc[go], w[go], low[go], width[go], t[go]
    return registers.reshape(docs, m)


def signatures(docs: DataFrame, size: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """doc_id, raw (hash of the text), digest (of the word sequence; null without words), n (shingles), bands."""

    def run(batches):
        for batch in batches:
            words, at = word_hashes(*text_buffers(batch.column(2)))
            for a, b in pieces(at, 300_000):
                w, o = words[at[a] : at[b]], at[a : b + 1] - at[a]
                h, doc = shingles(w, o, size)
                sig = bag_min_hash(*_weights(h, doc), b - a, bands * rows).view(np.uint64).reshape(b - a, bands, rows)
                band = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (b - a, bands))
                for r in range(rows):
                    band = mix64(band * _GAMMA + sig[:, :, r])
                place = (np.arange(len(w)) - np.repeat(o[:-1], np.diff(o))).astype(np.uint64)
                ends = np.concatenate([[0], np.cumsum(mix64(w + place * _GAMMA))]).astype(np.uint64)
                ends2 = np.concatenate([[0], np.cumsum(mix64(w ^ mix64(place + _GAMMA)))]).astype(np.uint64)
                d = np.stack([ends[o[1:]] - ends[o[:-1]], ends2[o[1:]] - ends2[o[:-1]]], 1)
                some = np.diff(o) > 0
                digest = [x.tobytes() if s else None for x, s in zip(d, some, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digest, pa.binary()), pa.array(np.bincount(doc, minlength=b - a)), lists], names=["doc_id", "raw", "digest", "n", "bands"])

    return _keyed(docs).mapInArrow(run, "doc_id long, raw long, digest binary, n long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("text"))


def _meetings(pairs: DataFrame, texts: DataFrame, size: int, each, value: tuple[str, pa.DataType], block: int = 256) -> DataFrame:
    """pairs (a, b) with each(shingles and counts of b, of a). texts: node, text. The text of each a goes once to every block of its pairs."""
    count = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("salts"))
    total = pairs.count()
    group = F.pmod(F.xxhash64("a", "salt"), F.lit(max(1, -(-total // block)))).alias("g")
    left = count.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(texts, F.col("a") == F.col("node"))
    right = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")).join(texts, F.col("b") == F.col("node"))
    rows = left.select(group, "a", "salt", F.lit(None).cast("long").alias("b"), "text").unionByName(right.select(group, "a", "salt", "b", "text"))

    def compare(t):
        h, doc = shingles(*word_hashes(*text_buffers(t.column("text"))), size)
        h, doc, n = _weights(h, doc)
        order = np.argsort(doc, kind="stable")
        h, n = h[order], n[order]
        at = np.searchsorted(doc[order], np.arange(t.num_rows + 1))
        a, salt, b = (t.column(c).to_pylist() for c in ("a", "salt", "b"))
        first = {(x, s): i for i, (x, s, y) in enumerate(zip(a, salt, b, strict=True)) if y is None}
        found = []
        for i, y in enumerate(b):
            if y is not None:
                k = first[a[i], salt[i]]
                p, q = slice(at[i], at[i + 1]), slice(at[k], at[k + 1])
                found.append((a[i], y, each(h[p], n[p], h[q], n[q])))
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), value[1]), strict=True)], names=["a", "b", value[0].split()[0]])

    return rows.groupBy("g").applyInArrow(compare, f"a long, b long, {value[0]}")


def similarity(h: np.ndarray, n: np.ndarray, h2: np.ndarray, n2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of sorted distinct hashes with counts."""
    _, u, v = np.intersect1d(h, h2, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[u], n2[v]).sum())
    every = int(n.sum() + n2.sum()) - common
    return common / every if every else 0.0


def prefix(h: np.ndarray, n: np.ndarray, h2: np.ndarray, n2: np.ndarray, threshold: float) -> list[int]:
    """The first elements of a multiset, those of the second multiset last: enough that two of similarity threshold share one."""
    at = np.searchsorted(h2, h)
    there = np.where(at < len(h2), h2[np.minimum(at, len(h2) - 1)] == h, False) if len(h2) else np.zeros(len(h), bool)
    known = np.where(there, n2[np.minimum(at, len(h2) - 1)], 0) if len(h2) else np.zeros(len(h), np.int64)
    copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    element = mix64(np.repeat(h, n) + copy.astype(np.uint64) * _GAMMA)
    most = len(element) - int(np.ceil(threshold * len(element) - 1e-9)) + 1
    order = np.lexsort((element, copy < np.repeat(known, n)))[:most]
    return element[order].view(np.int64).tolist()


def similarities(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs (a, b) with j, their weighted Jaccard similarity."""
    return _meetings(pairs, texts, size, similarity, ("j double", pa.float64()))


def overlaps(element: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, rare: int = 8, columns: int = 1024) -> np.ndarray:
    """left x right: how many elements two texts share. element, owner: the distinct (element, text); left, right: numbers of texts."""
    docs = int(max(owner.max(initial=-1), left.max(initial=-1), right.max(initial=-1))) + 1
    row, col = np.full(docs, -1), np.full(docs, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    at = np.flatnonzero(np.append(True, element[1:] != element[:-1])) if len(element) else np.zeros(0, np.int64)
    held = np.diff(np.append(at, len(element)))
    common = np.zeros((len(left), len(right)), np.int64)
    few = np.repeat((held > 1) & (held <= rare), held)
    e, d = element[few], owner[few]
    for shift in range(1, rare):  # elements of few texts: pair by pair
        k = np.flatnonzero(e[shift:] == e[:-shift])
        for x, y in ((d[k], d[k + shift]), (d[k + shift], d[k])):
            met = (row[x] >= 0) & (col[y] >= 0)
            place, n = np.unique(row[x[met]] * len(right) + col[y[met]], return_counts=True)
            common.reshape(-1)[place] += n
    own = np.flatnonzero((row >= 0) & (col >= 0))
    many = np.repeat(held > rare, held)
    d, rank = owner[many], np.repeat(np.arange(int((held > rare).sum())), held[held > rare])
    end = int(rank[-1]) + 1 if len(rank) else 0
    for a in range(0, end, columns):
        i, j = np.searchsorted(rank, [a, a + columns])
        there = np.zeros((docs, min(columns, end - a)), np.float32)
        there[d[i:j], rank[i:j] - a] = 1
        common += (there[left] @ there[right].T).astype(np.int64)
    common[row[own], col[own]] = 0  # a text and itself
    return common


def _blocks(buckets: DataFrame, texts: DataFrame, threshold: float, size: int, most: int = 750_000) -> DataFrame:
    """(a, b, j) of similarity threshold between the outsiders of a bucket and its members of other components. buckets: bucket, node, n, component,
    out. Both are cut into blocks of about most shingles, where a text counts as 400 more; a text goes once to each pair of blocks that it is part of."""
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(0)) / most)).cast("long")
    total = buckets.groupBy("bucket").agg(cut(F.sum(F.when(F.col("out"), F.col("n") + 400))).alias("p"), cut(F.sum(F.col("n") + 400)).alias("q"))
    rows = buckets.join(total, "bucket").withColumns({"x": F.pmod(F.xxhash64("node", "bucket"), "p"), "y": F.pmod(F.xxhash64("bucket", "node"), "q")})
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_left = F.when(F.col("out"), F.transform(upto("q"), lambda q: F.struct(F.col("x").alias("p"), q.alias("q")))).otherwise(F.array().cast("array<struct<p:bigint,q:bigint>>"))
    as_right = F.transform(upto("p"), lambda p: F.struct(p.alias("p"), F.col("y").alias("q")))
    rows = rows.withColumn("cell", F.explode(F.array_distinct(F.concat(as_left, as_right))))
    rows = rows.select("bucket", "cell", "node", "component", (F.col("out") & (F.col("x") == F.col("cell.p"))).alias("left"), (F.col("y") == F.col("cell.q")).alias("right")).join(texts, "node")
    rows = rows.select(F.xxhash64("bucket", "cell").alias("g"), "node", "component", "left", "right", "text")

    def compare(t):
        h, doc = shingles(*word_hashes(*text_buffers(t.column("text"))), size)
        count = np.bincount(doc, minlength=t.num_rows)
        h, doc, n = _weights(h, doc)
        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        element, owner = mix64(np.repeat(h, n) + copy.astype(np.uint64) * _GAMMA), np.repeat(doc, n)
        node, component = (t.column(c).to_numpy() for c in ("node", "component"))
        left, right = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        common = overlaps(element, owner, left, right)
        every = count[left][:, None] + count[right][None] - common
        j = common / np.maximum(every, 1)
        i, k = np.nonzero((j >= threshold) & (component[left][:, None] != component[right][None]))
        a, b = node[left[i]], node[right[k]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "j": j[i, k]})

    return rows.groupBy("g").applyInArrow(compare, "a long, b long, j double").distinct()


def _split(large: DataFrame, texts: DataFrame, threshold: float, size: int, gain: int = 4) -> tuple[DataFrame, DataFrame]:
    """The buckets (bucket, node, n) of texts that share one of their first shingles, but for those of one component; and the rows of large whose
    buckets it's no use to split, as that would leave more than one in gain of the pairs. large: bucket, node, n, pivot, component, out, outs."""
    pairs = large.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    split = _meetings(pairs, texts, size, lambda *sets: prefix(*sets, threshold), ("elements array<long>", pa.list_(pa.int64())))
    sub = split.select("a", F.col("b").alias("node"), F.explode("elements").alias("e")).select("a", F.xxhash64("a", "e").alias("bucket"), "node").distinct()
    sub = checkpointed(sub.join(large.select("node", "n", "component").distinct(), "node"))
    several = sub.groupBy("a", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).cast("double").alias("size")).where("low <> high")
    several = checkpointed(several.select("a", "bucket", "size"))
    after = several.groupBy("a").agg(F.sum(F.col("size") * F.col("size")).alias("after"))
    before = large.groupBy(F.col("pivot").alias("a")).agg(F.sum(F.col("outs").cast("double")).alias("before"))  # outsiders times members
    useless = checkpointed(before.join(after, "a").where(F.col("after") * gain > F.col("before")).select(F.col("a").alias("pivot")))
    several = several.join(useless, F.col("a") == F.col("pivot"), "left_anti").select("bucket")
    return checkpointed(sub.drop("component", "a").join(several, "bucket")), large.join(useless, "pivot", "left_semi").select(*large.columns)


def _links(cand: DataFrame, texts: DataFrame, threshold: float, size: int, outsiders: int, rounds: int, paired: int = 8) -> DataFrame:
    """(node, component) of the classes that links between members of a bucket make. cand: bucket, node, n, checkpointed. paired: outsiders of
    a bucket that are compared pair by pair rather than in blocks, at most."""
    near = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9  # noqa: E731  # no overlap can do more
    tested, part = None, None

    def test(pairs: DataFrame) -> DataFrame:
        """Compares new pairs; with their similarities."""
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        return checkpointed(similarities(checkpointed(pairs), texts, size))

    def link(new: DataFrame) -> None:
        nonlocal tested, part
        linked = new.where(F.col("j") >= threshold).limit(1).count() > 0
        tested = new if tested is None else tested.unionByName(new)
        if linked or part is None:
            part = connected_components(tested.where(F.col("j") >= threshold))

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    for number in range(rounds + 1):
        order = F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node", "n")
        pivots = cand.groupBy("bucket").agg(F.min(order).alias("p")).select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
        cand = checkpointed(cand.join(pivots, "bucket"))
        link(test(cand.where((F.col("node") != F.col("pivot")) & near(F.col("n"), F.col("pivot_n"))).select(*pair(F.col("node"), F.col("pivot")))))

        own = cand.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        home = own.where("node = pivot").select("bucket", F.col("component").alias("home"))
        seen = tested.select("a", "b", "j").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"), "j"))
        mixed = own.join(home, "bucket").withColumn("out", F.col("component") != F.col("home"))
        open_ = mixed.groupBy("bucket").agg(F.count_if("out").alias("outs")).where("outs > 0")
        open_ = checkpointed(mixed.join(open_, "bucket").select("bucket", "node", "n", "pivot", "component", "out", "outs"))
        large = open_.where(F.col("outs") > outsiders) if number < rounds else open_.limit(0)
        wide = open_.where((F.col("outs") > paired) & (F.col("outs") <= outsiders)) if number < rounds else open_.where(F.col("outs") > paired)
        cand = None
        if large.limit(1).count():
            cand, whole = _split(large, texts, threshold, size)
            wide = wide.unionByName(whole)
        direct = open_.where(F.col("outs") <= min(paired, outsiders) if number < rounds else F.col("outs") <= paired)
        direct = direct.join(seen.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "j"), ["pivot", "node"], "left")
        x, y = direct.where("out").alias("x"), direct.where("node <> pivot").alias("y")
        far = F.abs(F.col("x.j") - F.col("y.j")) > 1 - threshold + 1e-9
        more = x.join(y, F.col("x.bucket") == F.col("y.bucket")).where(
            (F.col("x.component") != F.col("y.component")) & (~F.col("y.out") | (F.col("x.node") < F.col("y.node"))) & near(F.col("x.n"), F.col("y.n")) & ~F.coalesce(far, F.lit(False))
        )
        more = checkpointed(more.select(*pair(F.col("x.node"), F.col("y.node"))).distinct())
        found = [test(more)] if more.limit(1).count() else []
        if wide.limit(1).count():
            found.append(checkpointed(_blocks(wide.select("bucket", "node", "n", "component", "out"), texts, threshold, size)))
        if found:
            link(reduce(DataFrame.unionByName, found))
        if cand is None or not cand.limit(1).count():
            break
    return part


def _classes(docs: DataFrame, threshold: float, size: int, bands: int, rows: int, outsiders: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and words: doc_id, raw, class_id, class_raw (of the row that stays); and other rows: doc_id, raw."""
    sigs = checkpointed(signatures(docs, size, bands, rows))
    is_named = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    named = sigs.where(is_named)
    nodes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "raw", "n", "bands")).alias("x"))
    nodes = checkpointed(nodes.select("digest", "x.*", F.monotonically_increasing_id().alias("node")))
    held = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    cand = checkpointed(held.join(buckets, "bucket"))
    members = cand.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")), "node")
    texts = _keyed(docs).join(members.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("raw") == F.col("_raw"))).select("node", "text")
    repeated = named.groupBy("doc_id", "raw").count().where("count > 1").limit(1).count()
    texts = checkpointed(texts.dropDuplicates(["node"]) if repeated else texts)
    part = _links(cand, texts, threshold, size, outsiders, rounds)
    place = nodes.join(part, "node", "left").select("digest", "doc_id", "raw", F.coalesce("component", "node").alias("component"))
    best = place.groupBy("component").agg(F.min(F.struct("doc_id", "raw")).alias("best"))
    place = place.join(best, "component").select("digest", F.col("best.doc_id").alias("class_id"), F.col("best.raw").alias("class_raw"))
    return named.join(place, "digest").select("doc_id", "raw", "class_id", "class_raw"), sigs.where(~is_named).select("doc_id", "raw")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 24, rows: int = 4, outsiders: int = 1000, rounds: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of its class).

    Classes are connected by similarities of at least threshold. A text of fewer than size words is one shingle of all its words; a
    text without words, or null, is alone, and so is a row with null doc_id, whose class is null. Rows with the same doc_id but other words
    are texts like others; repeated rows are one. An empty table has no classes. Only doc_id and text are read, so that other columns may have any
    name. Long texts are read whole; a task holds the shingles of a few hundred texts at once. outsiders: of a bucket's pivot, that are
    compared with its other members rather than split up; rounds: of splitting, after which what is left is compared.
    """
    named, lone = _classes(docs, threshold, size, bands, rows, outsiders, rounds)
    return named.select("doc_id", "class_id").unionByName(lone.select("doc_id", F.col("doc_id").alias("class_id")))


def drop_near(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 24, rows: int = 4, outsiders: int = 1000, rounds: int = 6) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class one, with the smallest doc_id (and of its texts the one of the smallest
    hash); rows without words or doc_id all stay. Odd rows: as near_duplicates() says."""
    named = checkpointed(_classes(docs, threshold, size, bands, rows, outsiders, rounds)[0])
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("raw") == F.col("class_raw"))
    dropped = named.where(~stays).select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_raw"))
    rest = boxed(docs).join(dropped.hint("shuffle_hash"), same, "left_anti")
    twins = checkpointed(named.where(stays).groupBy("doc_id", "raw").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")))
    if twins.limit(1).count():
        rest = rest.join(twins, same, "left_anti").unionByName(rest.join(twins, same, "left_semi").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h"))
    return unboxed(rest)


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
