"""Language identification of multilingual texts by mixture inference.

Byte trigrams of letters are hashed to `1 << bits` slots. Each language is a smoothed distribution over the slots, counted over all
learning rows. A document is a mixture of languages: expectation-maximisation estimates its proportions from the slot likelihoods, over
nested sets of languages in the order of their proportions, and the set is chosen by penalised likelihood (BIC, with the number of
trigrams divided by their overlap). The prediction is the language of the largest proportion. The score is that proportion times the
probability of the best single language among all, so that little evidence doesn't pass for certainty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import documents, pieces, text_buffers

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _counts(column, bits: int):
    """For ranges of documents: their first and last + 1, and the nonzero counts as (document in the range, slot, count)."""
    column = pc.utf8_lower(column.cast(pa.large_string()))
    edge = pa.scalar(" ", pa.large_string())  # the beginning and the end of a text are those of words
    data, off = text_buffers(pc.binary_join_element_wise(edge, column, edge, pa.scalar("", pa.large_string())))
    data = _FOLD[data]
    slots = 1 << bits
    for a, b in pieces(off):
        if b - a > 64:  # also bounds documents times slots
            yield from (((x, y, *_count(data, off[x : y + 1], slots, bits))) for x, y in ((x, min(x + 64, b)) for x in range(a, b, 64)))
        else:
            yield a, b, *_count(data, off[a : b + 1], slots, bits)


def _count(data, off, slots: int, bits: int):
    n = len(off) - 1
    total = np.zeros(n * slots, np.int32)
    step = 4_000_000
    for begin in range(int(off[0]), int(off[-1]), step):  # a long text goes through in slices that overlap by two bytes
        end = min(begin + step, int(off[-1]) - 2)
        if end <= begin:
            break
        at = np.arange(begin, end)
        doc = np.repeat(np.arange(n), np.diff(np.clip(off, begin, end)))
        d = data[begin : end + 2].astype(np.uint32)
        inside = (at + 3 <= off[1:][doc]) & ((d[:-2] != 32) | (d[1:-1] != 32)) & ((d[1:-1] != 32) | (d[2:] != 32))
        h = (d[:-2] * np.uint32(65599) + d[1:-1]) * np.uint32(65599) + d[2:]
        slot = (h * np.uint32(2654435769)) >> np.uint32(32 - bits)
        key = doc[inside] * slots + slot[inside]
        total += np.bincount(key, minlength=n * slots).astype(np.int32)
    cell = np.flatnonzero(total)
    return cell // slots, cell % slots, total[cell]


def learn(rows: DataFrame, bits: int = 13) -> dict[str, np.ndarray]:
    """log probabilities of the slots for each lang, counted over all of rows (text, lang). Its size is that of languages times slots."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for a, b, doc, slot, n in _counts(batch.column(0), bits):
                own = lang[a:b][doc]
                for name in set(lang[a:b]):
                    pick = own == name
                    if name not in held:
                        held[name] = np.zeros(1 << bits, np.int64)
                    np.add.at(held[name], slot[pick], n[pick])
        for name, x in held.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], names=["lang", "slot", "n"])

    kept = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    table = kept.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    model, slots = {}, 1 << bits
    langs = np.array(table.column("lang").to_pylist(), object)
    slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
    for name in sorted(set(langs)):
        x = np.full(slots, 0.5)
        x[slot[langs == name]] += n[langs == name]
        model[name] = np.log(x / x.sum()).astype(np.float32)
    return model


def _proportions(doc, weight, like, docs: int, start, rounds: int):
    """EM over cells (document, count, likelihood by language): proportions and log likelihood by document."""
    pi = start
    total = np.maximum(np.bincount(doc, weights=weight, minlength=docs), 1e-9)[:, None]
    for _ in range(rounds):
        joint = like * pi[doc]
        joint *= (weight / joint.sum(1))[:, None]
        pi = np.stack([np.bincount(doc, weights=joint[:, j], minlength=docs) for j in range(like.shape[1])], 1) / total
        pi = np.maximum(pi, 1e-6)
        pi /= pi.sum(1, keepdims=True)
    loss = np.bincount(doc, weights=weight * np.log((like * pi[doc]).sum(1)), minlength=docs)
    return pi, loss


def infer(doc, slot, n, docs: int, logs: np.ndarray, penalty: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document and language, where languages outside the chosen set have 0, as has a document without trigrams; and the
    probability of the best single language. logs: by slot and language."""
    cell = logs[slot]
    top = cell.max(1, keepdims=True)
    like = np.exp((cell - top).astype(np.float64))
    weight, langs = n.astype(np.float64), logs.shape[1]
    size = np.bincount(doc, weights=weight, minlength=docs)
    single = np.stack([np.bincount(doc, weights=weight * (cell - top)[:, j], minlength=docs) for j in range(langs)], 1) / 3
    certainty = 1 / np.exp(single - single.max(1, keepdims=True)).sum(1)
    pi, _ = _proportions(doc, weight, like, docs, np.full((docs, langs), 1 / langs), rounds)
    order = np.argsort(-pi, 1, kind="stable")
    best = np.full(docs, -np.inf)
    chosen = np.zeros((docs, langs))
    active = np.ones(docs, bool)
    for k in range(1, langs + 1):
        own = active[doc]
        if not own.any():
            break
        ids = np.flatnonzero(active)
        place = np.cumsum(active) - 1
        d, w = place[doc[own]], weight[own]
        pick = order[ids, :k]
        part = np.take_along_axis(like[own], pick[d], 1) + 1e-300
        start = np.take_along_axis(pi[ids], pick, 1)
        p, loss = _proportions(d, w, part, len(ids), start / start.sum(1, keepdims=True), 0 if k == 1 else rounds)
        # trigrams overlap: a third of them count as independent
        value = loss / 3 - penalty * k * np.log(np.maximum(size[ids] / 3, 2.0))
        better = value > best[ids]
        won = ids[better]
        best[won] = value[better]
        chosen[won] = 0
        np.put_along_axis(chosen, order, np.where(np.isin(np.arange(docs), won)[:, None], 0, np.take_along_axis(chosen, order, 1)), 1)
        chosen[won[:, None], pick[better]] = p[better]
        active[:] = False
        active[won] = True
    chosen[size == 0] = 0
    return chosen, certainty


def identify(docs: DataFrame, model: dict[str, np.ndarray], penalty: float = 2.0, keep: list | None = None) -> DataFrame:
    """doc_id, the columns named in keep, lang_pred, score, languages (name:share of the chosen set, largest first). Whole texts are read, of any
    length, in slices. A null text, one without a letter, or any text if no language was learned, is `und` with score 0. Languages that tie
    come in the order of their names. Repeated rows are answered alike, rows with null doc_id like others; an empty table gives none. Columns
    that aren't in keep aren't looked at; one in keep must not have the name of a result."""
    if set(keep or []) & {"lang_pred", "score", "languages", "doc_id", "text", "_letters"}:
        raise ValueError("keep has the name of a result")
    langs = list(model)
    logs = np.stack([model[x] for x in langs], 1) if langs else np.zeros((2, 0), np.float32)
    bits = int(np.log2(len(logs)))
    names = list(keep or [])
    slim = docs.select("doc_id", *names, F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    types = dict(slim.dtypes)
    held = slim.sparkSession.sparkContext.broadcast(logs)  # languages times slots

    def run(batches):
        table = held.value
        for batch in batches:
            size = batch.num_rows
            pi, certainty = np.zeros((size, max(1, len(langs)))), np.ones(size)
            if langs:
                for a, b, doc, slot, n in _counts(batch.column(batch.schema.get_field_index("text")), bits):
                    pi[a:b], certainty[a:b] = infer(doc, slot, n, b - a, table, penalty)
            sure = np.asarray(batch.column(batch.schema.get_field_index("_letters"))) & bool(langs)
            flat = sure & (pi.sum(1) == 0)
            pi[flat] = 1 / max(1, len(langs))
            at = pi.argmax(1)
            pred = [langs[j] if s else "und" for j, s in zip(at, sure, strict=True)]
            score = np.where(sure, np.minimum(pi.max(1) * certainty, 1.0), 0.0)
            sets = [",".join(f"{langs[j]}:{p[j]:.3f}" for j in np.argsort(-p, kind="stable") if p[j] > 0) if s else "" for p, s in zip(pi, sure, strict=True)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ["doc_id", *names]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["doc_id", *names, "lang_pred", "score", "languages"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in ["doc_id", *names]), "lang_pred string, score double, languages string"])
    return slim.mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 4 isn't 2; a null doc_id counts as held out."""
    docs = documents(spark, sf_dir)
    docs = docs.select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True)).alias("held_out"))
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), model, keep=["held_out"])
