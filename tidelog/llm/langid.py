"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order up to 3. A symbol that a context has
seen costs its share there; one it has not seen costs the context's escape (method C: as many
escapes as distinct symbols) and is then coded by the next shorter context, down to a uniform
code. The statistics are counted over all labelled texts, then frozen, so every (context,
symbol) has one exact code length, and a text's score is a sum of table lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels as K
from tidelog.llm.runtime import batched

#: Every byte is a symbol of its own.
ALPHABET = 256
#: Counts that leave a task in one batch.
COUNT_ROWS = 1 << 16
#: Distinct runs that a task holds before they leave it; the rest of their counts follow as rows of their own.
HELD_RUNS = 1 << 21
UNKNOWN = "und"


class Lengths:
    """Code lengths in bits of one language: for each order the runs that occur, sorted, and the escapes of their contexts.

    at and n are the runs of four symbols that occur and their counts; a run is a number with its last symbol as last digit.
    """

    def __init__(self, at: np.ndarray, n: np.ndarray, size: int):
        self.size, self.orders = size, []
        for order in (3, 2, 1, 0):
            run, where = np.unique(at.astype(np.int64) % size ** (order + 1), return_inverse=True)
            seen = np.bincount(where, n, len(run))
            context, first, kinds = np.unique(run // size, return_index=True, return_counts=True)
            total = np.add.reduceat(seen, first) if len(run) else seen
            bits = np.log2(np.repeat(total + kinds, kinds)) - np.log2(seen)
            self.orders.append((run.astype(np.uint32), bits.astype(np.float32), context.astype(np.uint32), (np.log2(total + kinds) - np.log2(kinds)).astype(np.float32)))

    def of(self, code: np.ndarray) -> np.ndarray:
        """Lengths of codes; sorted ones are found fastest."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        code = code.astype(np.int64)
        for order, (run, bits, context, escape) in zip((3, 2, 1, 0), self.orders, strict=True):
            own = code[left] % self.size ** (order + 1)
            found, at = _find(run, own)
            out[left[found]] += bits[at[found]]
            left, own = left[~found], own[~found]
            found, at = _find(context, own // self.size)
            out[left[found]] += escape[at[found]]
        out[left] += np.log2(self.size)
        return out

    def __getitem__(self, code: np.ndarray) -> np.ndarray:
        one, where = np.unique(code, return_inverse=True)
        return self.of(one)[where]


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values the sorted table holds, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    values = values.astype(table.dtype)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


class Model:
    """Code lengths in bits, bits[language][(((a * size) + b) * size + c) * size + symbol]."""

    def __init__(self, langs: list, symbol: np.ndarray, size: int, bits: list[Lengths]):
        self.langs, self.symbol, self.size, self.bits = langs, symbol, size, bits


def _codes(raw: np.ndarray, off: np.ndarray, symbol: np.ndarray, size: int) -> np.ndarray:
    """Each byte with the three before it in its text (symbol 0 before the first) as one number."""
    s = symbol[K.lower_ascii(raw)].astype(np.uint32)
    code, weight = s.copy(), size
    for back in (1, 2, 3):
        shifted = np.zeros_like(s)
        shifted[back:] = s[:-back] if len(s) > back else s[:0]
        for k in range(back):  # what reaches before the text's start is symbol 0
            at = off[:-1] + k
            shifted[at[at < off[1:]]] = 0
        code += shifted * weight
        weight *= size
    return code


def _alphabet(labelled: DataFrame, size: int) -> np.ndarray:
    """Symbols from 1, as 0 stands before a text. Of fewer than 256 the most frequent bytes have their own and all others share 0."""
    if size == 256:
        return np.arange(1, 257).astype(np.uint8)  # 0xFF, which is in no UTF-8 text, is 0

    def count(batches):
        n = np.zeros(256, np.int64)
        for b in batches:
            for _, _, raw, _ in K.chunks(b.column(0)):
                n += np.bincount(K.lower_ascii(raw), minlength=256)
        yield pa.record_batch({"byte": pa.array(np.arange(256)), "n": pa.array(n)})

    n = np.zeros(256, np.int64)
    for r in batched(labelled.select("text")).mapInArrow(count, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        n[r["byte"]] = r["n"]
    symbol = np.zeros(256, np.uint8)
    best = [b for b in np.argsort(-n, kind="stable")[: size - 1] if n[b]]
    symbol[best] = np.arange(1, len(best) + 1)
    return symbol


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its n."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def train(labelled: DataFrame, alphabet: int = ALPHABET) -> Model:
    """A model from rows (text, lang). All of them are counted; null texts and null languages are not.

    Counts are summed by run. The driver gets, one language after the other, the counts of the runs that occur
    and keeps these only, so its tables grow with the kinds of runs and not with the texts or the alphabet.
    """
    labelled = labelled.select("text", "lang").where("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros(256, np.uint8), 1, [])
    size = max(2, min(alphabet, ALPHABET))
    symbol = _alphabet(labelled, size)
    number = {x: i for i, x in enumerate(langs)}

    def count(batches):
        keys, counts, held = [], [], 0  # a key is a language and a run

        def rows(key, n):
            for first in range(0, len(key), COUNT_ROWS):
                some = key[first : first + COUNT_ROWS]
                yield pa.record_batch({"lang": pa.array((some >> 32).astype(np.int32)), "at": pa.array(some & 0xFFFFFFFF), "n": pa.array(n[first : first + COUNT_ROWS])})

        for b in batches:
            lang = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            for first, last, raw, off in K.chunks(b.column(0)):
                key, n = np.unique(np.repeat(lang[first:last] << 32, np.diff(off)) | _codes(raw, off, symbol, size), return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > HELD_RUNS:
                    key, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [key], [n], len(key)
                    if held > HELD_RUNS // 2:
                        yield from rows(key, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield from rows(*_summed(np.concatenate(keys), np.concatenate(counts)))

    def packed(table: pa.Table) -> pa.Table:
        at, n = table.column("at").to_numpy(), table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang").slice(0, 1), "at": pa.array([at.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    counted = batched(labelled).mapInArrow(count, "lang int, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    none = np.zeros(0, np.int64)
    bits = [Lengths(none, none, size)] * len(langs)  # languages whose texts are all empty keep these
    for r in counted.groupBy("lang").applyInArrow(packed, "lang int, at binary, n binary").toLocalIterator():
        bits[r["lang"]] = Lengths(np.frombuffer(r["at"], np.int64), np.frombuffer(r["n"], np.int64), size)
    return Model(langs, symbol, size, bits)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    lang_pred is the language whose model codes the whole text in the fewest bits (ties: the
    first in order); score is its share of the probability that all models give the text.
    A text that is null or has no letter is `und` with score 0, as is every text if the model has no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = shared.value
        for b in batches:
            pred, score = [], []
            for _, _, raw, off in K.chunks(b.column(b.schema.get_field_index("__text"))):
                code, where = np.unique(_codes(raw, off, m.symbol, m.size), return_inverse=True)
                cost = np.empty((len(m.langs), len(off) - 1))
                for i, bits in enumerate(m.bits):
                    cost[i] = np.diff(np.concatenate([[0.0], np.cumsum(bits.of(code)[where])])[off])
                best = cost.argmin(0)
                gap = np.minimum(cost - cost.min(0), 1000)
                pred += [m.langs[i] for i in best]
                score += (1 / np.exp2(-gap).sum(0)).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.langs:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    schema = docs.schema.add("lang_pred", "string").add("score", "double")
    out = batched(docs.withColumn("__text", F.col("text"))).mapInArrow(scan, schema)
    return out.withColumn("lang_pred", F.when(letter, F.col("lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(letter, F.col("score")).otherwise(0.0))
