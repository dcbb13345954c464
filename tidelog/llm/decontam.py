"""Benchmark decontamination: exact containment of item windows, found by a prefix-filtered set join.

A window is `words` consecutive words of an item (the whole item if it is shorter). To hold a
window a document must hold each of its words, so the join needs one prefix token of each
window: its rarest word in the corpus. Occurrences of prefix words give candidate positions,
which the positional bounds (the window must lie within the document) and the exact sequence
then verify. The corpus is counted once for the words of all windows. Windows go to the workers in blocks of at most BLOCK, whatever the benchmark's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels as K
from tidelog.llm.runtime import batched, cut

WORDS = 10
#: Windows in one broadcast, about 60 bytes each and their items; ten times as many words in one of the count.
BLOCK = 200_000
SLOTS = 20


def _windows(items: DataFrame, words: int) -> DataFrame:
    """(item_id, gram, size, tokens) of each window of each item."""

    def scan(batches):
        for b in batches:
            for first, _, raw, off in K.chunks(b.column(1)):
                token, bounds = K.words(raw, off, K.PLAIN)
                gram, ends = K.grams(token, bounds, words)
                n = np.diff(ends)
                text = np.repeat(np.arange(len(n)), n)
                at = bounds[:-1][text] + np.arange(len(gram)) - ends[:-1][text]
                size = np.minimum(np.diff(bounds), words)[text]
                token = token.view(np.int64)
                yield pa.record_batch({"item_id": b.column(0).take(pa.array(first + text)), "gram": pa.array(gram.view(np.int64)), "size": pa.array(size.astype(np.int32)), "tokens": pa.array([token[i : i + k] for i, k in zip(at, size, strict=True)], pa.list_(pa.int64()))})

    return batched(items).mapInArrow(scan, f"item_id {items.schema[0].dataType.simpleString()}, gram long, size int, tokens array<long>")


class _Lookup:
    """Membership of 64-bit hashes in a sorted array, most misses settled by a small bitmap."""

    def __init__(self, sorted_keys: np.ndarray):
        self.keys = sorted_keys
        self.map = np.zeros(1 << SLOTS, bool)
        self.map[(sorted_keys >> np.uint64(64 - SLOTS)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of values that are keys, and which keys."""
        at = np.flatnonzero(self.map[(values >> np.uint64(64 - SLOTS)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        hit = self.keys[key] == values[at]
        return at[hit], key[hit]


def _rarity(docs: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """(word, n): how often each word of all windows stands in all documents. A scan for each `block` words of the windows."""
    spark = docs.sparkSession
    words = cut(windows.select(F.explode("tokens").alias("word")).distinct())
    blocks = max(1, -(-words.count() // block))

    def count_of(shared):
        def count(batches):
            look, n = _Lookup(shared.value), np.zeros(len(shared.value), np.int64)
            for b in batches:
                for _, _, raw, off in K.chunks(b.column(0)):
                    np.add.at(n, look.find(K.words(raw, off, K.PLAIN)[0])[1], 1)
            at = np.flatnonzero(n)
            yield pa.record_batch({"word": pa.array(shared.value[at].view(np.int64)), "n": pa.array(n[at])})

        return count

    found = None
    for k in range(blocks):
        own = words.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k).toArrow().column("word").to_numpy()
        part = batched(docs).mapInArrow(count_of(spark.sparkContext.broadcast(np.sort(own.view(K.U)))), "word long, n long")
        found = part if found is None else found.union(part)
    return words.join(found.groupBy("word").agg(F.sum("n").alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def _prefixes(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """(gram, size, word, offset, item_ids) of each distinct window: its rarest word (ties: by word, then the first), where that stands in it, its items."""
    each = windows.groupBy("gram").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.collect_set("item_id").alias("item_ids"))
    each = cut(each)
    word = each.select("gram", F.posexplode("tokens").alias("offset", "word")).join(rarity, "word")
    rarest = word.groupBy("gram").agg(F.min(F.struct("n", "word", "offset")).alias("one"))
    return cut(each.join(rarest, "gram").select("gram", "size", "one.word", "one.offset", "item_ids"))


def _plan(block: pa.Table) -> dict:
    """The prefix table of one block of windows."""
    block = block.sort_by("word")
    gram, word = (block.column(c).to_numpy().view(K.U) for c in ("gram", "word"))
    order = np.argsort(word, kind="stable")
    gram, word = gram[order], word[order]
    used, begin = np.unique(word, return_index=True)
    items = block.column("item_ids").combine_chunks().take(pa.array(order))
    return {
        "prefix": used, "begin": np.append(begin, len(word)), "window": np.arange(len(word)), "gram": gram,
        "offset": block.column("offset").to_numpy()[order].astype(np.int64), "size": block.column("size").to_numpy()[order].astype(np.int64),
        "items": items.flatten().to_pylist(), "items_at": np.append(0, np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64),
    }


def _occurrences(plan: dict, look: _Lookup, token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, window) of every occurrence of a window."""
    at, prefix = look.find(token)
    n = plan["begin"][prefix + 1] - plan["begin"][prefix]
    ends = np.cumsum(n)
    each = np.repeat(plan["begin"][prefix] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    window = plan["window"][each]
    start = np.repeat(at, n) - plan["offset"][window]
    text = np.repeat(np.searchsorted(bounds, at, "right") - 1, n)
    inside = (start >= bounds[text]) & (start + plan["size"][window] <= bounds[text + 1])
    text, start, window = text[inside], start[inside], window[inside]
    same = K.gram_at(token, start, plan["size"][window]) == plan["gram"][window]
    return text[same], start[same], window[same]


def contained_windows(docs: DataFrame, items: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, spans, item_ids.

    spans are the maximal runs of words that windows of items (item_id, text) cover, as
    (first word from 0, words); item_ids are the sorted items with an occurring window. Null texts
    have no words; items without words have no windows; null item ids are not reported; repeated
    rows are kept; empty tables are allowed on either side and other columns are not read.
    """
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    windows = cut(_windows(items, words).dropDuplicates(["item_id", "gram"]))
    blocks = max(1, -(-windows.count() // block))
    windows = _prefixes(windows, _rarity(docs.select("text"), windows, 10 * block)).withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks)))
    item, doc = items.schema[0].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc}, tag long, n_words long, spans array<struct<start:long,words:long>>, item_ids array<{item}>"
    keyed = docs.withColumn("tag", F.xxhash64("doc_id", "text"))

    def scan_of(shared):
        def scan(batches):
            plan = shared.value
            look = _Lookup(plan["prefix"])
            for b in batches:
                for first, last, raw, off in K.chunks(b.column(1)):
                    token, bounds = K.words(raw, off, K.PLAIN)
                    text, start, window = _occurrences(plan, look, token, bounds)
                    step = np.zeros(len(token) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + plan["size"][window], -1)
                    hit = np.cumsum(step)[:-1] > 0
                    begins, ends = hit.copy(), hit.copy()
                    begins[1:] &= ~hit[:-1]
                    ends[:-1] &= ~hit[1:]
                    edge = bounds[(bounds > 0) & (bounds < len(token))]
                    begins[edge], ends[edge - 1] = hit[edge], hit[edge - 1]
                    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                    spans: list[list] = [[] for _ in range(last - first)]
                    for t, a, z in zip((np.searchsorted(bounds, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
                        spans[t].append({"start": a - int(bounds[t]), "words": z - a})
                    found: list[set] = [set() for _ in range(last - first)]
                    for t, w in {*zip(text.tolist(), window.tolist(), strict=True)}:
                        found[t].update(plan["items"][plan["items_at"][w] : plan["items_at"][w + 1]])
                    ids = pa.array([sorted(x for x in f if x is not None) for f in found], pa.list_(pa.field("element", K_ARROW.get(item, pa.string()))))
                    yield pa.record_batch({"doc_id": b.column(0).slice(first, last - first), "tag": b.column(2).slice(first, last - first), "n_words": pa.array(np.diff(bounds).astype(np.int64)), "spans": pa.array(spans, SPANS), "item_ids": ids})

        return scan

    found = None
    for k in range(blocks):
        plan = _plan(windows.where(F.col("block") == k).drop("block").toArrow())
        part = batched(keyed).mapInArrow(scan_of(spark.sparkContext.broadcast(plan)), schema)
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found.drop("tag")
    # rows with equal keys and texts have equal results, one of which a block gives for each of them
    merged = (
        found.groupBy("doc_id", "tag")
        .agg(F.max("n_words").alias("n_words"), (F.count("*") / blocks).cast("long").alias("copies"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    )
    united = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,words:bigint>>), (done, x) -> "
        "if(size(done) > 0 and element_at(done, -1).start + element_at(done, -1).words >= x.start, "
        "concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'words', "
        "greatest(element_at(done, -1).words, x.start + x.words - element_at(done, -1).start)))), concat(done, array(x))))"
    )
    return merged.withColumn("spans", united).select(
        "doc_id", "n_words", "spans", "item_ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    ).drop("copy")


K_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def clean_documents(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs, all columns, that hold no window of any item. Null texts stay."""
    tag = F.xxhash64("doc_id", "text")  # rows that share a key but not their text are told apart
    found = contained_windows(docs.select(tag.alias("doc_id"), "text"), items, words).where(F.size("spans") > 0)
    return docs.join(found.select(F.col("doc_id").alias("__tag")).distinct(), tag == F.col("__tag"), "left_anti")
