"""Repeated byte windows, by a depth-limited most-significant-digit radix order of suffixes.

Suffixes are ordered only as deep as the window, and only those at sampled places: a window's anchor is the smallest gram
in it (by hash), so equal windows have their anchors at equal places and every other suffix can be left out. All windows
with one anchor are one row, their run of bytes being the suffix from its left-most window. Each pass takes the next digit of the
rows that are still in a bucket with others; a row that is alone in its bucket ends there.

1. The digit is the anchor's gram.
2. The digit is the whole run. Rows with equal runs are settled: all of their windows stand elsewhere too.
3. What is left are runs that share their gram with other runs only: the edges of copied passages. Their bytes are fetched and the
   runs of a bucket are put in order, eight bytes a digit, to the right of the anchor and to its left. Runs that are neighbours in such an order
   share all digits up to their first difference, so groups that are equal through a window's bytes are exactly the repeated windows.
   A bucket beyond LIMIT rows is split first: its windows by their place before the anchor, in halves, and each half by the bytes
   that all its windows have in common.

Bucket counts are partial aggregates and are joined back, so no bucket gathers in a task. Texts travel only to rows of theirs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels as K
from tidelog.llm.runtime import batched, cut, discard, parts

WINDOW, GRAM = 200, 32
#: Rows of a bucket that one task puts in order; a larger bucket is split. Rows that a task takes at once.
LIMIT, TASK_ROWS = 50_000, 20_000
#: Bits of the filter of texts, for each text in it, and at most (2 to this power: 16 MB). It only saves shuffling texts that are not in question.
FILTER_SHARE, FILTER_BITS = 16, 27
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
NONE = np.zeros(0, np.int64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, from the running minima of blocks of w in both directions."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(K.U).max, K.U)
    padded[:n] = x
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each place, from the names of halves: none is a sum, so no regular text defeats it."""
    name, width = raw.astype(K.U), 1
    while width < gram:
        step = min(width, gram - width)  # the halves overlap where gram is no power of two
        name = K.mix((name[:-step] * np.uint64(K.BASE)) ^ (name[step:] + np.uint64(0x632BE59BD9B4E019)))
        width += step
    return name


def _anchors(raw: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, anchor, first and last window start) of each run of windows that share an anchor."""
    if len(raw) < window:
        return NONE, NONE.view(K.U), NONE, NONE, NONE
    hashes = _gram_hashes(raw, gram)
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=K.U)  # of equal grams the first
    anchor = _sliding_min(order, window - gram + 1).astype(np.uint32)
    long = np.flatnonzero(np.diff(off) >= window)
    if not len(long):
        return NONE, NONE.view(K.U), NONE, NONE, NONE
    first, stop = off[long], off[long + 1] - window + 1
    low = np.unique(np.concatenate([np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, first, stop]))
    high = np.append(low[1:], len(anchor)) - 1
    own = np.searchsorted(first, low, "right") - 1
    keep = (own >= 0) & (low < stop[own])
    low, high = low[keep], high[keep]
    at = anchor[low].astype(np.int64)
    return long[own[keep]], hashes[at], at, low, high


def _pieces(texts: pa.Array, window: int):
    """(first text, last text, bytes, offsets, place of the bytes in their text); a long text comes in pieces that overlap by a window."""
    for first, last, raw, off in K.chunks(texts):
        if len(raw) <= 2 * K.CHUNK:
            yield first, last, raw, off, 0
            continue
        for at in range(0, len(raw) - window + 1, K.CHUNK):
            piece = raw[at : at + K.CHUNK + window - 1]
            yield first, last, piece, np.array([0, len(piece)]), at


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64, copy=False) if x.dtype != K.U else x.view(np.int64))


def sampled_runs(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """(gram, run, tag, low, at, high) of each run of windows that share an anchor: places in the text, run names its bytes."""

    def scan(batches):
        for b in batches:
            for first, _, raw, off, shift in _pieces(b.column(1), window):
                text, g, at, low, high = _anchors(raw, off, window, gram)
                view = memoryview(raw)
                names = b"".join([hashlib.blake2b(view[x:y], digest_size=8).digest() for x, y in zip(low.tolist(), (high + window).tolist(), strict=True)])
                start = off[text] - shift
                yield pa.record_batch({"gram": _long(g), "run": _long(np.frombuffer(names, np.int64)), "tag": b.column(0).take(pa.array(first + text)), "low": _long(low - start), "at": _long(at - start), "high": _long(high - start)})

    return batched(keyed.select("tag", "text")).mapInArrow(scan, "gram long, run long, tag long, low long, at long, high long")


def text_filter(tags: DataFrame):
    """A broadcast bitmap that has all of tags, and few others unless there are more than it is made for."""
    tags = tags.distinct()
    bits = min(FILTER_BITS, max(10, (FILTER_SHARE * tags.count()).bit_length()))
    mask = F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(tag, {64 - bits}) % 64 as int))"))
    rows = tags.groupBy(F.expr(f"shiftrightunsigned(tag, {64 - bits}) div 64").alias("word")).agg(mask.alias("mask")).toArrow()
    map_ = np.zeros(1 << (bits - 6), K.U)
    map_[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(K.U)
    return tags.sparkSession.sparkContext.broadcast((bits, map_))


def _in(shared, tags: pa.Array) -> np.ndarray:
    bits, map_ = shared.value
    slot = tags.to_numpy().view(K.U) >> np.uint64(64 - bits)
    return (map_[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _chosen(keyed: DataFrame, shared, inside: bool) -> DataFrame:
    """Rows whose tag is in the filter, or is not."""

    def pick(batches):
        for b in batches:
            yield b.take(pa.array(np.flatnonzero(_in(shared, b.column(b.schema.get_field_index("tag"))) == inside)))

    return batched(keyed).mapInArrow(pick, keyed.schema)


def radix_order(bucket: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of bucket and bytes, and how many bytes each shares with the row before it (-1: another bucket).

    bytes is a matrix of a multiple of eight columns. Most significant digits first; a row that is alone after a digit takes no further pass.
    """
    n, width = digits.shape
    words = digits.reshape(n, width // 8, 8).view(">u8")[:, :, 0]
    order = np.argsort(bucket, kind="stable")
    begins = np.concatenate([np.ones(min(n, 1), bool), bucket[order][1:] != bucket[order][:-1]])
    for k in range(width // 8):
        group = np.cumsum(begins) - 1
        live = np.flatnonzero(np.bincount(group)[group] > 1) if n else NONE
        if not len(live):
            break
        digit = words[order[live], k]
        by = np.lexsort((digit, group[live]))
        order[live] = order[live][by]
        digit, own = digit[by], group[live]
        begins[live[1:]] |= (digit[1:] != digit[:-1]) & (own[1:] == own[:-1])
    same = np.full(n, -1, np.int64)
    if n > 1:
        differ = digits[order[1:]] != digits[order[:-1]]
        same[1:] = np.where(differ.any(1), differ.argmax(1), width)
        same[1:][bucket[order[1:]] != bucket[order[:-1]]] = -1
    return order, same


def _matrix(column: pa.ChunkedArray, width: int, backwards: bool) -> np.ndarray:
    out = np.zeros((len(column), -(-width // 8) * 8), np.uint8)
    for i, x in enumerate(column):
        a = np.frombuffer(x.as_buffer(), np.uint8)[::-1] if backwards else np.frombuffer(x.as_buffer(), np.uint8)
        out[i, : min(len(a), width)] = a[:width]
    return out


def _settle(table: pa.Table, window: int) -> pa.Table:
    """(tag, low, high): the repeated windows of runs (bucket, tag, at, least, most, before, after) whose buckets are all here.

    A window begins d bytes before the anchor, least <= d <= most. It stands twice if another run of the bucket has the same d bytes before
    the anchor and the same window - d from it, that is if both are in one class of the order to the left and of that to the right.
    """
    bucket, tag, at, least, most = (table.column(c).to_numpy() for c in ("bucket", "tag", "at", "least", "most"))
    n, widest = len(bucket), int(most.max()) if len(bucket) else 0
    right, same_right = radix_order(bucket, _matrix(table.column("after"), window, False))
    left, same_left = radix_order(bucket, _matrix(table.column("before"), max(widest, 1), True))
    hit = np.zeros((n, widest + 2), np.int8)
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(least.min()) if n else 0, widest + 1):
        one[right], two[left] = np.cumsum(same_right < window - d), np.cumsum(same_left < d)
        own = np.flatnonzero((least <= d) & (d <= most))
        _, where, count = np.unique(one[own] * (n + 1) + two[own], return_inverse=True, return_counts=True)
        hit[own[count[where] > 1], d] = 1
    edge = np.diff(hit, axis=1, prepend=0)
    row, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return pa.table({"tag": _long(tag[row]), "low": _long(at[row] - stop + 1), "high": _long(at[row] - first)})


def _common(window: int) -> Column:
    """A hash of the bytes that a run's windows from __first to __last before the anchor all have."""
    before = F.expr("substring(before, greatest(length(before) - __first + 1, 1), __first)")
    after = F.expr(f"substring(after, 1, {window} - __last)")
    return F.sha2(F.concat(before, after), 256)


def _split(rows: DataFrame, window: int) -> DataFrame:
    """Rows of large buckets in two: windows of the first and of the second half of the bucket's places, by the bytes those have in common."""
    middle = F.expr("(from + to) div 2")
    halves = F.array(F.struct(F.col("from").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("to").alias("b")))
    rows = rows.withColumn("half", F.explode(halves)).withColumns({"__first": F.col("half.a"), "__last": F.col("half.b")})
    rows = rows.withColumns({"least": F.greatest("least", "__first"), "most": F.least("most", "__last")}).where("least <= most")
    rows = rows.withColumn("bucket", F.xxhash64("bucket", "__first", "__last", _common(window)))
    return rows.withColumns({"from": F.col("__first"), "to": F.col("__last")}).drop("half", "__first", "__last")


def _ordered(rows: DataFrame, window: int, limit: int) -> DataFrame:
    """(tag, low, high) of the repeated windows of runs (bucket, tag, at, least, most, before, after, from, to)."""
    found = None
    while True:
        rows = cut(rows)
        sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        large = sizes.where((F.col("n") > limit)).select("bucket")
        small = rows.join(sizes.where(F.col("n") <= limit).select("bucket"), "bucket")
        tasks = max(parts(rows.sparkSession), -(-rows.count() // TASK_ROWS))
        some = small.withColumn("task", F.pmod(F.xxhash64("bucket"), F.lit(tasks))).groupBy("task").applyInArrow(lambda t: _settle(t, window), "tag long, low long, high long")
        found = some if found is None else found.union(some)
        if large.isEmpty():
            return found
        rows = rows.join(large, "bucket")
        whole = rows.where("from = to").withColumn("window", F.sha2(F.concat(F.expr("substring(before, length(before) - cast(least as int) + 1, cast(least as int))"), F.expr(f"substring(after, 1, {window} - cast(least as int))")), 256))
        again = whole.groupBy("bucket", "window").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "window")
        found = found.union(whole.join(again, ["bucket", "window"]).select("tag", (F.col("at") - F.col("least")).alias("low"), (F.col("at") - F.col("least")).alias("high")))
        rows = _split(rows.where("from < to"), window)


def repeated_starts(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """(tag, low, high): ranges of byte positions at which windows that stand elsewhere too start.

    keyed has tag (long; the same only for rows with equal text) and text. Ranges can repeat and adjoin.
    """
    keyed = keyed.select("tag", "text")
    runs = cut(sampled_runs(keyed, window, gram))
    grams = runs.groupBy("gram").agg(F.count("*").alias("n"), (F.min("run") < F.max("run")).alias("mixed")).where("n > 1")
    grams = cut(grams.select("gram", "mixed"))  # a join of two written tables on a gram that many rows share can be split over tasks
    live = cut(runs.join(grams, "gram"))
    discard(runs, grams)
    one = F.min(F.struct("tag", "low", "at", "high")).alias("one")  # the others of a run have the same windows
    equal = cut(live.groupBy("gram", "run").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), one))
    whole = live.join(equal.where("n > 1").select("gram", "run"), ["gram", "run"]).select("tag", "low", "high")
    edges = cut(equal.where("mixed").select("gram", "one.*"))
    wanted = edges.groupBy("tag").agg(F.collect_list(F.struct("gram", "low", "at", "high")).alias("runs"))  # 32 bytes for each run of a text

    def fetch(batches):
        for b in batches:
            out = []
            for tag, runs, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1), strict=True):
                raw = memoryview(text.as_buffer())
                out += [(r["gram"], tag, r["at"], r["at"] - r["high"], r["at"] - r["low"], bytes(raw[r["low"] : r["at"]]), bytes(raw[r["at"] : r["high"] + window])) for r in runs]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "tag", "at", "least", "most", "before", "after"])

    texts = _chosen(keyed, text_filter(edges.select("tag")), True).dropDuplicates(["tag"])
    rows = batched(texts.join(wanted, "tag").select("tag", "text", "runs")).mapInArrow(fetch, "bucket long, tag long, at long, least long, most long, before binary, after binary")
    rows = rows.withColumns({"from": F.lit(0), "to": F.lit(window - gram)})
    return whole.union(_ordered(rows, window, limit))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, spans, kept.

    Texts are their UTF-8 bytes (null: none). spans are the maximal runs (start, bytes) that
    windows of `window` bytes cover which start anywhere else too, in the same text or another;
    kept (binary) is what is left, which may end within a character. Rows that repeat each keep
    their row and count as each other's copies; texts shorter than the window keep all. An empty table gives an
    empty one. Other columns are not read. Rows are told by a 64-bit hash of doc_id and text, runs by 64 bits of BLAKE2 beside
    their gram's 64; runs that share no more than their gram are compared byte by byte.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tag"), "text")
    ranges = cut(repeated_starts(keyed, window, gram, limit))
    touched = text_filter(ranges.select("tag"))
    ranges = ranges.groupBy("tag").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))  # fewer than a text's runs and their edges
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches):
        for b in batches:
            kept, spans, sizes = [], [], []
            starts_of = b.column(2) if b.num_columns > 2 else None
            for first, last, raw, off in K.chunks(b.column(1)):
                for i in range(last - first):
                    one, found = raw[off[i] : off[i + 1]], []
                    sizes.append(len(one))
                    if starts_of is not None and starts_of[first + i].is_valid:
                        a = starts_of[first + i].values
                        low, high = (a.field(k).to_numpy() for k in ("low", "high"))
                        order = np.argsort(low, kind="stable")
                        low, end = low[order], np.maximum.accumulate(high[order] + window)
                        begins = np.concatenate([[True], low[1:] > end[:-1]])
                        low, end = low[begins], end[np.append(np.flatnonzero(begins)[1:], len(end)) - 1]
                        found = [{"start": s, "bytes": e - s} for s, e in zip(low.tolist(), end.tolist(), strict=True)]
                        cuts = [0, *np.stack([low, end], 1).ravel().tolist(), len(one)]
                        one = np.concatenate([one[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)])
                    kept.append(one.tobytes())
                    spans.append(found)
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})

    out = f"doc_id {kind}, n_bytes long, spans array<struct<start:long,bytes:long>>, kept binary"
    plain = batched(_chosen(keyed, touched, False).select("doc_id", "text")).mapInArrow(finish, out)
    cutout = _chosen(keyed, touched, True).join(ranges, "tag", "left").select("doc_id", "text", "ranges").mapInArrow(finish, out)
    return plain.union(cutout)
