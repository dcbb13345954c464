"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order by hash, form blocks. Block j of a source of weight w is
released at slot floor((j - 1) / w) and due by slot ceil(j / w). Earliest deadline first among
released blocks meets every deadline on one line of slots, so at any time a source is less than one
block from its weight. When a source has no block left, the weights of the rest are scaled up
and a new phase begins: all documents are placed, none twice.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.runtime import parts

#: Blocks of the whole schedule, which bounds the driver's work: block sizes grow with the input. Sources that
#: have no weight share blocks if there are more sources than blocks.
BLOCKS = 20_000
#: Rows that share a bucket of a source's hash order, on average.
BUCKET_ROWS = 2_000
MIXED = ("mix_block", "mix_slot", "mix_phase", "mix_position")


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int]]:
    """(source, block from 0, phase) for each slot. Sources of weight 0 come after all others, by size."""
    done, out, phase = [0] * len(blocks), [], 0
    weights = list(weights)
    while True:
        active = [i for i, n in enumerate(blocks) if done[i] < n and weights[i] > 0]
        if not active:
            if not (left := [i for i, n in enumerate(blocks) if done[i] < n]):
                return out
            for i in left:
                weights[i] = blocks[i] - done[i]
            continue
        total, slot, ended = sum(weights[i] for i in active), 0, False
        waiting = [(0, i, 1) for i in active]  # release, source, its block in this phase
        ready: list[tuple[int, int, int]] = []
        while not ended:
            while waiting and waiting[0][0] <= slot:
                _, i, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-j * total // weights[i]), i, j))
            _, i, j = heapq.heappop(ready)
            out.append((i, done[i], phase))
            done[i] += 1
            ended = done[i] == blocks[i]
            heapq.heappush(waiting, (j * total // weights[i], i, j + 1))
            slot += 1
        phase += 1


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers of the same ratios (to a millionth); none below 0."""
    exact = {s: max(Fraction(0), Fraction(w).limit_denominator(1_000_000)) for s, w in weights.items()}
    unit = lcm(*(w.denominator for w in exact.values())) if exact else 1
    return {s: int(w * unit) for s, w in exact.items()}


def mix(docs: DataFrame, weights: dict[str, float], blocks: int = BLOCKS) -> DataFrame:
    """docs (all columns) with mix_block, mix_slot, mix_phase and mix_position (from 0, gapless).

    weights gives the sources' target weights, whole or fractional; a source without one comes
    last. Null is a source of its own, named None. If there are more sources than blocks, those without a weight are
    one in the schedule: their documents come last in order of the hash, so each source is spread over
    the end in proportion. Within a source documents are in order of a hash of
    doc_id and text, so the order depends on nothing else; equal rows are interchangeable. Empty tables are
    allowed. docs needs doc_id, text and source; its other columns may have any names, and mix_* of its own are replaced.
    """
    spark = docs.sparkSession
    weights = whole_weights(weights)
    own = [c for c in docs.columns if c not in MIXED]
    docs = docs.select(F.struct(*own).alias("row"), F.col("source").alias("of"), F.xxhash64("doc_id", "text").alias("hash"))
    found = [(r["of"], r["count"]) for r in docs.groupBy("of").count().limit(blocks + 1).collect()]
    pooled = len(found) > blocks
    if pooled:
        # the named sources are as many as the caller's weights: a broadcast of that size
        named = spark.createDataFrame([(s,) for s, w in weights.items() if w > 0], "name string").coalesce(1)
        held = docs.join(F.broadcast(named), F.col("of").eqNullSafe(F.col("name")), "left_semi").groupBy("of").count()
        found = [(r["of"], r["count"]) for r in held.collect()]
    counts = sorted(found, key=lambda x: (x[0] is None, x[0]))
    targets = [weights.get(s, 0) for s, _ in counts]
    names = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(counts)], "number int, name string").coalesce(1)
    if pooled and (rest := docs.count() - sum(c for _, c in counts)):
        counts.append((None, rest))
        targets.append(0)
    n = sum(c for _, c in counts)
    block_rows = max(1, -(-n // blocks))
    sizes = [-(-c // block_rows) for _, c in counts]
    plan = schedule(sizes, targets)
    rows, position = [], 0
    for slot, (i, block, phase) in enumerate(plan):
        rows.append((i, block, slot, phase, position))
        position += min(block_rows, counts[i][1] - block * block_rows)
    slots = spark.createDataFrame(rows, "number int, mix_block long, mix_slot long, mix_phase int, first long").coalesce(1)

    bits = max(1, min(40, (max(n, 1) // BUCKET_ROWS).bit_length()), parts(spark).bit_length())
    docs = docs.withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits))
    # names and slots have a row for each source and block of the schedule: BLOCKS and a block a source at most
    docs = docs.join(F.broadcast(names), F.col("of").eqNullSafe(F.col("name")), "left" if pooled else "inner").drop("name")
    if pooled:
        docs = docs.withColumn("number", F.coalesce("number", F.lit(len(counts) - 1)))
    held = docs.groupBy("number", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("number", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("number", "bucket").orderBy("hash", *["of"] * pooled)) - 1
    placed = docs.join(starts.hint("merge"), ["number", "bucket"]).withColumn("place", place)
    placed = placed.withColumn("mix_block", F.expr(f"place div {block_rows}"))
    out = placed.join(F.broadcast(slots), ["number", "mix_block"]).withColumn("mix_position", F.expr(f"first + place % {block_rows}"))
    return out.select("row.*", *MIXED)
