"""Shards along a Hilbert curve over several metadata dimensions.

Language, source and length are quantised to 2**BITS steps each (the most frequent languages and sources get steps
of their own); rows are sorted by the index of their cell on the curve, so neighbours in a shard are alike in all three, and the
sorted sequence is cut into runs. A reader that filters on any dimension then skips most files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.runtime import numbered

SHARDS, BITS, DIMENSIONS = 24, 5, 3
#: Values of a category with a step of their own; the steps beyond are shared by the rest.
OWN_STEPS = 24
SHARDED = ("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def curve(bits: int = BITS, dimensions: int = DIMENSIONS) -> list[int]:
    """Index on the curve of each cell; a cell's number has its coordinates one after the other."""
    out = [0] * (1 << bits * dimensions)
    for cell in range(len(out)):
        x = [(cell >> bits * (dimensions - 1 - i)) & ((1 << bits) - 1) for i in range(dimensions)]
        bit = 1 << (bits - 1)
        while bit > 1:  # undo the turns and mirrors of each level, the coarsest first
            low = bit - 1
            for i in range(dimensions):
                if x[i] & bit:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[i]) & low
                    x[0] ^= swap
                    x[i] ^= swap
            bit >>= 1
        for i in range(1, dimensions):
            x[i] ^= x[i - 1]
        turn, bit = 0, 1 << (bits - 1)
        while bit > 1:
            if x[-1] & bit:
                turn ^= bit - 1
            bit >>= 1
        x = [a ^ turn for a in x]
        for level in range(bits - 1, -1, -1):
            for a in x:
                out[cell] = out[cell] << 1 | (a >> level & 1)
    return out


def frequency_steps(docs: DataFrame, column: str) -> list:
    """The most frequent values of a column, which get a step of their own, most frequent first (ties: in order)."""
    counts = docs.where(F.col(column).isNotNull()).groupBy(column).count()
    return [r[column] for r in counts.orderBy(F.desc("count"), column).limit(OWN_STEPS).collect()]


def category_step(value: Column, own: list) -> Column:
    """Step 0 for null; the values in `own` are spread evenly over the steps, all others share the steps between, by their CRC.

    Spread values use the curve's coarse levels as well, which tell apart what lands in different shards.
    """
    steps = 1 << BITS
    at = [1 + i * (steps - 1) // len(own) for i in range(len(own))]
    left = sorted(set(range(1, steps)) - set(at))
    other = F.element_at(F.array(*map(F.lit, left)), (F.pmod(F.crc32(value.cast("string")), F.lit(len(left))) + 1).cast("int"))
    if not own:
        return F.when(value.isNull(), 0).otherwise(other)
    table = F.create_map(*[x for v, i in zip(own, at, strict=True) for x in (F.lit(v), F.lit(i))])
    return F.when(value.isNull(), 0).otherwise(F.coalesce(F.element_at(table, value), other))


def size_step(size: Column) -> Column:
    """Two steps for each power of two from 8 bytes up, parted at the root of two; in whole numbers, so that no rounding decides."""
    power = F.length(F.bin(size)) - 1
    upper = F.when(size * size >= F.call_function("shiftleft", F.lit(2).cast("long"), 2 * power), 1).otherwise(0)
    return F.least(F.greatest(2 * power + upper - 6, F.lit(0)), F.lit((1 << BITS) - 1)).cast("int")


def share_step(number: Column, total: int) -> Column:
    """A step for each equal run of a number from 0 below total."""
    return F.expr("0") if total < 1 else F.floor(number * (1 << BITS) / total).cast("int")


def curve_index(*steps: Column) -> Column:
    """Index on the curve of the cell at these steps."""
    cell = steps[0]
    for x in steps[1:]:
        cell = cell * (1 << BITS) + x
    table = F.split(F.lit(",".join(map(str, curve(BITS, len(steps))))), ",").cast("array<int>")  # folded once
    return F.element_at(table, (cell + 1).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = (), position: str | None = None, size: Column | None = None, crc: Column | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source): doc_id, size, text_crc32, curve, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 8. The curve runs over steps of language, source and size; with
    `position`, a column of numbers from 0 to the count of rows, over its runs in place of the sources. size and crc give the text's bytes
    and CRC where docs has no text. Rows are ordered by curve index, CRC (position, if given), doc_id and size; shards are runs of that order with row counts at most one apart, slot counts
    from 0 in each. Null dimensions are step 0; equal rows get neighbouring slots. With fewer rows than shards
    some shards stay empty. keep names further columns of docs to return, under their names unless the result has such a column.
    """
    size = F.octet_length("text") if size is None else size
    crc = F.crc32(F.coalesce("text", F.lit(""))) if crc is None else crc
    kept = {c: f"__keep{i}" for i, c in enumerate(keep) if c not in (*SHARDED, *([position] if position else []))}
    third = F.col(position).alias("__third") if position else F.col("source").alias("__third")
    rows = docs.select("doc_id", *[F.col(c).alias(k) for c, k in kept.items()], F.col("lang").alias("__lang"), third, (F.coalesce(size, F.lit(0)) + 8).cast("long").alias("__size"), crc.alias("__crc"))
    own = frequency_steps(docs, "lang")
    along = share_step(F.col("__third"), docs.count()) if position else category_step(F.col("__third"), frequency_steps(docs, "source"))
    rows = rows.withColumn("__curve", curve_index(category_step(F.col("__lang"), own), along, size_step(F.col("__size"))))
    rows = rows.drop("__lang", *([] if position else ["__third"]))
    rows = numbered(rows, F.col("__curve"), F.col("__third" if position else "__crc"), F.col("doc_id"), F.col("__size"), name="__rank")
    n = rows.count()
    rows = rows.withColumn("__shard", F.expr(f"__rank * {shards} div {max(n, 1)}"))
    first = F.expr(f"(__shard * {n} + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id",
        *[F.col(k).alias(c) for c, k in kept.items()],
        *([F.col("__third").alias(position)] if position else []),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__curve").alias("curve"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__rank") - first).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as Parquet under path, a folder for each shard, rows in order of their slot.

    Columns of docs keep their names, but size, text_crc32, curve, shard and slot are those of the shards. Null keys, texts and
    dimensions are rows as all others; an empty table writes no folder.
    """
    own = [c for c in docs.columns if c not in SHARDED]
    every = shard(docs, shards, keep=tuple(own))
    every.select("doc_id", *own, "shard", "slot").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shards_read(sharded: DataFrame, dimension: str) -> DataFrame:
    """For each value of a kept dimension, how many shards a reader must open that filters on it: value, shards, rows."""
    return sharded.groupBy(F.col(dimension).alias("value")).agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("rows"))
