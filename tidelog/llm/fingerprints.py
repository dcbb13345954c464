"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

Each paragraph is hashed to a wide vector and a document's vector is the sum of its paragraphs'
modulo powers of two. Sums do not depend on order, and a paragraph is inserted or deleted by
adding or subtracting its vector. The vector has two parts:

* exact: the eight 32-bit words of the paragraph's SHA-256, summed modulo 2**32;
* likeness: for each clause of the paragraph, plus or minus one by each bit of its MD5, summed modulo
  2**32. The squared distance of two such sums estimates how many clauses two documents do not share.
  A fingerprint shows the lanes modulo 2**12, which is as much a sum; likeness is taken of whole lanes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.runtime import parts

EXACT, LANES = 8, 128
EXACT_BITS, LANE_BITS, SHOWN_BITS = 32, 32, 12
#: Where a paragraph ends, and where a clause ends in a paragraph.
PARAGRAPH, CLAUSE = r"\n+", r"[.!?;:|]+\s*"


def _word(hexes: Column, at: Column) -> Column:
    return F.conv(F.substr(hexes, at * 8 + 1, F.lit(8)), 16, 10).cast("long")


def vector(text: Column) -> Column:
    """array<bigint> of EXACT + LANES numbers; of the empty text: zeros.

    Clauses are cut within a paragraph, so a paragraph's numbers do not depend on its neighbours.
    """
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: p != "")
    parts = F.filter(F.flatten(F.transform(paragraphs, lambda p: F.split(p, CLAUSE))), lambda c: c != "")

    def zeros(n: int) -> Column:
        return F.array_repeat(F.lit(0).cast("long"), n)

    words = F.transform(paragraphs, lambda p: F.sha2(p, 256))
    numbers = F.array(*[F.lit(i) for i in range(EXACT)])
    exact = F.aggregate(words, zeros(EXACT), lambda acc, h: F.zip_with(acc, numbers, lambda a, i: a + _word(h, i)))
    quarters = F.array(*[F.lit(i) for i in range(4)])
    clauses = F.transform(F.transform(parts, F.md5), lambda h: F.transform(quarters, lambda i: _word(h, i)))
    bits = F.array(*[F.lit(i) for i in range(LANES)])
    lanes = F.aggregate(
        clauses,
        zeros(LANES),
        lambda acc, w: F.zip_with(
            acc, bits, lambda a, i: a + F.call_function("shiftright", F.get(w, F.call_function("shiftright", i, F.lit(5))), i.bitwiseAND(31)).bitwiseAND(1) * 2 - 1
        ),
    )
    return F.concat(_modulo(exact, EXACT_BITS), _modulo(lanes, LANE_BITS))


def _modulo(v: Column, bits: int) -> Column:
    return F.transform(v, lambda x: x.bitwiseAND((1 << bits) - 1))


def _each(a: Column, b: Column, sign: int) -> Column:
    v = F.zip_with(a, b, lambda x, y: x + y * sign)
    return F.concat(_modulo(F.slice(v, 1, EXACT), EXACT_BITS), _modulo(F.slice(v, EXACT + 1, LANES), LANE_BITS))


def insert(document: Column, paragraphs: Column) -> Column:
    """Vector of a document with the paragraphs of another vector added."""
    return _each(document, paragraphs, 1)


def delete(document: Column, paragraphs: Column) -> Column:
    """Vector of a document without the paragraphs of another vector."""
    return _each(document, paragraphs, -1)


def hexed(v: Column) -> Column:
    """A vector as text: 8 hexadecimal digits for each exact word, the last 3 for each lane."""
    exact = F.transform(F.slice(v, 1, EXACT), lambda x: F.lpad(F.hex(x), 8, "0"))
    lanes = F.transform(_modulo(F.slice(v, EXACT + 1, LANES), SHOWN_BITS), lambda x: F.lpad(F.hex(x), 3, "0"))
    return F.lower(F.array_join(F.concat(exact, lanes), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: about twice the shared clauses by the clauses of both; 1 for equal vectors."""
    half = 1 << (LANE_BITS - 1)

    def squares(v: Column) -> Column:
        wrapped = F.transform(v, lambda x: (x + half).bitwiseAND((1 << LANE_BITS) - 1) - half)
        return F.aggregate(wrapped, F.lit(0.0), lambda s, x: s + x.cast("double") * x)

    a, b = F.slice(a, EXACT + 1, LANES), F.slice(b, EXACT + 1, LANES)
    both = squares(a) + squares(b)
    apart = squares(F.zip_with(a, b, lambda x, y: x - y))
    return F.when(both == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below key, counted in two steps for long lists."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*map(F.lit, bounds[step - 1 :: step]))
    skipped = F.size(F.filter(coarse, lambda b: b < key)) * step
    fine = F.slice(F.array(*map(F.lit, bounds)), skipped + 1, F.lit(step))
    return skipped + F.size(F.filter(fine, lambda b: b < key))


def with_next(docs: DataFrame, columns: dict[str, Column], then: dict[str, Column]) -> DataFrame:
    """docs (doc_id, text) with what the next document in descending doc_id has.

    Documents are cut into ranges of doc_id whose upper bounds are ids of theirs. A bound's rows
    also go to the range above, as what comes after its last document; those of the
    largest id go behind the smallest. So texts are shuffled once and no task gets more than a range. columns
    are computed from text and next_text before, then from next_<name> of those after.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__key"))
    ranges = min(4 * parts(docs.sparkSession), 20_000)
    shares = [(i + 1) / ranges for i in range(ranges)]
    found = docs.agg(F.percentile_approx("__key", shares, 20 * ranges).alias("b"), F.max("__key").alias("m")).first()
    bounds = sorted({*(found["b"] or []), found["m"]} - {None}) or [0]
    at = _bucket(F.col("__key"), bounds)
    docs = docs.withColumn("__range", at)
    own = F.struct(F.col("__range").alias("at"), F.lit(0).alias("order"))
    after = F.struct(F.when(F.col("__key") == bounds[-1], 0).otherwise(F.col("__range") + 1).alias("at"), F.when(F.col("__key") == bounds[-1], 2).otherwise(1).alias("order"))
    places = F.when(F.col("__key").isin(bounds) if len(bounds) < 50 else F.array_contains(F.array(*map(F.lit, bounds)), F.col("__key")), F.array(own, after)).otherwise(F.array(own))
    rows = docs.withColumn("__place", F.explode(places)).select("doc_id", "text", "__key", F.col("__place.at").alias("__range"), F.col("__place.order").alias("__order"))
    window = Window.partitionBy("__range").orderBy("__order", F.desc("__key"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(window)).withColumns(columns)
    keep = [c for c in ("doc_id", "__key", "__range", "__order", "text") if c in rows.columns]
    rows = rows.select(*keep, *columns)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in then})
    return rows.where("__order = 0").drop("__key", "__range", "__order")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vector, fingerprint) of each row: the operator itself. Null texts are empty, rows that repeat are kept."""
    return docs.select(key, vector(F.col(text)).alias("vector")).withColumn("fingerprint", hexed(F.col("vector")))


def compared(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last third (rounded down) replaced by as many first code points of
    the next document in descending doc_id; after the last comes the first, and a single document is its own next. Rows of one
    doc_id are in order of their texts, null doc_ids are the smallest. Null texts are empty. Other columns are not read.
    """
    n = F.char_length("text")
    third = F.expr("char_length(text) div 3").cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), (n - third).cast("int")), F.substr(F.col("next_text"), F.lit(1), third))
    columns = {"n_chars": n.cast("long"), "edited": edited, "vector": vector(F.col("text"))}
    rows = with_next(docs, columns, {"vector": F.col("vector")}).drop("text")
    rows = rows.withColumn("edited_vector", vector(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hexed(F.col("vector")).alias("fingerprint"),
        hexed(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
