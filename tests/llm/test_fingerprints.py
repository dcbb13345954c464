import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.llm import fingerprints as P


def clauses(text):
    """Clauses of each line by itself: the marks end one, and the blanks after marks belong to none."""
    return [c for line in text.split("\n") for c in re.split(r"[.!?;:|]+\s*", line)]


def brute(text):
    v = [0] * (P.EXACT + P.LANES)
    for p in re.split(r"\n+", text):
        if p:
            h = hashlib.sha256(p.encode()).hexdigest()
            for i in range(8):
                v[i] = (v[i] + int(h[8 * i : 8 * i + 8], 16)) % 2**32
    for c in clauses(text):
        if c:
            h = hashlib.md5(c.encode()).hexdigest()
            w = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
            for k in range(P.LANES):
                v[8 + k] = (v[8 + k] + (1 if w[k // 32] >> k % 32 & 1 else -1)) % 2**12
    return v


def near(a, b):
    def signed(x):
        return (x + 2048) % 4096 - 2048

    both = sum(signed(x) ** 2 for x in a[8:]) + sum(signed(x) ** 2 for x in b[8:])
    return max(0.0, 1 - sum(signed(x - y) ** 2 for x, y in zip(a[8:], b[8:], strict=True)) / both) if both else 1.0


def hexed(v):
    return "".join(f"{x:08x}" for x in v[:8]) + "".join(f"{x:03x}" for x in v[8:])


def corpus(n):
    rnd = random.Random(n)
    words = ["the", "öfter", "a b", "x.", "y!\n", "z;", "\n\n", "|", "😀"]
    rows = [(rnd.randrange(10**6), " ".join(rnd.choices(words, k=rnd.randrange(60)))) for _ in range(n)]
    return rows + [(7, None), (8, ""), (9, "same"), (9, "same"), (9, "other"), (None, "keyless one")]


@pytest.mark.parametrize("n", [0, 3, 300])
def test_equals_brute_force(spark, n):
    rows = corpus(n)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, vector int").repartition(3)
    order = sorted(((-1 if k is None else k, t or "") for k, t in rows), key=lambda x: (-x[0], x[1]))
    expected = []
    for i, (k, t) in enumerate(order):
        after, third = order[(i + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        a, b = brute(t), brute(edited)
        expected.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(near(a, b), 9), round(near(a, brute(after)), 9)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in P.compared(df).collect()]
    assert sorted(got) == sorted(expected)


def test_sums(spark):
    df = spark.createDataFrame([("one a.\ntwo b", "three", "three\ntwo b\none a.")], "x string, y string, z string")
    x, y, z = (P.vector(F.col(c)) for c in "xyz")
    r = df.select(P.insert(x, y).alias("sum"), z.alias("z"), P.delete(z, y).alias("less"), x.alias("x")).first()
    assert r["sum"] == r["z"] and r["less"] == r["x"] and r["x"] != r["z"]


def test_order_of_paragraphs_and_insertion(spark):
    """Blanks at a paragraph's start or a paragraph of blanks belong to it alone, whatever stands before."""
    parts = ["  alpha beta", "gamma delta.", "   ", "\tone; two ", "gamma delta."]
    rnd = random.Random(3)
    orders = [rnd.sample(parts, len(parts)) for _ in range(12)]
    df = spark.createDataFrame([("\n".join(o), o) for o in orders], "whole string, parts array<string>")
    total = F.lit(None)
    for i in range(len(parts)):
        one = P.vector(F.get("parts", F.lit(i)))
        total = one if i == 0 else P.insert(total, one)
    got = df.select(P.vector(F.col("whole")).alias("whole"), total.alias("total"), P.delete(P.vector(F.col("whole")), P.vector(F.get("parts", F.lit(0)))).alias("less"), P.vector(F.array_join(F.slice("parts", 2, 9), "\n")).alias("rest")).collect()
    assert len({tuple(r["whole"]) for r in got}) == 1
    assert all(r["whole"] == r["total"] and r["less"] == r["rest"] for r in got)
    one, none = spark.createDataFrame([("x\n" * 4096,), ("",)], "t string").select(P.vector(F.col("t")).alias("v")).collect()
    assert one["v"] != none["v"]


def test_empty(spark):
    assert P.compared(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = P.compared(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_a_clause_that_stands_thousands_of_times(spark):
    """Likeness against exact counts of clauses: the edited text keeps two thirds of 5,000 equal lines."""
    rows = [(2, "one equal line\n" * 5_000), (1, "another line altogether\n" * 5_000)]
    got = {r.doc_id: r for r in P.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [t for _, t in rows]
    for i, (k, t) in enumerate(rows):
        after, third = order[1 - i], len(t) // 3
        lanes = [whole(x) for x in (t, t[: len(t) - third] + after[:third], after)]
        assert got[k].near_edited == pytest.approx(likeness(lanes[0], lanes[1])) and got[k].near_edited > 0.5
        assert got[k].near_next == pytest.approx(likeness(lanes[0], lanes[2]))


def whole(text):
    v = [0] * P.LANES
    for c in clauses(text):
        if c:
            h = hashlib.md5(c.encode()).hexdigest()
            w = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
            v = [x + (1 if w[k // 32] >> k % 32 & 1 else -1) for k, x in enumerate(v)]
    return v


def likeness(a, b):
    return max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) + sum(x * x for x in b)))
