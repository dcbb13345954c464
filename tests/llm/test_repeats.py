import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import repeats
from tidelog.llm.repeats import remove_repeats


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if n[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((k, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    rows = df.selectExpr("doc_id", "n_bytes", "aggregate(spans, 0L, (a, x) -> a + x.bytes)", "size(spans)", "sha2(kept, 256)")
    return sorted(map(tuple, rows.collect()), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    letters = "abcdefgh éü\n"
    passage = ["".join(rnd.choices(letters, k=k)) for k in (30, 60, 90, 200)]
    texts = []
    for _ in range(80):
        t = "".join(rnd.choices(letters, k=rnd.choice([0, 5, 30, 120, 400])))
        for p in rnd.sample(passage, rnd.randrange(3)):
            at = rnd.randrange(len(t) + 1)
            a, b = sorted((rnd.randrange(len(p)), rnd.randrange(len(p))))
            t = t[:at] + rnd.choice([p, p[a:b]]) + t[at:]
        texts.append(t)
    texts += rnd.sample(texts, 10) + ["a" * 300, "ab" * 150, "xyz" * 31, None, "", passage[3] * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "q" * 70)]
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 1000), (2, 1000), (3, 6)])
def test_equals_brute_force(spark, seed, limit):
    """With a limit of six rows most buckets are split, down to single windows."""
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, tag int").repartition(3)
    assert digest(remove_repeats(df, window=40, gram=12, limit=limit)) == brute(rows, 40)


def test_production_window_and_regular_strings(spark):
    """Passages of 199, 200 and 260 bytes, and strings that are regular in every power of two."""
    rnd = random.Random(8)

    def text(n):
        return "".join(rnd.choices("abcdefghijklmnop qrstuvwxyz", k=n))

    regular, other = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(2048)) for flip in (0, 1)]
    shared = [text(k) for k in (199, 200, 260)]
    rows = [(i, text(90) + shared[i % 3] + text(50)) for i in range(9)] + [(20, text(30) + regular), (21, other + text(10)), (22, text(5000))]
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 200)


def test_very_long_text(spark, monkeypatch):
    """A text that is handled in pieces gives what it gives as one."""
    rnd = random.Random(2)
    body = "".join(rnd.choices("abcdefgh ", k=30_000))
    rows = [(1, body[:20_000] + body[5_000:9_000] + body[20_000:]), (2, "short " + body[100:400])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = repeats.sampled_runs(df.selectExpr("doc_id as tag", "text"), 200, 32).collect()
    assert digest(remove_repeats(df)) == brute(rows, 200)
    texts = pa.array([t for _, t in rows])
    monkeypatch.setattr(repeats.K, "CHUNK", 1_000)
    found = []
    for first, _, raw, off, shift in repeats._pieces(texts, 200):
        text, _, at, low, high = repeats._anchors(raw, off, 200, 32)
        found += [(first + t, a + shift - off[t], x) for t, a, lo, hi in zip(text.tolist(), at.tolist(), low.tolist(), high.tolist(), strict=True) for x in range(lo + shift - off[t], hi + shift - off[t] + 1)]
    assert sorted(found) == sorted((r.tag - 1, r.at, x) for r in whole for x in range(r.low, r.high + 1))


def test_radix_order():
    rnd = np.random.default_rng(1)
    digits = rnd.integers(0, 2, (300, 16)).astype(np.uint8)
    digits[:, :9] = 1
    bucket = rnd.integers(0, 5, 300)
    order, same = repeats.radix_order(bucket, digits)
    line = [(bucket[i], digits[i].tobytes()) for i in order]
    assert line == sorted(line)
    for (a, x), (b, y), n in zip(line, line[1:], same[1:], strict=False):
        assert n == (-1 if a != b else next((k for k in range(16) if x[k] != y[k]), 16))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
