import random
import re

import pytest

from tidelog.llm.decontam import clean_documents, contained_windows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))


def brute(docs, items, k=10):
    out = []
    for d, t in docs:
        w = tokens(t)
        hit, ids = [False] * len(w), set()
        for i, text in items:
            v = tokens(text)
            for s in range(max(1, len(v) - k + 1) if v else 0):
                x = v[s : s + k]
                for a in range(len(w) - len(x) + 1):
                    if w[a : a + len(x)] == x:
                        hit[a : a + len(x)] = [True] * len(x)
                        ids.add(i)
        out.append((d, len(w), sum(hit), sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)), sorted(ids - {None})))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["A", "b", "é", "x1", "Zü", "0", "dog"] + [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 9, 10, 11, 25])))) for i in range(25)]
    items += [(90, None), (91, items[4][1]), (92, "one; TWO")]
    docs = []
    for i in range(80):
        w = rnd.choices(vocabulary, k=rnd.choice([0, 3, 20, 60]))
        for _ in range(rnd.randrange(3)):
            v = tokens(rnd.choice(items)[1])
            a = rnd.randrange(len(v) + 1)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = v[a : a + rnd.randrange(5, 26)]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    return docs + [(500, None), (501, ""), (502, "...one-two!"), (7, docs[7][1]), (None, "one two")], items


@pytest.mark.parametrize(("seed", "block"), [(1, 200_000), (2, 200_000), (3, 20)])
def test_equals_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, item_id string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    found = contained_windows(d, i, block=block)
    got = [(r.doc_id, r.n_words, sum(s.words for s in r.spans), len(r.spans), r.item_ids) for r in found.collect()]
    assert sorted(got, key=str) == brute(docs, items)
    clean = {k for k, _, hit, _, _ in brute(docs, items) if not hit}
    assert {r.doc_id for r in clean_documents(d, i).collect()} == clean


def test_empty_tables(spark):
    d, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "item_id long, text string"
    assert [tuple(r) for r in contained_windows(d, spark.createDataFrame([], none)).collect()] == [(1, 2, [], [])]
    assert contained_windows(d.limit(0), spark.createDataFrame([(1, "a")], none)).collect() == []
