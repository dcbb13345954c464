import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import kernels as K
from tidelog.llm.jaccard import PIVOTS, _Group, join_counts, near_duplicates

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    names = {}
    for i, (k, _) in enumerate(rows):
        names[root(i)] = min(names.get(root(i), k), k)
    return sorted((k, len(sets[i]), names[root(i)] if sets[i] else k) for i, (k, _) in enumerate(rows))


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "Ünd", "x-y"]
    shared = [[rnd.choice(vocabulary) for _ in range(30)] for _ in range(4)]
    texts = []
    for _ in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 6, 12, 40, 120]))]
        if rnd.random() < 0.4:
            w += rnd.choice(shared)
        texts.append(w)
    for _ in range(200):
        w = list(rnd.choice(texts))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts.append(w)
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(texts)]
    rows = [(k, t.upper() if k % 7 == 0 else t) for k, t in rows]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two three four five")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string").repartition(5)
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    rows = [(5, "a b c d e f")] * 3 + [(4, "a b c d e f"), (None, "q"), (None, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 2, 4)] * 3 + [(4, 2, 4), (None, 1, None), (None, 0, None)], key=str)


def test_many_near_copies_of_one_text(spark):
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(600):
        w = list(base)
        w[i % 60] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 600


@pytest.mark.parametrize("group_bytes", [30_000, 6_000])
def test_groups_beyond_one_task(spark, group_bytes):
    """Chains of edits, each set near the one before only, with copies of a text and strangers that share a passage."""
    rnd = random.Random(9)
    rows, w = [], [f"t{i}" for i in range(40)]
    for i in range(150):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[rnd.randrange(40)] = f"n{i}" if i % 50 == 49 else rnd.choice(["red", "blue", "green"])
    base = rows[70][1].split()
    for i in range(80):
        v = list(base)
        v[i % 40] = f"e{i % 7}"
        rows.append((200 + i, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, group_bytes=group_bytes).collect())) == brute(rows)


def sets_of(rnd, m):
    """Edits of a few sets, some behind boilerplate that all share."""
    universe = rnd.choice([30, 100, 1000])
    base = [rnd.sample(range(universe), rnd.randrange(4, min(universe, 30))) for _ in range(rnd.randrange(1, 4))]
    boiler = list(range(10**6, 10**6 + rnd.choice([0, 10, 40])))
    sets = []
    for _ in range(m):
        one = set(rnd.choice(sets).tolist() if sets and rnd.random() < 0.5 else rnd.choice(base) + boiler)
        for _ in range(rnd.randrange(4)):
            if one and rnd.random() < 0.5:
                one.discard(rnd.choice(sorted(one)))
            one.add(rnd.randrange(universe))
        sets.append(np.array(sorted(one), np.uint64))
    return sets


def test_regions_equal_all_pairs():
    rnd = random.Random(4)
    total = Counter()
    for _ in range(150):
        sets = sets_of(rnd, rnd.randrange(2, 60))
        size = np.array([len(x) + rnd.choice([0, 0, 0, 1, 2]) for x in sets])
        group = _Group(size, sets)
        label = group.join()
        total.update(group.counts)
        a, b = [], []
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                both = len(np.intersect1d(x, y))
                if 4 * both >= 3 * (size[i] + size[j] - both):
                    a.append(i)
                    b.append(j)
        expected = K.components(len(sets), np.array(a, int), np.array(b, int))
        assert len({*zip(label.tolist(), expected.tolist(), strict=True)}) == len(set(label.tolist())) == len(set(expected.tolist()))
    assert total["pivots"] > total["regions"] > 100 and total["copies"] > 0


@pytest.mark.parametrize("m", [500, 2000])
def test_boilerplate_costs_no_pairs(m):
    """Pages that share four fifths and do not link: no pair of them is looked at."""
    sets = [np.concatenate([np.arange(320), np.arange(10**6 + 80 * i, 10**6 + 80 * i + 80)]).astype(np.uint64) for i in range(m)]
    group = _Group(np.full(m, 400), sets)
    assert len(np.unique(group.join())) == m
    assert group.counts["compared"] == 0 and group.counts["pivots"] <= 2 * PIVOTS


def test_counts_of_a_table(spark):
    rows = corpus(1)
    found = join_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert found and all(r.pivots >= 1 and r.sets >= 2 for r in found)
    assert sum(r.regions for r in found) > 0
