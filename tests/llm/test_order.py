"""Sharding and mixing."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import hilbert, mixing


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, "é" * rnd.randrange(40) if i % 3 else "same", rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", "c", None])))
    rows += [rows[0]] * 3 + [(None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize(("bits", "dimensions"), [(4, 3), (3, 2), (2, 4)])
def test_curve_visits_every_cell_by_single_steps(bits, dimensions):
    index = hilbert.curve(bits, dimensions)
    assert sorted(index) == list(range(len(index)))
    cells = sorted(range(len(index)), key=index.__getitem__)
    at = [[(c >> bits * i) & ((1 << bits) - 1) for i in range(dimensions)] for c in cells]
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(at, at[1:], strict=False))


@pytest.mark.parametrize("n", [5, 500])
def test_shards(spark, n):
    rows = corpus(n)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", slot int").repartition(4)
    got = hilbert.shard(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, _, _ in rows)
    by = Counter(r.shard for r in got)
    assert set(by) <= set(range(24)) and max(by.values()) - min(by.get(s, 0) for s in range(24)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(by[s])) for s in by)
    line = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert line == sorted(line)


def test_shard_files(spark, tmp_path):
    rows = corpus(60)
    hilbert.write_shards(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    nulls = [(None, None, None, None)] * 7
    hilbert.write_shards(spark.createDataFrame(nulls, SCHEMA), str(tmp_path / "nulls"), 5)
    assert spark.read.parquet(str(tmp_path / "nulls")).count() == 7
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "lang", "source").collect()) == Counter(rows)
    assert hilbert.shard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_frequent_categories_do_not_collide(spark):
    """Readers that filter on a language or a source open few shards: each of 20 sources and 4 languages has a step of its own."""
    rnd = random.Random(5)
    rows = [(i, "x" * int(2 ** rnd.uniform(3, 13)), rnd.choice(["en", "de", "fr", "es"]), f"src{min(19, int(rnd.expovariate(0.2)))}") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hilbert.shard(df, keep=("lang", "source")).cache()
    read = {r.value: r.shards for r in hilbert.shards_read(got, "lang").collect()}
    assert sum(read.values()) / len(read) <= 12  # of 24
    many = hilbert.shards_read(got, "source").collect()
    assert sum(r.shards for r in many) / len(many) <= 12
    assert sum(r.rows for r in many) == 4000


def test_many_sources_share_the_steps_left(spark):
    rows = [(i, "t", "en", f"host{i}") for i in range(100)] + [(i, "t", "en", "big") for i in range(100, 150)]
    got = hilbert.shard(spark.createDataFrame(rows, SCHEMA).repartition(3), keep=("source", "slot", "size")).collect()
    assert sorted(r.doc_id for r in got) == list(range(150))
    assert len({r.curve for r in got if r.source == "big"}) == 1


def test_schedule_stays_within_a_block():
    rnd = random.Random(1)
    for _ in range(60):
        k = rnd.randrange(1, 9)
        blocks, weights = [rnd.randrange(0, 60) for _ in range(k)], [rnd.randrange(0, 12) for _ in range(k)]
        plan = mixing.schedule(blocks, weights)
        assert Counter(i for i, _, _ in plan) == Counter({i: n for i, n in enumerate(blocks) if n})
        assert all([b for i, b, _ in plan if i == s] == list(range(blocks[s])) for s in range(k))
        for phase in {p for _, _, p in plan}:
            part = [i for i, _, p in plan if p == phase]
            left = {i for i, _, p in plan if p >= phase}
            live = [i for i in left if weights[i]]
            if not live:
                continue
            total = sum(weights[i] for i in live)
            done = Counter()
            for t, i in enumerate(part, 1):
                done[i] += 1
                assert all(abs(done[s] * total - weights[s] * t) < total for s in live)


def test_mix(spark):
    rows = corpus(400)
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", mix_slot int").withColumns({"number": F.lit("x"), "hash": F.lit("y"), "__hash": F.lit(1), "first": F.lit(2)}).repartition(3)
    mixed = mixing.mix(df, {"a": 0.5, "b": 0.5, "c": 1}, blocks=100)
    assert mixed.columns == [*"doc_id text lang source number hash __hash first".split(), *mixing.MIXED]
    got = mixed.collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got) == Counter(rows)
    sizes = Counter(r.source for r in rows_of(rows))
    names = sorted(sizes, key=lambda s: (s is None, s))
    block = -(-len(rows) // 100)
    plan = mixing.schedule([-(-sizes[s] // block) for s in names], [{"a": 1, "b": 1, "c": 2}.get(s, 0) for s in names])
    line = sorted(got, key=lambda r: r.mix_position)
    assert [(names.index(r.source), r.mix_block, r.mix_phase) for r in line] == [p for p in plan for _ in range(min(block, sizes[names[p[0]]] - p[1] * block))]
    assert mixing.mix(df.limit(0), {"a": 1}).collect() == []


def test_ties_and_weights(spark):
    """Equal rows share a hash and take different places; weights keep their ratio as whole numbers."""
    rows = [(1, "same", "en", "a")] * 50 + [(2, "other", "en", "b")] * 50
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), {"a": 0.75, "b": 0.25}, blocks=100).collect()
    assert sorted(r.mix_position for r in got) == list(range(100))
    line = [r.source for r in sorted(got, key=lambda r: r.mix_position)]
    assert all(abs(line[:k].count("a") - 0.75 * k) < 1 for k in range(60))
    assert mixing.whole_weights({"a": 0.5, "b": 1 / 3, "c": 0, "d": -1}) == {"a": 3, "b": 2, "c": 0, "d": 0} and mixing.whole_weights({}) == {}


def rows_of(rows):
    from types import SimpleNamespace

    return [SimpleNamespace(source=r[3]) for r in rows]


def test_mix_of_more_sources_than_blocks(spark):
    rows = [(i, f"text {i}", "en", s) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + [f"web{k}" for k in range(50)] * 2 + [None] * 10)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix(df, {"a": 2, "b": 1, "gone": 1}, blocks=40).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got) == Counter(rows)
    line = [r.source for r in sorted(got, key=lambda r: r.mix_position)]
    assert set(line[:90]) == {"a", "b"} and not {"a", "b"} & set(line[90:])
    assert all(abs(line[:k].count("a") - k * 2 / 3) <= 5 for k in range(90))
    assert sorted(r.source for r in mixing.mix(df, {}, blocks=40).collect() if r.source) == sorted(s for *_, s in rows if s)
