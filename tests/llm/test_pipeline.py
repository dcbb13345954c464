"""The pipeline against plain Python, on the smallest tables and on odd rows."""

import math
import zlib
from collections import Counter

import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontam import brute as contained
from tests.llm.test_jaccard import brute as components
from tidelog.llm import hilbert
from tidelog.llm.queries import TARGET_WEIGHTS

FOLDER = "/root/testdata/sf0.001"


def kept(docs, items):
    """What the first three stages keep."""
    docs = [d for d in docs if d[1] is not None and regex.search(r"\p{L}", d[1])]
    named = {k for k, n, c in components([(d[0], d[1]) for d in docs]) if k == c or not n}
    docs = [d for d in docs if d[0] in named]
    hit = {k for k, _, h, _, _ in contained([(d[0], d[1]) for d in docs], items) if h}
    return [d for d in docs if d[0] not in hit]


def check_mixture(docs, place):
    """place is each doc_id's position: at each point every named source is near its weight, until one ends."""
    line = [d[3] for d in sorted(docs, key=lambda d: place[d[0]])]
    ends = min(max(i for i, s in enumerate(line) if s == name) for name in set(line))
    total = sum(TARGET_WEIGHTS[s] for s in set(line))
    done = Counter()
    for t, s in enumerate(line[:ends], 1):
        done[s] += 1
        assert all(abs(done[x] - t * TARGET_WEIGHTS[x] / total) < 1 for x in set(line))


def check_shards(docs, rows):
    """rows (doc_id, size, crc, shard, slot, position) are runs along the curve over language, position and size."""
    names = [x for x, _ in sorted(Counter(d[2] for d in docs if d[2] is not None).items(), key=lambda x: (-x[1], x[0]))]
    step = {x: 1 + i * 31 // len(names) for i, x in enumerate(names)} | {None: 0}
    curve, lang = hilbert.curve(5, 3), {d[0]: d[2] for d in docs}

    def key(r):
        size = min(31, max(0, math.floor(2 * math.log2(r[1])) - 6))
        return curve[(step[lang[r[0]]] * 32 + r[5] * 32 // len(docs)) * 32 + size], r[5]

    for rank, r in enumerate(sorted(rows, key=key)):
        shard = rank * 24 // len(rows)
        assert (r[3], r[4]) == (shard, rank - -(-shard * len(rows) // 24))


def test_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "size", "text_crc32", "shard", "slot", "mix_position").collect()))
    left = kept(docs, items)
    assert [r[:3] for r in got] == sorted((d[0], len(d[1].encode()) + 8, zlib.crc32(d[1].encode())) for d in left)
    assert 0 < len(got) < len(docs) and sorted(r[5] for r in got) == list(range(len(got)))
    check_mixture(left, {r[0]: r[5] for r in got})
    check_shards(left, got)


def test_the_mixture_decides_the_shards(spark, tmp_path):
    """Another order of the same rows in the files gives other positions and other shards."""
    rows = [(i, f"text number {i}", "en", f"src{i % 2}", 1) for i in range(60)]
    found = []
    for name, order in (("up", F.col("doc_id")), ("down", F.desc("doc_id"))):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        df.repartitionByRange(3, order).sortWithinPartitions(order).write.parquet(str(tmp_path / name))
        got = corpus_pipeline.sharded(spark, spark.read.parquet(str(tmp_path / name)), FOLDER).collect()
        found.append({r.doc_id: (r.mix_position, r.shard) for r in got})
    assert all(found[0][i][0] == i and found[1][i][0] == 59 - i for i in range(60))
    assert found[0] != found[1] and any(found[0][i][1] != found[1][i][1] for i in range(60))


def test_odd_rows(spark, tmp_path):
    rows = [(1, "some words of a text that is here", "en", "src0", 5), (1, "some words of a text that is here", "en", "src0", 5), (2, None, None, None, None), (3, "", "en", None, 0), (4, "12", "en", "a", 2), (None, "a text without a key", None, "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, "of no use")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, docs, FOLDER).columns) == corpus_pipeline.COLUMNS


def test_a_doc_id_may_name_several_texts(spark):
    long = "a text of more than a few words that others hold as well"
    rows = [(1, long), (2, long), (2, "another text that shares its number with the one before"), (2, "another text that shares its number with the one before"), (None, long), (None, "a text of its own without any number at all"), (7, "--"), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "src0", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs.repartition(3), FOLDER).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], *rows[5:]], key=str)
