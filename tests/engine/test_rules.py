"""Functions and state machines against frozen values and plain re-computation."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import documents as D
from tidelog.functions import rules
from tidelog.operators import apply, digest, invariants, log
from tidelog.sources.fixtures import Tables
from tidelog.streaming.apply_stream import apply_stream, dedupe_stream, fold, health_stream, published, replay

FOLDER = "/root/testdata/sf0.001"


def test_frozen_hashes(spark):
    import xxhash

    assert [D.blake3_hex(x) for x in (b"", b"a")] == ["af1349b9f5f9a1a6a0404dea36dcc949", "17762fddd969a453925d65717ac3eea2"]
    assert [xxhash.xxh3_128_hexdigest(x) for x in (b"", b"a")] == ["99aa06d3014798d86001c324468d497f", "a96faf705af16834e6c632b61e964e1f"]
    assert D.row_hash_hex("lessons", "l1", 1) == "895b94cd12efa8346b73a3122de3edb8"


def test_blake3_of_many_chunks():
    """The published test inputs: bytes counting up to 250, over and over."""
    data = bytes(i % 251 for i in range(2049))
    assert D.blake3_hex(data[:1024], 32).startswith("42214739f095a406")
    assert D.blake3_hex(data[:1025], 32).startswith("d00278ae47eb27b3")
    assert D.blake3_hex(data, 32).startswith("5f4d72f40d7a5f82")


def test_blake3_of_many_rows():
    rnd = random.Random(6)
    data = [rnd.randbytes(n) for n in (0, 1, 63, 64, 65, 127, 128, 1000, 1023, 1024, 1025, 3000, 0, 64)]
    assert D.blake3_rows(data) == [D.blake3_hex(x) for x in data] and D.blake3_rows([]) == []


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 63) - 1) | st.text(), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(), v, max_size=3), max_leaves=8)


@given(json_values)
def test_canonical_text_reads_back_and_is_stable(value):
    once = D.canonical(json.dumps(value))
    assert json.loads(once) == value and D.canonical(once) == once


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ('{"a":1}', None), ("{}", None), ('{"a":1.0}', "float"), ('{"a":[{"b":1e3}]}', "float"), ('{"a":NaN}', "float"), ("[1]", "not an object"), ("1", "not an object"),
        ("{", "not json"), ("", "not json"), ('{"a":1,"a":2}', "repeated key"), ('{"a":"\\ud800"}', "not json"), ("[" * 200 + "]" * 200, "too deep"),
        ('{"a":' + "9" * 30 + "}", "float"), ('{"a":"' + "x" * 100 + '"}', "too large"), (None, None),
    ],
)
def test_documents(text, why):
    assert D.violation(text, 64) == why


def test_digest_is_a_group(spark):
    """Limbs equal big integers, in any order, and batches advance a digest to that of the rows."""
    rnd = random.Random(4)
    rows = [("s", f"e{rnd.randrange(3)}", f"i{k}", rnd.randrange(1, 99)) for k in range(200)]
    df = spark.createDataFrame(rows, "scope string, entity string, entity_id string, row_version long")
    import hashlib

    def number(r):
        return int(hashlib.md5(f"{len(r[1])}:{r[1]}{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest(), 16)

    assert digest.digest(df, "scope").first()["digest"] == f"{sum(map(number, rows)) % (1 << 128):032x}"
    gone, new = rows[:80], [("s", "z", f"n{k}", 1) for k in range(9)]
    signed = spark.createDataFrame([(*r, -1) for r in gone] + [(*r, 1) for r in new], df.schema.simpleString()[7:-1].replace(":", " ") + ", sign int").withColumn("h", digest.md5_row_hash())
    change = signed.groupBy("scope").agg(*digest.limbs(F.col("h"), F.col("sign")))
    assert apply.advanced_digest(df, change).first()["digest"] == f"{sum(map(number, rows[80:] + new)) % (1 << 128):032x}"


def changes(spark, rows):
    return spark.createDataFrame(rows, "seq long, scope string, entity string, entity_id string, op string, snapshot string, row_version long, schema_version int")


def test_staging_reads_its_own_writes(spark):
    batch = changes(spark, [(10, "s", "e", "a", "upsert", "{}", 10, 1), (11, "s", "e", "a", "delete", None, 11, 1), (12, "s", "e", "a", "upsert", "{}", 12, 1), (13, "s", "e", "b", "delete", None, 13, 1), (14, "s", "e", "c", "upsert", "{}", 14, 1)])
    stored = spark.createDataFrame([("s", "e", "a", 3), ("s", "e", "c", 4)], "scope string, entity string, entity_id string, row_version long")
    got = [(r.seq, r.held_version, r.effect) for r in apply.stage_changes(batch, stored).orderBy("seq").collect()]
    assert got == [(10, 3, "update"), (11, 10, "remove"), (12, None, "add"), (13, None, "noop"), (14, 4, "update")]


def test_fresh_bootstrap_never_brings_deleted_rows_back(spark):
    rows = changes(spark, [(1, "s", "e", "a", "upsert", "{}", 1, 1), (2, "s", "e", "a", "delete", None, 2, 1), (3, "s", "e", "b", "upsert", "{}", 3, 1)])
    assert [r.seq for r in log.bootstrap(rows, "s", 0, 9).collect()] == [3]
    assert [r.seq for r in log.bootstrap(rows, "s", 1, 9).collect()] == [2, 3]
    assert log.bootstrap(rows, "s", 0, 0).collect() == []


def test_walk_equals_a_plain_loop(spark):
    t = Tables(spark, FOLDER)
    sized = t.change_log.select("scope", "seq", log.change_bytes().alias("bytes")).orderBy("scope", "seq").collect()
    expected = []
    for scope in sorted({r.scope for r in sized}):
        page, size, first, n, last = 0, 1, None, 0, None
        for r in (r for r in sized if r.scope == scope):
            if n and -(-(size + r.bytes + 1) // 3) > 700:
                expected.append((scope, page, first, last, n, size))
                page, size, first, n = page + 1, 1, None, 0
            first, last, n, size = first or r.seq, r.seq, n + 1, size + r.bytes + 1
        expected.append((scope, page, first, last, n, size))
    assert sorted(map(tuple, log.catch_up_walk(t.change_log, 700).collect())) == expected


def test_health():
    def run(*steps):
        state = ("healthy", 0)
        for s in steps:
            state = apply.health_step(*state, *s)
        return state

    bad, rebuilt_bad, rebuilt_good, unread = (True, False, True), (True, True, True), (False, True, True), (True, True, False)
    assert run(bad, bad, bad) == ("tainted", 1)
    assert run(bad, rebuilt_good) == ("healed", 1)
    assert run(bad, rebuilt_bad, rebuilt_bad, rebuilt_good) == ("unhealable", 3)
    assert run(bad, unread) == ("tainted", 1)
    assert run(bad, rebuilt_good, bad, rebuilt_good, bad) == ("unhealable", 3)


def test_invariants_hold_on_sound_data(spark):
    t = Tables(spark, FOLDER)
    expected = log.rows_at(t.devices, t.change_log)
    assert invariants.applied_state(expected, expected).isEmpty() and invariants.durable_effects(expected, expected).isEmpty()
    assert invariants.convergence(digest.digest(expected, "device_id", "scope"), digest.digest(expected, "device_id", "scope")).isEmpty()
    assert invariants.cursor_bounds(t.devices.withColumn("cursor_seq", F.lit(0)), t.change_log).isEmpty()
    assert invariants.cursor_monotonic(t.cursor_history.where("device_id % 6 <> 5")).isEmpty()


def test_saturating_arithmetic_and_versions(spark):
    top = (1 << 63) - 1
    df = spark.createDataFrame([(top, 1), (-top, -5), (1, 2)], "a long, b long")
    assert [r[0] for r in df.select(rules.saturating_add(F.col("a"), F.col("b"))).collect()] == [top, -(1 << 63), 3]
    assert rules.oldest_accepted(1) == 1 and rules.oldest_accepted(3) == 2


def test_stream_equals_batch(spark, tmp_path):
    """Changes that arrive in files, one file a batch, end in the rows of the whole log; a run again changes nothing."""
    t = Tables(spark, FOLDER)
    source, state = str(tmp_path / "log"), str(tmp_path / "state")
    replay(t.change_log.where("seq <= 120"), source, 3)
    schema = spark.read.parquet(source).schema
    for checkpoint in ("one", "one", "two"):  # a new checkpoint over the old state brings the same changes again, in order
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        apply_stream(stream, state, str(tmp_path / checkpoint)).awaitTermination()
        assert sorted(map(tuple, published(spark, state).collect())) == sorted(tuple(r)[:4] for r in log.live_rows(t.change_log.where("seq <= 120")).collect())
    heads = {r.scope: r.head for r in log.scope_heads(t.change_log.where("seq <= 120")).collect()}
    assert dict(map(tuple, published(spark, state, "cursors").collect())) == heads


def test_what_is_beyond_the_watermark_waits(spark, tmp_path):
    """A change above the watermark is not lost and not applied before the watermark passes it."""
    t = Tables(spark, FOLDER)
    state, rows = str(tmp_path / "state"), t.change_log.drop("written_at")
    for number, (low, high, watermark) in enumerate([(0, 40, 25), (40, 80, 30), (80, 81, 200)]):
        batch = rows.where(F.col("seq").between(low + 1, high))
        for _ in range(2):  # a batch that is run again
            fold(batch, state, f"t#{number}", watermark)
        upto = min(high, watermark)
        assert sorted(map(tuple, published(spark, state).collect())) == sorted(tuple(r)[:4] for r in log.live_rows(rows.where(F.col("seq") <= upto)).collect())
        assert published(spark, state, "withheld").count() == high - upto


def _streamed(spark, tmp_path, df, make, files, order):
    """The rows that a stream of df's files gives, one file a batch."""
    replay(df, str(tmp_path / "in"), files, order)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_health_equals_the_fold(spark, tmp_path):
    rows = [(d, "s", k, (d + k) % 3 == 0, k % 2 == 0, (d + k) % 5 != 0) for d in range(4) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "device_id int, scope string, step long, diverged boolean, rebuilding boolean, compared boolean")
    got = _streamed(spark, tmp_path, df, health_stream, 3, "step")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apply.scope_health(df).collect()))


def test_streamed_dedupe(spark, tmp_path):
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "x"), ("a", 4, "z"), ("b", 5, "y"), ("c", 6, "q"), ("a", 7, "x")]
    got = _streamed(spark, tmp_path, spark.createDataFrame(rows, "id string, attempt int, payload_checksum string"), dedupe_stream, 3, "attempt")
    assert [r.decision for r in got.orderBy("attempt").collect()] == ["fresh", "fresh", "replay", "mutated", "replay", "fresh", "replay"]
