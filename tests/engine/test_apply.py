"""One step of the consumer: whole batches or nothing."""

import hashlib

from pyspark.sql import functions as F

from tidelog.operators import apply, commands, digest, metrics

LIVE = "scope string, entity string, entity_id string, row_version long"
REGISTRY = [("note", "owner_draft"), ("entry", "append_only")]


def number(*row):
    e, i, v = row
    return int(hashlib.md5(f"{len(e)}:{e}{len(i)}:{i}{v}".encode()).hexdigest(), 16)


def step(spark, changes, headers, stored=(), cursors=()):
    """changes are (scope, seq, entity, entity_id, op, row_version); positions are their order."""
    rows = [(s, i, q, e, k, op, "{}" if op == "upsert" else None, v) for i, (s, q, e, k, op, v) in enumerate(changes)]
    df = spark.createDataFrame(rows, "scope string, position long, seq long, entity string, entity_id string, op string, snapshot string, row_version long")
    done = apply.apply_step(
        df,
        spark.createDataFrame(list(headers), "scope string, next_cursor long"),
        spark.createDataFrame(list(stored), LIVE),
        spark.createDataFrame(list(cursors), "scope string, cursor long"),
        spark.createDataFrame(REGISTRY, "entity string, conflict_class string"),
    )
    return (sorted(map(tuple, done.rows.collect())), dict(map(tuple, done.cursors.collect())), dict(map(tuple, done.digests.collect())), {r.scope: r.violation for r in done.refused.collect()})


def test_a_sound_batch(spark):
    rows, cursors, digests, refused = step(spark, [("s", 6, "note", "a", "upsert", 6), ("s", 7, "note", "b", "delete", 7)], [("s", 9)], [("s", "note", "b", 2), ("s", "note", "c", 3)], [("s", 5)])
    assert rows == [("s", "note", "a", 6), ("s", "note", "c", 3)] and cursors == {"s": 9} and not refused
    assert digests["s"] == f"{(number('note', 'a', 6) + number('note', 'c', 3)) % (1 << 128):032x}"


def test_an_empty_batch_moves_the_cursor(spark):
    rows, cursors, _, refused = step(spark, [], [("s", 9), ("new", 4)], [("s", "note", "b", 2)], [("s", 5), ("idle", 3)])
    assert rows == [("s", "note", "b", 2)] and cursors == {"s": 9, "new": 4, "idle": 3} and not refused


def test_broken_batches_change_nothing_of_their_scope(spark):
    stored = [(s, "note", f"{s}0", 1) for s in "abcde"] + [("e", "entry", "e1", 2)]
    cursors = [(s, 5) for s in "abcde"]
    changes = [
        ("a", 5, "note", "a0", "upsert", 9),  # at the cursor
        ("b", 7, "note", "b0", "upsert", 7), ("b", 7, "note", "b0", "upsert", 8),  # twice the same number
        ("c", 8, "note", "c0", "upsert", 8),  # beyond the next cursor
        ("d", 6, "note", "d0", "upsert", 6),
        ("e", 6, "note", "e0", "upsert", 6), ("e", 7, "entry", "e1", "upsert", 7),  # over an append-only row
    ]
    rows, after, digests, refused = step(spark, changes, [(s, 7) for s in "abcde"], stored, cursors)
    assert refused == {"a": "already_applied", "b": "out_of_order", "c": "cursor_would_regress", "e": "append_only_overwrite"}
    assert after == {"a": 5, "b": 5, "c": 5, "d": 7, "e": 5}
    assert rows == sorted([x for x in stored if x[0] != "d"] + [("d", "note", "d0", 6)])
    assert digests["a"] == f"{number('note', 'a0', 1):032x}"


def test_an_append_only_row_may_come_again_and_after_a_delete(spark):
    changes = [("s", 6, "entry", "x", "upsert", 2), ("s", 7, "entry", "y", "delete", 7), ("s", 8, "entry", "y", "upsert", 8)]
    rows, _, _, refused = step(spark, changes, [("s", 8)], [("s", "entry", "x", 2), ("s", "entry", "y", 1)], [("s", 5)])
    assert not refused and rows == [("s", "entry", "x", 2), ("s", "entry", "y", 8)]


def test_a_step_that_fails_leaves_the_row_whole(spark):
    rows = spark.createDataFrame([("e", 1, 3, "ok"), ("e", 1, 3, "bad"), ("e", 3, 3, "same"), ("e", 1, None, "free"), ("f", 1, 3, "stuck"), ("e", 1, 3, None)], "entity string, schema_version int, target int, snapshot string")
    steps = spark.createDataFrame([("e", 1), ("e", 2)], "entity string, from_version int")
    made = apply.migrated(rows, steps, {1: F.concat("snapshot", F.lit("+")), 2: F.when(~F.col("snapshot").startswith("bad"), F.concat("snapshot", F.lit("!")))})
    assert {(r.snapshot, r.status) for r in made.collect()} == {("ok+!", "ready"), ("bad", "failed"), ("same", "identity"), ("free", "identity"), ("stuck", "no_path"), (None, "ready")}


def test_reasons_of_dead_letters(spark):
    outbox = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    results = spark.createDataFrame([(2, "a", "rejected", "late"), (1, "a", "rejected", None), (3, "b", "rejected", "too long"), (4, "z", "applied", None)], "position long, id string, status string, reason string")
    got = sorted(map(tuple, commands.resolve_outbox(outbox, results).collect()))
    assert got == [("a", "dead_lettered", commands.NO_REASON), ("b", "dead_lettered", "too long"), ("c", "queued", None)]


def test_a_replay_with_other_blanks_and_order_of_keys(spark):
    results = spark.createDataFrame([("x", hashlib.md5(b'{"a":1,"b":"c"}').hexdigest(), "applied", None, 4)], "command_id string, payload_checksum string, status string, reason string, server_seq long")
    sent = spark.createDataFrame([(1, "x", '{"b": "c", "a": 1}'), (2, "x", '{"a":2,"b":"c"}'), (3, "y", "{}")], "attempt int, id string, payload string")
    assert {r.attempt: r.decision for r in commands.decide(sent, results).collect()} == {1: "replay", 2: "mutated", 3: "fresh"}


def test_load_and_faults(spark):
    df = spark.createDataFrame([(0, 5), (7, 1), (7, 4), (2, 9)], "offered long, severity long")
    assert [r[0] for r in df.select(commands.accepted(F.col("offered"), F.col("severity"))).collect()] == [0, 7, 1, 1]
    assert [r[0] for r in df.select(commands.shed_budget(F.col("severity"), 8000, 1500)).collect()] == [1600, 8000, 2000, 1500]
    assert tuple(commands.backpressure(df).first()) == (4, 3, 9, 7)
    assert [r[0] for r in spark.createDataFrame([(3, 0), (4, 2), (5, 2)], "i long, n long").select(metrics.every_nth(F.col("i"), F.col("n"))).collect()] == [False, True, False]


def test_digests_read_from_text(spark):
    texts = ["0" * 32, "f" * 32, "895b94cd12efa8346b73a3122de3edb8", "F" * 32, "12", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *digest.from_hex(F.col("t")))
    assert [r[0] for r in df.select(digest.normalised()).collect()] == [*texts[:3], None, None, None]
