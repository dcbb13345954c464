"""The consumer's side: ordering checks, staging, folding, policy, migration, rebuilding."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.rules import lww_winner
from tidelog.operators.digest import limbs, md5_row_hash, normalised
from tidelog.operators.log import KEY, latest


def batch_order_violations(batches: DataFrame) -> DataFrame:
    """The first broken rule of each batch (scope, batch, position, seq, op, snapshot, cursor, next_cursor).

    For each change, in order: at or before the cursor, not after the change before it, op and
    snapshot that disagree; then a next cursor before the last change. One broken rule voids the batch.
    """
    w = Window.partitionBy("scope", "batch").orderBy("position")
    kind = (
        F.when(F.col("seq") <= F.col("cursor"), "already_applied")
        .when(F.col("seq") <= F.lag("seq").over(w), "out_of_order")
        .when((F.col("op") == "upsert") != F.col("snapshot").isNotNull(), "inconsistent")
    )
    rows = batches.withColumn("violation", kind)
    first = F.min_by(F.struct("position", "violation"), F.when(F.col("violation").isNotNull(), F.col("position")))
    out = rows.groupBy("scope", "batch").agg(first.alias("first"), F.max("seq").alias("last"), F.max("next_cursor").alias("next_cursor"))
    late = F.when(F.col("next_cursor") < F.col("last"), "cursor_would_regress")
    return out.select("scope", "batch", F.col("first.position").alias("position"), F.coalesce("first.violation", late).alias("violation")).where("violation is not null")


def stage_changes(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Each change of a batch with the version held before it and its effect: add, update, remove or noop.

    A change earlier in the batch decides what is held, a delete as well, and only without one does
    the stored row. stored has entity, entity_id, row_version of live rows.
    """
    w = Window.partitionBy(*KEY).orderBy("seq")
    rows = batch.select("scope", "seq", *KEY, "op", "row_version").withColumns({"prev_op": F.lag("op").over(w), "prev_version": F.lag("row_version").over(w)})
    rows = rows.join(stored.select(*KEY, F.col("row_version").alias("stored_version")), [*KEY], "left")
    held = F.when(F.col("prev_op") == "upsert", F.col("prev_version")).when(F.col("prev_op").isNull(), F.col("stored_version"))
    upsert, known = F.col("op") == "upsert", F.col("held_version").isNotNull()
    effect = F.when(upsert & known, "update").when(upsert, "add").when(known, "remove").otherwise("noop")
    return rows.withColumn("held_version", held).select("scope", "seq", *KEY, "op", "row_version", "held_version", effect.alias("effect"))


def digest_change(staged: DataFrame) -> DataFrame:
    """What a staged batch adds to each scope's digest: signed limb sums."""
    plus = staged.where("op = 'upsert'").select("scope", *KEY, "row_version", F.lit(1).alias("sign"))
    minus = staged.where("held_version is not null").select("scope", *KEY, F.col("held_version").alias("row_version"), F.lit(-1).alias("sign"))
    return plus.union(minus).withColumn("h", md5_row_hash()).groupBy("scope").agg(*limbs(F.col("h"), F.col("sign")))


def advanced_digest(before: DataFrame, change: DataFrame) -> DataFrame:
    """scope and digest after a change of digest, from rows held before (scope, entity, entity_id, row_version)."""
    old = before.withColumn("h", md5_row_hash()).groupBy("scope").agg(*limbs(F.col("h")))
    both = old.unionByName(change).groupBy("scope").agg(*[F.sum(f"limb{i}").alias(f"limb{i}") for i in range(4)])
    return both.select("scope", normalised().alias("digest"))


def apply_batch(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Live rows after a batch: the last change of each row in it, and stored rows that it does not touch."""
    last = latest(batch, keep=("scope", "op", "row_version"))
    kept = stored.join(last.select(*KEY), [*KEY], "left_anti").select("scope", *KEY, "row_version")
    return kept.union(last.where("op = 'upsert'").select("scope", *KEY, "row_version"))


def append_only_overwrites(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Upserts of append-only entities over a live row of another version."""
    append = registry.where("conflict_class = 'append_only'").select("entity")
    w = Window.partitionBy(*KEY).orderBy("seq")
    rows = log.select("scope", "seq", *KEY, "op", "row_version").join(append, "entity", "left_semi")
    rows = rows.withColumns({"prev_op": F.lag("op").over(w), "stored": F.lag("row_version").over(w)})
    return rows.where("op = 'upsert' and prev_op = 'upsert' and stored <> row_version").select("scope", "seq", *KEY, "stored", F.col("row_version").alias("incoming"))


class Applied(NamedTuple):
    """What one step leaves: live rows, cursors (scope, cursor), digests (scope, digest), the refused scopes and the staged changes."""

    rows: DataFrame
    cursors: DataFrame
    digests: DataFrame
    refused: DataFrame
    staged: DataFrame


def apply_step(changes: DataFrame, headers: DataFrame, stored: DataFrame, cursors: DataFrame, registry: DataFrame) -> Applied:
    """One batch of each scope, applied whole or not at all.

    changes (scope, position, seq, entity, entity_id, op, snapshot, row_version) of headers (scope, next_cursor), onto live rows (scope, entity,
    entity_id, row_version) and cursors (scope, cursor). A batch out of order, or one that writes another version over a live row of an append-only
    entity, is refused: its scope keeps rows, cursor and digest, and refused (scope, position, violation) says why, the order's rules first.
    A batch without changes moves the cursor. The results belong together and are to be published together.
    """
    before = cursors.select("scope", "cursor")
    framed = changes.join(headers.select("scope", "next_cursor"), "scope").join(before, "scope", "left").withColumns({"cursor": F.coalesce("cursor", F.lit(0)), "batch": F.lit(0)})
    order = batch_order_violations(framed).select("scope", "position", "violation", F.lit(0).alias("rank"))
    append = registry.where("conflict_class = 'append_only'").select("entity")
    over = stage_changes(changes, stored).where("op = 'upsert' and held_version <> row_version").join(append, "entity", "left_semi")
    over = over.join(changes.select("scope", "seq", "position"), ["scope", "seq"]).select("scope", "position", F.lit("append_only_overwrite").alias("violation"), F.lit(1).alias("rank"))
    first = order.union(over).groupBy("scope").agg(F.min(F.struct("rank", F.coalesce("position", F.lit(1 << 62)).alias("position"), "violation")).alias("one"))
    refused = first.select("scope", F.when(F.col("one.position") < 1 << 62, F.col("one.position")).alias("position"), "one.violation")
    fit = changes.join(refused.select("scope"), "scope", "left_anti")
    staged = stage_changes(fit, stored)
    moved = headers.select("scope", "next_cursor").join(refused.select("scope"), "scope", "left_anti")
    after = before.join(moved, "scope", "full").select("scope", F.coalesce("next_cursor", "cursor").alias("cursor"))
    return Applied(apply_batch(fit, stored), after, advanced_digest(stored, digest_change(staged)), refused, staged)


def lww(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    other = stored.select(*KEY, F.col("row_version").alias("stored_version"))
    rows = incoming.select("seq", *KEY, F.col("row_version").alias("incoming_version")).join(other, [*KEY])
    return rows.withColumn("winner", lww_winner(F.col("incoming_version"), F.col("stored_version")))


def migration_plan(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Status of each row (entity, schema_version, target): identity, backward, ready or no_path with stuck_at.

    steps are (entity, from_version). Every version between must have a step; the first that has none is where it is stuck.
    """
    keys = rows.select("entity", "schema_version", "target").distinct()
    need = keys.where("schema_version < target").withColumn("at", F.explode(F.sequence("schema_version", F.col("target") - 1)))
    have = steps.select("entity", F.col("from_version").alias("at"), F.lit(True).alias("have"))
    stuck = need.join(have, ["entity", "at"], "left").where("have is null").groupBy("entity", "schema_version", "target").agg(F.min("at").alias("stuck_at"))
    status = F.when(F.col("schema_version") == F.col("target"), "identity").when(F.col("schema_version") > F.col("target"), "backward").when(F.col("stuck_at").isNotNull(), "no_path").otherwise("ready")
    return keys.join(stuck, ["entity", "schema_version", "target"], "left").withColumn("status", status)


def migrated(rows: DataFrame, steps: DataFrame, step: dict[int, Column] | None = None) -> DataFrame:
    """rows with status and the snapshot after all steps; step[v] is the snapshot at v + 1 from that at v.

    Tombstones and rows without a target stay as they are; a row without a path keeps its bytes (status no_path),
    and so does one of which a step fails, that is gives null (status failed): nothing is half migrated.
    """
    plan = migration_plan(rows.where("target is not null"), steps)
    out = rows.join(plan, ["entity", "schema_version", "target"], "left").withColumns({"status": F.coalesce("status", F.lit("identity")), "__kept": F.col("snapshot")})
    ready = (F.col("status") == "ready") & F.col("__kept").isNotNull()
    for v in sorted(step or {}):
        due = ready & F.col("snapshot").isNotNull() & (F.col("schema_version") <= v) & (F.col("target") > v)
        out = out.withColumn("snapshot", F.when(due, step[v]).otherwise(F.col("snapshot")))
    failed = ready & F.col("snapshot").isNull()
    return out.withColumns({"status": F.when(failed, "failed").otherwise(F.col("status")), "snapshot": F.coalesce("snapshot", "__kept")}).drop("__kept")


def rebootstrap_clear(device_rows: DataFrame, rebuilt: DataFrame, registry: DataFrame) -> DataFrame:
    """device_rows without the rows of entities of the scopes (device_id, scope) that are being rebuilt."""
    gone = rebuilt.select("device_id", "scope").join(registry.select("scope", "entity"), "scope")
    return device_rows.join(gone.select("device_id", "entity").distinct(), ["device_id", "entity"], "left_anti")


# -- scope health -----------------------------------------------------------------------------

MAX_ATTEMPTS = 3


def health_step(state: str, attempts: int, diverged: bool, rebuilding: bool, compared: bool) -> tuple[str, int]:
    """One batch: a divergence counts once for each time a scope is trusted, and for each rebuild that fails."""
    if state == "unhealable" or not compared:
        return state, attempts
    if diverged and (state in ("healthy", "healed") or rebuilding and state == "tainted"):
        attempts += 1
        return ("unhealable" if attempts >= MAX_ATTEMPTS else "tainted"), attempts
    if not diverged and state == "tainted":
        return "healed", attempts
    return state, attempts


def scope_health(observations: DataFrame) -> DataFrame:
    """(device_id, scope, step, state, attempts) after each observation (…, diverged, rebuilding, compared), in order.

    The fold needs a device's batches in order; sorted rows stream through it, one state at a time.
    """

    def fold(batches):
        import pandas as pd

        key, state, attempts = None, "healthy", 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.device_id, r.scope) != key:
                    key, state, attempts = (r.device_id, r.scope), "healthy", 0
                state, attempts = health_step(state, attempts, r.diverged, r.rebuilding, r.compared)
                out.append((r.device_id, r.scope, r.step, state, attempts))
            yield pd.DataFrame(out, columns=["device_id", "scope", "step", "state", "attempts"])

    rows = observations.repartition("device_id", "scope").sortWithinPartitions("device_id", "scope", "step")
    return rows.mapInPandas(fold, "device_id int, scope string, step long, state string, attempts long")


def scopes_to_rebuild(health: DataFrame) -> DataFrame:
    """Scopes whose last state is tainted; an unhealable one is left alone."""
    last = health.groupBy("device_id", "scope").agg(F.max_by("state", "step").alias("state"), F.max_by("attempts", "step").alias("attempts"))
    return last.where("state = 'tainted'").select("device_id", "scope", "attempts")
