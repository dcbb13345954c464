"""Invariants as queries that return their violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.log import KEY, scope_heads

ROW = ("device_id", *KEY)


def cursor_monotonic(history: DataFrame) -> DataFrame:
    """Steps at which a cursor is behind the highest before, or is gone while its device still reports at a later step (cursor null)."""
    own = ["device_id", "scope"]
    w = Window.partitionBy(*own).orderBy("step")
    steps = history.select("device_id", "step").distinct().join(history.select(*own).distinct(), "device_id")
    rows = steps.join(history, [*own, "step"], "left").withColumn("highest", F.max("cursor_seq").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where("highest is not null and (cursor_seq is null or cursor_seq < highest)").select(*own, "step", "cursor_seq", "highest")


def cursor_bounds(devices: DataFrame, log: DataFrame) -> DataFrame:
    """Cursors beyond their scope's head; a scope without changes has head 0."""
    rows = devices.join(scope_heads(log), "scope", "left").withColumn("head", F.coalesce("head", F.lit(0)))
    return rows.where("cursor_seq > head").select("device_id", "scope", "cursor_seq", "head")


def no_loss(queued: DataFrame, resolved: DataFrame) -> DataFrame:
    """Commands that are both queued and resolved."""
    return queued.select("id").intersect(resolved.select("id"))


def durability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Verdicts (id, status) of one step that the next lost or changed."""
    now = after.select("id", F.col("status").alias("now")).withColumn("there", F.lit(True))
    return before.join(now, "id", "left").where("there is null or not (status <=> now)").select("id", "status", "now")


def idempotency(results: DataFrame) -> DataFrame:
    """Commands with more than one verdict."""
    return results.groupBy("id").agg(F.count("*").alias("verdicts"), F.count_distinct("status").alias("kinds")).where("verdicts > 1")


def applied_state(device_rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows on a device that its cursor does not explain."""
    want = expected.select(*ROW, F.col("row_version").alias("expected"))
    return device_rows.join(want, [*ROW], "left").where("not (row_version <=> expected)").select(*ROW, "row_version", "expected")


def durable_effects(device_rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that a device's cursor covers and that it does not hold, or holds otherwise."""
    have = device_rows.select(*ROW, F.col("row_version").alias("held"))
    return expected.join(have, [*ROW], "left").where("held is null or held <> row_version").select(*ROW, "row_version", "held")


def convergence(device_digests: DataFrame, server_digests: DataFrame) -> DataFrame:
    """Devices whose digest differs from the server's at their cursor. A missing digest is that of no rows."""
    empty = F.lit("0" * 32)
    other = server_digests.select("device_id", "scope", F.col("digest").alias("server_digest"))
    rows = device_digests.select("device_id", "scope", F.col("digest").alias("device_digest")).join(other, ["device_id", "scope"], "full")
    rows = rows.select("device_id", "scope", F.coalesce("device_digest", empty).alias("device_digest"), F.coalesce("server_digest", empty).alias("server_digest"))
    return rows.where("device_digest <> server_digest")


def policy(superseded: DataFrame, recovered: DataFrame, registry: DataFrame) -> DataFrame:
    """Superseded drafts (id, entity) that were not recovered, and recovered ones that are no owner's draft."""
    drafts = registry.select("entity", "conflict_class")
    lost = superseded.join(drafts, "entity").where("conflict_class = 'owner_draft'").join(recovered.select("id"), "id", "left_anti")
    wrong = recovered.join(drafts, "entity", "left").where("not (conflict_class <=> 'owner_draft')")
    return lost.select("id", "entity", F.lit("not_recovered").alias("violation")).union(wrong.select("id", "entity", F.lit("wrong_class").alias("violation")))
