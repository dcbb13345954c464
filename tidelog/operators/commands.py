"""The write path: admission, deduplication, forwarding, resolution, pushing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import documents
from tidelog.functions.rules import MAX_PUSH_BYTES, MAX_PUSH_COMMANDS, MAX_SCOPES, compressed
from tidelog.operators.apply import migrated
from tidelog.operators.log import running

# Fixed value: the reason of a rejection that has none.
NO_REASON = "Rejected by the server without a stated reason."


def admission(commands: DataFrame, command_registry: DataFrame, registry: DataFrame) -> DataFrame:
    """Each command's verdict: unknown_command, unknown_entity, server_authoritative or accepted."""
    rows = commands.join(command_registry, "name", "left").join(registry.select("entity", "conflict_class"), "entity", "left")
    verdict = (
        F.when(F.col("entity").isNull(), "unknown_command")
        .when(F.col("conflict_class").isNull(), "unknown_entity")
        .when(F.col("conflict_class") == "server_authoritative", "server_authoritative")
        .otherwise("accepted")
    )
    return rows.select("id", "name", "entity", verdict.alias("verdict"))


def payload_checksum(payload: str = "payload") -> Column:
    """The checksum of a payload's canonical form, so that the order of keys and blanks do not count."""
    return F.md5(documents.canonical_json(payload))


def decide(submitted: DataFrame, results: DataFrame) -> DataFrame:
    """fresh, replay or mutated for each submission (id, payload): results are joined by id, checksums of canonical payloads compared."""
    known = results.select(F.col("command_id").alias("id"), "payload_checksum", "status", "reason", "server_seq")
    rows = submitted.withColumn("__own", payload_checksum()).join(known, "id", "left")
    decision = F.when(F.col("payload_checksum").isNull(), "fresh").when(F.col("payload_checksum") == F.col("__own"), "replay").otherwise("mutated")
    return rows.withColumn("decision", decision).drop("__own")


def dedupe_stats(decided: DataFrame) -> DataFrame:
    def n(kind: str):
        return F.count(F.when(F.col("decision") == kind, 1))

    out = decided.agg(n("fresh").alias("fresh"), n("replay").alias("replays"), n("mutated").alias("mutated"), F.count("*").alias("total"))
    return out.withColumn("hit_rate", F.when(F.col("total") > 0, F.col("replays") / F.col("total")).otherwise(0.0))


def record_first_wins(submitted: DataFrame, results: DataFrame) -> DataFrame:
    """What is appended to results: of each id without one the first attempt."""
    first = submitted.groupBy("id").agg(F.min_by(F.struct("scope", "payload"), "attempt").alias("first"))
    new = first.join(results.select(F.col("command_id").alias("id")), "id", "left_anti")
    return new.select(F.col("id").alias("command_id"), F.col("first.scope").alias("scope"), payload_checksum("first.payload").alias("payload_checksum"))


def forward(decided: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What the client is told and whether it is recorded. outcomes (id, outcome); none is a host failure, no verdict.

    A replay is answered from the record; a mutated command is rejected and not recorded.
    """
    rows = decided.join(outcomes.select("id", "outcome"), "id", "left")
    status = F.when(F.col("decision") == "replay", F.col("status")).when(F.col("decision") == "mutated", "rejected").otherwise(F.coalesce("outcome", F.lit("unresolved")))
    recorded = (F.col("decision") == "fresh") & F.col("outcome").isNotNull()
    return rows.select("attempt", "id", "decision", status.alias("answer"), recorded.alias("recorded"))


def first_answers(results: DataFrame) -> DataFrame:
    """Of each id the first result by position."""
    picked = results.groupBy("id").agg(F.min_by(F.struct("status", "reason"), "position").alias("one"))
    return picked.select("id", "one.status", "one.reason")


def resolve_outbox(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """Each queued command's resolution and a dead letter's reason: the first answer wins and without one it stays queued.

    A rejection without a reason is kept under a stated one, since a lost command is worse than a bare reason.
    """
    rows = outbox.select("id").join(first_answers(results), "id", "left")
    rejected = F.col("status") == "rejected"
    resolution = F.when(rejected, "dead_lettered").otherwise(F.coalesce("status", F.lit("queued")))
    return rows.select("id", resolution.alias("resolution"), F.when(rejected, F.coalesce("reason", F.lit(NO_REASON))).alias("reason"))


def recovered_drafts(outbox: DataFrame, results: DataFrame, command_registry: DataFrame, registry: DataFrame) -> DataFrame:
    """Superseded commands on entities that are the owner's drafts: their payloads are kept for the owner."""
    drafts = command_registry.join(registry.where("conflict_class = 'owner_draft'").select("entity"), "entity")
    lost = first_answers(results).where("status = 'superseded'").select("id")
    return outbox.join(drafts, "name").join(lost, "id").select("id", "entity", "scope", "payload")


def reject_rates(results: DataFrame) -> DataFrame:
    rejected = F.count(F.when(F.col("status") == "rejected", 1))
    return results.groupBy("scope").agg(F.count("*").alias("results"), rejected.alias("rejected")).withColumn("reject_rate", F.col("rejected") / F.col("results"))


def migrated_outbox(outbox: DataFrame, command_registry: DataFrame, registry: DataFrame, steps: DataFrame, step: dict[int, Column]) -> DataFrame:
    """outbox with payloads brought to the version of the entity that a command writes, and whether it is held.

    Without a path to that version, or if a step fails (its column is null), a command is held: it stays queued as it is.
    A command that is not registered has no such version and goes as it is.
    """
    targets = command_registry.join(registry.select("entity", F.col("schema_version").alias("target")), "entity")
    rows = outbox.join(targets, "name", "left").withColumn("snapshot", F.col("payload"))
    rows = migrated(rows, steps, step)
    held = F.col("status").isin("no_path", "backward", "failed")
    return rows.select(*[c for c in outbox.columns if c != "payload"], F.when(held, F.col("payload")).otherwise(F.col("snapshot")).alias("payload"), held.alias("held"))


def command_text() -> Column:
    """A command's canonical form: sorted keys, the payload canonical and its checksum with it; times in milliseconds."""
    payload = documents.canonical_json("payload")
    millis = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', client_ts)").cast("string")
    return F.concat(F.lit('{"checksum":"'), F.md5(payload), F.lit('","client_ts":'), millis, F.lit(',"id":"'), "id", F.lit('","name":"'), "name", F.lit('","payload":'), payload, F.lit(',"scope":"'), "scope", F.lit('"}'))


def build_push(outbox: DataFrame, budget: int) -> DataFrame:
    """Of each scope's outbox (scope, event_id as its order, id, name, payload, client_ts, held) the commands of the next push.

    Held commands are skipped before counting; the first of the others always goes, then as many as the limits
    on number, bytes of the canonical array and its compressed bytes allow.
    """
    rows = outbox.where("not held").select("scope", "event_id", "id", F.octet_length(command_text()).cast("long").alias("bytes"))
    rows = running(rows, "scope", "event_id", total=F.col("bytes") + 1, position=F.lit(1).cast("long")).where(F.col("position") <= MAX_PUSH_COMMANDS)
    rows = rows.withColumn("total", F.col("total") + 1)
    fits = (F.col("total") <= MAX_PUSH_BYTES) & (compressed(F.col("total")) <= budget)
    return rows.where((F.col("position") == 1) | fits).select("scope", "id", "position", "total")


def push_limits(commands: DataFrame, by: str = "scope") -> DataFrame:
    """Whether all of a group's commands would fit one request, by the bytes of their canonical array."""
    size = F.sum(F.octet_length(command_text()).cast("long") + 1) + 1
    out = commands.groupBy(by).agg(F.count("*").alias("commands"), size.alias("bytes"))
    return out.withColumn("violation", F.when(F.col("commands") > MAX_PUSH_COMMANDS, "too_many").when(F.col("bytes") > MAX_PUSH_BYTES, "too_large"))


def request_limits(scopes: DataFrame, by: str) -> DataFrame:
    """How many scopes a pull names, and whether that is too many."""
    out = scopes.groupBy(by).agg(F.count_distinct("scope").alias("scopes"))
    return out.withColumn("violation", F.when(F.col("scopes") > MAX_SCOPES, "too_many_scopes"))


# -- load --------------------------------------------------------------------------------------


def shed_budget(severity: Column, budget: int, least: int) -> Column:
    """Bytes of a page under load: the budget by the severity (1: no load), never below the least."""
    return F.when(severity <= 1, F.lit(budget)).otherwise(F.greatest(F.floor(F.lit(budget) / severity), F.lit(least))).cast("long")


def accepted(offered: Column, severity: Column) -> Column:
    """How many of the offered commands are looked at under load: a prefix, one at least if any is offered."""
    share = F.greatest(F.floor(offered / F.greatest(severity, F.lit(1))), F.lit(1))
    return F.when(offered <= 0, 0).when(severity <= 1, offered).otherwise(share).cast("long")


def backpressure(offers: DataFrame) -> DataFrame:
    """Totals over pushes (offered, severity): pushes, those under load, commands taken and deferred."""
    taken = accepted(F.col("offered"), F.col("severity"))
    return offers.agg(F.count("*").alias("pushes"), F.count(F.when(F.col("severity") > 1, 1)).alias("shed"), F.coalesce(F.sum(taken), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.col("offered") - taken), F.lit(0)).alias("deferred"))
