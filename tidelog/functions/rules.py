"""Rules on scalar values as columns: identifiers, numbers, enums, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the wire format allows.
SCOPE, NAME, ENTITY_ID = r"^[A-Za-z0-9:_-]{1,128}$", r"^[a-z0-9_]{1,64}$", r"^[!-~]{1,64}$"
HEX32 = r"^[0-9a-f]{32}$"
UUID7 = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$"
OPS, STATUSES = ("upsert", "delete"), ("applied", "superseded", "rejected")
MAX_SNAPSHOT, MAX_PAYLOAD, MAX_REASON = 262_144, 65_536, 256
MAX_PUSH_COMMANDS, MAX_PUSH_BYTES, MAX_SCOPES = 256, 1_048_576, 64
MAX_SCHEMA = 65_535


def first_of(*rules: tuple[str, Column]) -> Column:
    """The name of the first broken rule, or null. A rule that is null counts as broken."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(name))
    return out


def change_error() -> Column:
    return first_of(
        ("scope", F.col("scope").rlike(SCOPE)),
        ("entity", F.col("entity").rlike(NAME)),
        ("entity_id", F.col("entity_id").rlike(ENTITY_ID)),
        ("op", F.col("op").isin(*OPS)),
        ("op_snapshot", (F.col("op") == "upsert") == F.col("snapshot").isNotNull()),
        ("row_version", F.col("row_version") >= 1),
        ("schema_version", F.col("schema_version").between(1, MAX_SCHEMA)),
        ("seq", F.col("seq") >= 1),
    )


def result_error() -> Column:
    reason = F.col("reason")
    return first_of(
        ("command_id", F.col("command_id").rlike(UUID7)),
        ("payload_checksum", F.col("payload_checksum").rlike(HEX32)),
        ("status", F.col("status").isin(*STATUSES)),
        ("rejected_reason", (F.col("status") != "rejected") | reason.isNotNull()),
        ("reason", reason.isNull() | (F.octet_length(reason).between(1, MAX_REASON) & ~reason.rlike(r"\p{Cc}"))),
        ("server_seq", F.col("server_seq").isNull() | (F.col("server_seq") >= 1)),
    )


def command_error() -> Column:
    return first_of(
        ("id", F.col("id").rlike(UUID7)),
        ("name", F.col("name").rlike(NAME)),
        ("scope", F.col("scope").rlike(SCOPE)),
        ("payload", F.octet_length("payload").between(2, MAX_PAYLOAD)),
        ("schema_version", F.col("schema_version").between(1, MAX_SCHEMA)),
    )


def oldest_accepted(current: int) -> int:
    return max(current - 1, 1)


def version_verdict(version: Column, current: int) -> Column:
    return F.when(version > current, "client_too_new").when(version < oldest_accepted(current), "client_too_old").otherwise("accepted")


def lww_winner(incoming: Column, stored: Column) -> Column:
    return F.when(incoming > stored, "incoming").when(incoming < stored, "stored").otherwise("tie")


def compressed(size: Column, ratio: int = 3) -> Column:
    """The stand-in compressor: one part in `ratio`, rounded up."""
    return F.ceil(size / ratio).cast("long")


def saturating_add(a: Column, b: Column) -> Column:
    """Milliseconds that stop at the ends of 64 bits."""
    top, low = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
    return F.coalesce(F.try_add(a, b), F.when(b > 0, top).otherwise(low))


def skewed_clock(true_ms: Column, offset_ms: Column) -> Column:
    """What a device's clock shows: the true time off by its skew, stopping at the ends of 64 bits."""
    return saturating_add(true_ms, offset_ms)
