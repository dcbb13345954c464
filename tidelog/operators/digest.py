"""Order-independent digests of row sets: sums modulo 2**128, as four limbs of 32 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS = 4
MOD = 1 << 32


def md5_row_hash() -> Column:
    """MD5 of a row's key behind its lengths, and its version."""
    text = F.concat(F.octet_length("entity").cast("string"), F.lit(":"), "entity", F.octet_length("entity_id").cast("string"), F.lit(":"), "entity_id", F.col("row_version").cast("string"))
    return F.md5(text)


def limbs(hash_hex: Column, sign: Column | int = 1) -> list[Column]:
    """Sums of each limb of a 32-digit hash; sign -1 takes a row out. Limb 0 is the highest."""
    return [F.coalesce(F.sum(F.conv(F.substring(hash_hex, 8 * i + 1, 8), 16, 10).cast("long") * sign), F.lit(0)).alias(f"limb{i}") for i in range(LIMBS)]


def normalised() -> Column:
    """Limb sums limb0..limb3 carried and written as 32 hexadecimal digits."""
    carry, out = F.lit(0).cast("long"), []
    for i in reversed(range(LIMBS)):
        total = F.col(f"limb{i}") + carry
        out.append(F.lpad(F.lower(F.hex(F.pmod(total, F.lit(MOD)))), 8, "0"))
        carry = F.call_function("shiftright", total, F.lit(32))  # floors, so limbs below zero borrow
    return F.concat(*reversed(out))


def digest(rows: DataFrame, *by: str, row_hash: Column | None = None) -> DataFrame:
    """The digest of each group of rows (entity, entity_id, row_version), by partial sums."""
    hashed = rows.withColumn("__hash", md5_row_hash() if row_hash is None else row_hash)
    return hashed.groupBy(*by).agg(F.count("*").alias("rows"), *limbs(F.col("__hash"))).select(*by, "rows", normalised().alias("digest"))


def from_hex(text: Column) -> list[Column]:
    """Limbs limb0..limb3 of a digest that is written as 32 hexadecimal digits; null if it is not."""
    good = F.when(text.rlike("^[0-9a-f]{32}$"), text)
    return [F.conv(F.substring(good, 8 * i + 1, 8), 16, 10).cast("long").alias(f"limb{i}") for i in range(LIMBS)]
