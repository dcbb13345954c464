"""Counts over logs, devices and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.log import scope_heads

# The faults of the trace.
FAULTS = (
    "dropped", "duplicated", "reordered", "severed", "malformed", "flap", "storage-failed", "storage-committed-then-killed",
    "server-restarted", "device-restarted", "overloaded", "storage-lied-about-commit", "protocol-violation", "slow-commit",
)


def scope_lag(devices: DataFrame, log: DataFrame) -> DataFrame:
    """Each scope's head, its slowest cursor and the distance."""
    slow = devices.groupBy("scope").agg(F.min("cursor_seq").alias("slowest"), F.count_distinct("device_id").alias("devices"))
    return slow.join(scope_heads(log), "scope").withColumn("lag", F.col("head") - F.col("slowest"))


def fault_coverage(trace: DataFrame) -> DataFrame:
    """How often each fault came, those that never came with 0."""
    menu = trace.sparkSession.createDataFrame([(f,) for f in FAULTS], "fault string")
    return menu.join(trace.groupBy("fault").agg(F.count("*").alias("n")), "fault", "left").select("fault", F.coalesce("n", F.lit(0)).alias("n"))


def lowest_failing_seed(runs: DataFrame) -> DataFrame:
    """Of runs (invariant, seed, detail) that failed the lowest seed of each invariant, with its detail."""
    return runs.groupBy("invariant").agg(F.min("seed").alias("seed"), F.min_by("detail", "seed").alias("detail"))


def every_nth(index: Column, nth: Column) -> Column:
    """Whether a request is the nth of a row of requests; 0 is never."""
    return (nth > 0) & (F.pmod(index, F.greatest(nth, F.lit(1))) == 0)


def response_fault(index: Column, nth: Column, malformed: Column, severed: Column, duplicated: Column, reordered: Column) -> Column:
    """What happens to a response, of all faults that were drawn for it: a dropped one can't also be doubled, and so on in this order."""
    return F.when(every_nth(index, nth), "dropped").when(malformed, "malformed").when(severed, "severed").when(duplicated, "duplicated").when(reordered, "reordered")


def storage_fault(fails: Column, killed: Column, lies: Column) -> Column:
    """What happens to a transaction, of all faults that were drawn for it."""
    return F.when(fails, "storage-failed").when(killed, "storage-committed-then-killed").when(lies, "storage-lied-about-commit")
