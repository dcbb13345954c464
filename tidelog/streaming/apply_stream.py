"""A change log applied as a stream, and keyed state machines on streams.

Delivery follows commits, not event time: a change at or below the commit watermark is never
late and one above it waits for a later batch. Each micro-batch is folded into a new version of the store: rows, cursors and
what is withheld move together, and a batch that is run again finds its version and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.apply import apply_batch, health_step
from tidelog.sources.store import Store

ROWS = "scope string, entity string, entity_id string, row_version long"
CURSORS = "scope string, cursor long"
CHANGES = "seq long, scope string, entity string, entity_id string, op string, snapshot string, row_version long, schema_version int"


def published(spark: SparkSession, path: str, table: str = "rows") -> DataFrame:
    """A table of the state that the last batch left: rows, cursors or withheld; before the first batch it is empty."""
    return Store(spark, path).read(table, {"rows": ROWS, "cursors": CURSORS, "withheld": CHANGES}[table])


def up_to_watermark(changes: DataFrame, watermark: int) -> tuple[DataFrame, DataFrame]:
    """What is delivered now, and what is withheld until a later watermark."""
    return changes.where(F.col("seq") <= watermark), changes.where(F.col("seq") > watermark)


def fold(batch: DataFrame, path: str, tag: str, watermark: int | None) -> None:
    """One micro-batch: what it and earlier ones brought up to the watermark is applied and published with the cursors.

    tag names the batch; the version that the latest marker gives to the same tag is left as it is.
    """
    spark = batch.sparkSession
    store = Store(spark, path)
    last = store.latest()
    if last is not None and store.marker(last)["tag"] == tag:
        return
    columns = [c.split()[0] for c in CHANGES.split(", ")]
    waiting = store.read("withheld", CHANGES).unionByName(batch.select(*columns))
    ready, withheld = up_to_watermark(waiting, watermark) if watermark is not None else (waiting, waiting.limit(0))
    moved = ready.groupBy("scope").agg(F.max("seq").alias("seq"))
    cursors = store.read("cursors", CURSORS).join(moved, "scope", "full").select("scope", F.greatest("cursor", "seq").alias("cursor"))
    store.publish({"rows": apply_batch(ready, store.read("rows", ROWS)), "cursors": cursors, "withheld": withheld}, last, tag)
    store.vacuum(keep=2)


def apply_stream(changes: DataFrame, path: str, checkpoint: str, watermark: Callable[[], int | None] | None = None) -> StreamingQuery:
    """Applies a streaming change log to versions of live rows under path, up to the watermark that is polled before each batch.

    Changes of a row in one batch may be in any order, and repeat; a row's order is seq, which within a row rises from batch to batch.
    A new checkpoint over an old state goes on from that state.
    """

    def each(batch: DataFrame, number: int) -> None:
        fold(batch, path, f"{checkpoint}#{number}", watermark() if watermark else None)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(log: DataFrame, path: str, steps: int, order: str = "seq") -> None:
    """The log as `steps` appends of equal ranges of its order, one after the other: a file stream takes files by their times."""
    low, high = log.agg(F.min(order), F.max(order)).first()
    if low is None:
        return
    for i in range(steps):
        first, last = low + (high + 1 - low) * i // steps, low + (high + 1 - low) * (i + 1) // steps
        rows = log.where((F.col(order) >= first) & (F.col(order) < last))
        rows.repartitionByRange(1, order).sortWithinPartitions(order).write.mode("append").parquet(path)


def health_stream(observations: DataFrame) -> DataFrame:
    """(device_id, scope, step, state, attempts) after each observation of a stream, with a state for each device and scope.

    Observations of a device come in order from batch to batch; within one they are put in order of step.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, attempts = held.get if held.exists else ("healthy", 0)
        rows, out = pd.concat(list(parts)).sort_values("step"), []
        for step, diverged, rebuilding, compared in zip(rows["step"], rows["diverged"], rows["rebuilding"], rows["compared"], strict=True):
            state, attempts = health_step(state, attempts, diverged, rebuilding, compared)
            out.append((*key, step, state, attempts))
        held.update((state, attempts))
        yield pd.DataFrame(out, columns=["device_id", "scope", "step", "state", "attempts"])

    schema = "device_id int, scope string, step long, state string, attempts long"
    return observations.groupBy("device_id", "scope").applyInPandasWithState(run, schema, "state string, attempts long", "append", "NoTimeout")


def dedupe_stream(submissions: DataFrame) -> DataFrame:
    """(id, attempt, decision) of each submission (id, attempt, payload_checksum) of a stream: the first of an id is fresh, later ones a replay or mutated.

    A first submission may come any time before a repetition, so a checksum is kept for each id without an end.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows, out = pd.concat(list(parts)).sort_values("attempt"), []
        first = held.get[0] if held.exists else None
        for attempt, checksum in zip(rows["attempt"], rows["payload_checksum"], strict=True):
            out.append((key[0], attempt, "fresh" if first is None else "replay" if checksum == first else "mutated"))
            first = checksum if first is None else first
        held.update((first,))
        yield pd.DataFrame(out, columns=["id", "attempt", "decision"])

    return submissions.groupBy("id").applyInPandasWithState(run, "id string, attempt int, decision string", "checksum string", "append", "NoTimeout")
