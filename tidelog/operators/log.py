"""Reading the change log: cursor scans, pages, compaction, point in time, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import documents
from tidelog.functions.rules import compressed

KEY = ("entity", "entity_id")
CHANGE = ("seq", "scope", "entity", "entity_id", "op", "snapshot", "row_version", "schema_version")
MAX_ROWS = 500


def latest(log: DataFrame, *extra: str, keep: tuple[str, ...] = CHANGE) -> DataFrame:
    """The last change of each row: one partial and one final aggregate on the row's key."""
    rest = [c for c in keep if c not in (*KEY, *extra)]
    picked = log.groupBy(*extra, *KEY).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("last"))
    return picked.select(*extra, *KEY, *[F.col(f"last.{c}").alias(c) for c in rest])


def pull_scan(log: DataFrame, scope: str, cursor: int, watermark: int | Column, limit: int = MAX_ROWS) -> DataFrame:
    """Changes of a scope after a cursor and up to the watermark, one more than the limit."""
    rows = log.where((F.col("scope") == scope) & (F.col("seq") > cursor) & (F.col("seq") <= watermark))
    return rows.select(*CHANGE).orderBy("seq").limit(limit + 1)


def pull_page(log: DataFrame, scope: str, cursor: int, watermark: int | Column, limit: int) -> DataFrame:
    """At most `limit` changes, each with the page's next cursor and whether more lie beyond."""
    w = Window.orderBy("seq")  # over limit + 1 rows
    rows = pull_scan(log, scope, cursor, watermark, limit).withColumn("rn", F.row_number().over(w))
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("has_more", F.max("rn").over(every) > limit).where(F.col("rn") <= limit)
    return rows.withColumn("next_cursor", F.max("seq").over(every)).drop("rn")


def bootstrap(log: DataFrame, scope: str, after: int, watermark: int | Column, limit: int = MAX_ROWS) -> DataFrame:
    """The compacted log of a scope. A fresh start has no tombstones; a resumed one has.

    seq > after may go below the compaction (the latest change of a row is after the cursor or none is of
    interest); the tombstone rule may not, or older versions of deleted rows would come back.
    """
    rows = log.where((F.col("scope") == scope) & (F.col("seq") > after) & (F.col("seq") <= watermark))
    out = latest(rows).select(*CHANGE)
    if after == 0:
        out = out.where("op <> 'delete'")
    return out.orderBy("seq").limit(limit + 1)


def live_rows(log: DataFrame) -> DataFrame:
    keep = ("scope", "op", "row_version", "seq")
    return latest(log, keep=keep).where("op = 'upsert'").select("scope", *KEY, "row_version", "seq")


def rows_at(devices: DataFrame, log: DataFrame) -> DataFrame:
    """What each device holds at its cursor: the last change of each row up to it, tombstones left out.

    Cursors stand among the changes of each row of their scope, and the last change before a cursor is carried forward to it:
    the work is that of the log and of the result, not of devices by changes.
    """
    keys = log.select("scope", *KEY).distinct()
    marks = devices.select("device_id", "scope", F.col("cursor_seq").alias("seq")).join(keys, "scope")
    changes = log.select("scope", *KEY, "seq", F.struct("op", "row_version").alias("change"))
    both = changes.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("scope", *KEY).orderBy("seq", F.col("device_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("last", F.last("change", ignorenulls=True).over(w))
    return rows.where("device_id is not null and last.op = 'upsert'").select("device_id", "scope", *KEY, F.col("last.row_version").alias("row_version"))


def scope_heads(log: DataFrame) -> DataFrame:
    return log.groupBy("scope").agg(F.max("seq").alias("head"))


def visible_head(log: DataFrame, inflight: DataFrame) -> DataFrame:
    """The end of each scope's committed prefix: before its first change in flight."""
    holes = log.select("scope", "seq").join(inflight.select("seq"), "seq").groupBy("scope").agg(F.min("seq").alias("hole"))
    heads = log.select("scope", "seq").join(holes, "scope", "left")
    visible = F.max(F.when(F.col("hole").isNull() | (F.col("seq") < F.col("hole")), F.col("seq")))
    return heads.groupBy("scope").agg(F.coalesce(visible, F.lit(0)).alias("visible_head"))


def watermark(log: DataFrame, inflight: DataFrame) -> DataFrame:
    """One row: the greatest sequence number with no change in flight at or below it."""
    top = log.agg(F.max("seq").alias("top"))
    low = inflight.agg(F.min("seq").alias("low"))
    return top.join(low).select(F.least(F.col("top"), F.col("low") - 1).alias("watermark"))


def watermark_polls(polls: DataFrame, inflight: DataFrame) -> DataFrame:
    """polls (poll, allocated, oldest_open): what each poll establishes, and what is recorded, which never falls.

    A poll is not compared with each change in flight: changes and the polls' lower bounds stand in one order, in which the next
    change after a bound is carried back to it.
    """
    marks = polls.select("poll", "allocated", (F.col("oldest_open") + 1).alias("at")).unionByName(inflight.select(F.col("seq").alias("at"), "seq"), allowMissingColumns=True)
    ahead = Window.orderBy("at", F.col("poll").isNull()).rowsBetween(0, Window.unboundedFollowing)  # a poll for each cycle and the changes in flight: both are few
    found = marks.withColumn("next", F.first("seq", ignorenulls=True).over(ahead)).where("poll is not null")
    established = F.when(F.col("next") <= F.col("allocated"), F.col("next") - 1).otherwise(F.col("allocated"))
    found = found.select("poll", established.alias("established"))
    recorded = F.max("established").over(Window.orderBy("poll").rowsBetween(Window.unboundedPreceding, 0))
    return found.select("poll", "established", recorded.alias("recorded"))


def _quoted(c: str) -> Column:
    """A name as a JSON string; the names' rules leave only two characters to escape."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def change_text() -> Column:
    """A change's canonical form: sorted keys, no blanks, the snapshot canonical as well and left out of a delete."""
    snapshot = F.when(F.col("snapshot").isNotNull(), F.concat(F.lit(',"snapshot":'), documents.canonical_json("snapshot"))).otherwise(F.lit(""))
    parts = ['{"entity":', _quoted("entity"), ',"entity_id":', _quoted("entity_id"), ',"op":', _quoted("op"), ',"row_version":', F.col("row_version").cast("string"), ',"schema_version":', F.col("schema_version").cast("string"), ',"seq":', F.col("seq").cast("string"), snapshot, "}"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def change_bytes() -> Column:
    """Bytes of a change's canonical form."""
    return F.octet_length(change_text()).cast("long")


#: Sequence numbers in a range of running totals.
RANGE = 1 << 16


def running(rows: DataFrame, by: str, order: str, **values: Column) -> DataFrame:
    """rows with the running sums of values in order of a whole number, for each group of `by`.

    Sums are taken within ranges of the order first, and the totals of the ranges before are added: a group's rows are
    spread over as many tasks as it has ranges.
    """
    rows = rows.withColumns({f"__{k}": v for k, v in values.items()}).withColumn("__range", F.expr(f"`{order}` div {RANGE}"))
    totals = rows.groupBy(by, "__range").agg(*[F.sum(f"__{k}").alias(f"__all_{k}") for k in values])
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "__range", *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__all_{k}") for k in values])
    within = Window.partitionBy(by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(totals, [by, "__range"]).withColumns({k: F.col(f"__all_{k}") + F.sum(f"__{k}").over(within) for k in values})
    return out.drop("__range", *[f"__{k}" for k in values], *[f"__all_{k}" for k in values])


def byte_budget_page(log: DataFrame, budget: int) -> DataFrame:
    """The first page of each scope: the longest prefix whose canonical array is within the compressed budget, one change at least."""
    rows = log.select("scope", "seq", change_bytes().alias("bytes"))
    rows = running(rows, "scope", "seq", size=F.col("bytes") + 1, rn=F.lit(1).cast("long"))
    heads = scope_heads(log)
    chosen = rows.where((F.col("rn") == 1) | (compressed(F.col("size") + 1) <= budget))
    out = chosen.groupBy("scope").agg(F.count("*").alias("changes"), F.max("seq").alias("next_cursor"), (F.max("size") + 1).alias("bytes"))
    return out.join(heads, "scope").select("scope", "changes", "next_cursor", "bytes", (F.col("next_cursor") < F.col("head")).alias("has_more"))


def catch_up_walk(log: DataFrame, budget: int) -> DataFrame:
    """All pages that a device reads from each scope's start: each restarts the budget where the last ended.

    A page's start depends on the page before, so a scope is walked in order, by a stream of its sorted rows
    that holds one page's totals and no rows.
    """
    rows = log.select("scope", "seq", change_bytes().alias("bytes"))

    def walk(batches):
        import pandas as pd

        scope, page, first, last, n, size = None, 0, 0, 0, 0, 1
        for pdf in batches:
            out = []
            for s, seq, b in zip(pdf["scope"], pdf["seq"], pdf["bytes"], strict=True):
                if s != scope or (n and -(-(size + b + 1) // 3) > budget):
                    if n:
                        out.append((scope, page, first, last, n, size))
                    page, scope, first, n, size = (page + 1 if s == scope else 0), s, seq, 0, 1
                last, n, size = seq, n + 1, size + int(b) + 1
            yield pd.DataFrame(out, columns=["scope", "page", "first_seq", "next_cursor", "changes", "bytes"])
        if n:
            yield pd.DataFrame([(scope, page, first, last, n, size)], columns=["scope", "page", "first_seq", "next_cursor", "changes", "bytes"])

    schema = "scope string, page long, first_seq long, next_cursor long, changes long, bytes long"
    return rows.repartition("scope").sortWithinPartitions("scope", "seq").mapInPandas(walk, schema)
