"""What the corpus operators share: session settings, written tables and a global row number."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that go to a Python worker at once. They bound a worker's memory, not the result.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder set in the session.

    Where neither is set, a local master gets a temporary folder, and a cluster an error: its machines share none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table written to the shared folder, which outlives executors.

    The table is columnar and compressed, unlike a checkpoint of rows. `discard` deletes it, or the end of the session's JVM.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours; nothing may read it any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._written)


def batched(df: DataFrame) -> DataFrame:
    """df, with the bounds on what an Arrow batch holds set in its session."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def parts(spark: SparkSession) -> int:
    """The session's shuffle partitions: how many ways operators deal out their own keys."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sampled(df: DataFrame, rows: int, of: int, *key: str) -> DataFrame:
    """About `rows` of a frame of `of` rows, with the hash of the key columns as __h, by which they are chosen.

    The hash is compared with a limit, so nothing is sorted or gathered.
    """
    df = df.withColumn("__h", F.xxhash64(*key))
    if of <= rows:
        return df
    return df.where(F.col("__h") <= -(1 << 63) + (rows << 64) // of)


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df in the given order with each row's number from 0 in the column `name`.

    The range sort deals rows out by all order columns, so a value that a third of the rows
    share still spreads if a later order column tells them apart. The sorted rows are
    written, since a second run of the sort could cut its ranges elsewhere; callers pass narrow rows.
    """
    n = parts(df.sparkSession)
    local = cut(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    chunk, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(chunk.alias("__chunk")).count().collect()  # a row for each partition
    start, starts = 0, []
    for chunk_no, size in sorted((r["__chunk"], r["count"]) for r in sizes):
        starts += [F.lit(chunk_no), F.lit(start)]
        start += size
    base = F.element_at(F.create_map(*starts), chunk) if starts else F.lit(0)
    return local.withColumn(name, (base + row).cast("long")).drop("__at")
