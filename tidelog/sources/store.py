"""Tables that change together: each version is a whole set of tables that one marker file publishes.

A writer puts its tables into a folder of its own and then creates the marker of the next version. The marker is created only if it
does not exist, so of two writers one wins and a reader sees all of a version or nothing of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.log import running


class Conflict(RuntimeError):
    """Another writer has published the version that was to be published."""


class Store:
    """Versions of named tables under a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions in order."""
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def marker(self, version: int) -> dict:
        """What a version's marker says: its folder, its tables and the writer's tag."""
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._at(f"{self.path}/versions/{version:010d}"))
        try:
            return json.loads(lines.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """A table of a version, by default the latest; empty if there is none or the version has no such table."""
        version = self.latest() if version is None else version
        found = self.marker(version) if version is not None else {"tables": []}
        if table not in found["tables"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{found['folder']}/{table}")

    def publish(self, tables: dict[str, DataFrame], after: int | None, tag: str = "") -> int:
        """Writes all tables and publishes them as the version after `after` (None: the first). Conflict if that exists."""
        version = 0 if after is None else after + 1
        folder = f"data-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        marker = self._at(f"{self.path}/versions/{version:010d}")
        try:
            stream = self._fs.create(marker, False)
        except Exception as e:
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)
            raise Conflict(f"version {version} exists") from e
        stream.write(bytearray(json.dumps({"folder": folder, "tables": sorted(tables), "tag": tag}).encode()))
        stream.close()
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last `keep` versions; readers of older ones fail."""
        for version in self.versions()[:-keep]:
            self._fs.delete(self._at(f"{self.path}/{self.marker(version)['folder']}"), True)
            self._fs.delete(self._at(f"{self.path}/versions/{version:010d}"), False)


def write_log(log: DataFrame, path: str) -> None:
    """The log as Parquet, a folder for each scope, files in order of seq: scope filters skip folders, seq filters row groups.

    Rows are dealt out by ranges of scope and seq, so a scope of any size takes as many tasks as it fills.
    """
    log.repartitionByRange("scope", "seq").sortWithinPartitions("scope", "seq").write.mode("append").partitionBy("scope").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("inferSchema", "false").parquet(path)


def sequenced(changes: DataFrame, head: int, order: str = "position") -> DataFrame:
    """changes with seq: the numbers after head, gapless, in order of a whole number."""
    rows = running(changes.withColumn("__all", F.lit(0)), "__all", order, __n=F.lit(1).cast("long"))
    return rows.withColumn("seq", F.col("__n") + head).drop("__all", "__n")


def insert_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new whose key it does not have; new has each key once."""
    return table.unionByName(new.join(table.select(key), key, "left_anti"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table after changes (its columns and deleted): a change replaces its key's row or, if deleted, takes it out."""
    kept = table.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where("not deleted").select(*table.columns))
