"""A training-data pipeline: each stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, hilbert, jaccard, langid, mixing
from tidelog.llm.queries import TARGET_WEIGHTS, language_model
from tidelog.llm.runtime import delete, new_folder, numbered

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that identification rejects (`und`: null text or no letter) go."""
    found = langid.identify(docs.select(*COLUMNS), language_model(docs))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. Wordless documents stay.

    A row is told by doc_id and text together, so rows that share a doc_id but not their text are documents of their own;
    of rows that share both one stays, whichever. Rows without a doc_id come after all others of their group.
    """
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text"))
    rows = docs.select(*COLUMNS, one.alias("one"))
    groups = jaccard.near_duplicates(rows, key="one")
    named = groups.where("component_id = one or n_shingles = 0").select("one").distinct()
    return rows.join(named, "one", "left_semi").dropDuplicates(["one"]).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the rows in the order of the mixture: the rows of the files in order are the training sequence."""
    rows = mixing.mix(docs.select(*COLUMNS), TARGET_WEIGHTS)
    return rows.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*COLUMNS)


def sequence(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with mix_position: each row's place from 0 in the order that the stage before wrote.

    The order is that of the files' names and of the rows in them, whatever way a reader splits the files.
    """
    crc = F.crc32(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "lang", F.octet_length("text").alias("bytes"), crc.alias("crc"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return numbered(rows, F.col("file"), F.col("row"), name="mix_position").drop("file", "row")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot, and its place in the mixture (mix_position).

    Shards follow the mixture: its runs are a dimension of the curve beside language and size, so a shard holds runs of the training sequence
    and a reader of one part of it skips the other files.
    """
    return hilbert.shard(sequence(docs), position="mix_position", size=F.col("bytes"), crc=F.col("crc")).select("doc_id", "size", "text_crc32", "shard", "slot", "mix_position")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Between stages tables are written to the shared folder.

    A stage's table is deleted once the next one's is written, the last one when the session's JVM ends.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = new_folder(spark)
            docs.write.parquet(folder)
            if last:
                delete(spark, last)
            docs, last = spark.read.parquet(folder), folder
    return docs


ORACLE_SQL = None
