"""Corpus sources: documents, labels, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

# Test split rule [pin]: a document belongs to the test split when doc_id % 5 == 0.
TEST_MODULUS = 5
#: parts for each split of a large input, and the number up to which splits are divided
PARTS, MOST_PARTS = 8, 2000


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-partition a scan by ``key``: one exchange of the text.

    Every per-document aggregate and join then finds its rows in place, and none of the far more numerous
    tokens is exchanged for them.  A small file arrives as one split and gives every core work; a large input is dealt
    into more parts than it has splits, so that a task's groups fit in its memory.
    """
    par, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(par if splits < par else max(splits, min(PARTS * splits, MOST_PARTS)), key)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, text`` of every document (column pruning reaches the scan)."""
    return spread(spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "lang", "text"))


def with_split(df: DataFrame) -> DataFrame:
    """Attach ``split`` (``train`` / ``test``) by the pinned modulus rule."""
    return df.withColumn("split", F.when(F.col("doc_id") % TEST_MODULUS == 0, "test").otherwise("train"))


def scan_corpus_split(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Labelled documents of one split: ``doc_id, text, label, split``."""
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    labels = spark.read.parquet(table_path(sf_dir, "labels")).select("doc_id", F.col("quality").cast("int").alias("label"))
    return with_split(docs.join(labels, "doc_id")).where(F.col("split") == split)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label`` (``quality`` as the class) with ``split``."""
    lab = spark.read.parquet(table_path(sf_dir, "labels")).select("doc_id", F.col("quality").cast("int").alias("label"))
    return with_split(lab)
