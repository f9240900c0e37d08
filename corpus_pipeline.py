"""Corpus pipeline: the stages in order, each over all that its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet in the shared
folder and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``, with ``n_chars`` following the text.  Toxicity and decontamination decide by
doc_id; the near-duplicate stage also tells rows of one doc_id, or of none, apart by their text.
Other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm import decontam, jaccard_join, line_dedup, toxicity
from proselens.llm import queries as Q
from proselens.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts to be toxic go."""
    bad = toxicity.toxicity(docs, read(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(bad, "doc_id", "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated multi-line chunks are cut out; every document stays, with what is left of it."""
    cut = line_dedup.line_dedup(docs, carry=("lang", "source", "n_chars"))
    # no filter on what the operator computes: it would be pushed below and evaluate the chunks again
    length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return cut.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays.

    Rows that share a doc_id, or have none, are told apart by their text: they get numbers after all others for this
    stage, so that only true copies of them go.
    """
    odd = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_odd")))
    rows = docs.select(*COLUMNS, F.col("doc_id").alias("_row"))
    if odd.head(1):
        told = docs.join(odd, docs["doc_id"].eqNullSafe(odd["_odd"]), "left_semi").groupBy("doc_id", F.sha2(Q.text_of(), 256).alias("_text"))
        top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
        numbers = stored(told.agg(F.count(F.lit(1)).alias("_n")).select(
            F.col("doc_id").alias("_odd"), "_text", (F.monotonically_increasing_id() + F.lit(top)).alias("_number")))
        same = rows["doc_id"].eqNullSafe(numbers["_odd"]) & (F.sha2(Q.text_of(), 256) == numbers["_text"])
        rows = rows.join(numbers, same, "left").withColumn("_row", F.coalesce("_number", "_row")).select(*COLUMNS, "_row").dropDuplicates(["_row"])
    found = jaccard_join.jaccard_join(rows, id_col="_row")
    stay = found.where("doc_id = class_id").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(stay, "_row", "left_semi").select(*COLUMNS)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bad = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(bad, "doc_id", "left_anti").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return Q.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", not_leaked),
    ("byte-level BPE", encoding),
]

#: the networks and the tokenizer are not SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
