"""Registered queries of the user hooks (U1 preprocessing, U2 analyzer, U3 encoder) with deterministic hooks, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hooks as H
from ..operators import metrics as M
from ..operators import models as ML
from ..session import table_path
from ..sources.corpus import read_documents
from . import oracle as O

ANALYZER_NAMES = ["chars", "spaces", "ends_in_stop", "absent"]
LETTERS = "aeiou"


def user_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family C descriptive metrics of texts without digits; the hook reaches every frame."""
    return M.c_descriptive(read_documents(spark, sf_dir), preprocess=lambda c: F.regexp_replace(c, "[0-9]", ""))


def analyzer():
    """A batch function as a user writes it; ``absent`` is never returned and becomes 0."""
    return lambda texts: [{"chars": len(t), "spaces": t.count(" "), "ends_in_stop": float(t.endswith(".")) if t else None} for t in texts]


def user_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the analyzer, called as a table function from SQL."""
    H.register_analyzer(spark, "proselens_analyze", analyzer, ANALYZER_NAMES)
    spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text").createOrReplaceTempView("proselens_documents")
    return spark.sql("SELECT * FROM proselens_analyze(TABLE(proselens_documents))")


def encoder():
    """Counts of the vowels, as a user's encoder returns them: one vector a text."""
    return lambda texts: [[t.count(x) for x in LETTERS] for t in texts]


def user_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a user's encoder, in Arrow batches."""
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return ML.embed_documents(docs, encoder=encoder)


QUERIES = {"user_preprocess": user_preprocess, "user_analyzer": user_analyzer, "user_encoder": user_encoder}

ORACLE = {
    "user_preprocess": O.q_c_descriptive().replace(
        "d AS (SELECT doc_id, lang, text FROM documents)",
        "d AS (SELECT doc_id, lang, regexp_replace(text, '[0-9]', '', 'g') AS text FROM documents)"),
    "user_analyzer": """SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS spaces,
coalesce(ends_with(text, '.'), FALSE)::INT::DOUBLE AS ends_in_stop, 0.0::DOUBLE AS absent FROM documents""",
    "user_encoder": "SELECT doc_id, [" + ", ".join(
        f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{x}', '')))::DOUBLE" for x in LETTERS) + "] AS embedding FROM documents",
}
