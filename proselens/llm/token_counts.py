"""Token counts through a digest cache.

1. A text's key is the SHA-256 of its content (null counts as empty; nothing else is changed, because
   any other change could change the count).  The thin rows (doc_id, key, bytes) are written once.
2. The distinct keys are joined to the cache of this tokenizer version: a Parquet table of (key, count)
   in a folder named by a digest of the model file, the library and its version.
3. Of each key that the cache lacks one text is encoded, where it lies.
4. The new counts are appended to the cache, and every row looks its key up.

Rows of a key that very many rows hold take its count from a broadcast of such keys, of which there
are at most four a shuffle partition; the other keys are joined by an exchange of thin rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_KEYS, shared_dir, stored, tasks, text_of

#: characters after which a longer text is cut, at a place that cannot change its tokens
CUT_CHARS = 1 << 20
#: a single space between ASCII letters or digits
SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")

CACHE_SCHEMA = "_key binary, n_tokens long"


class PieceCounter:
    """Counts the pieces that the sentencepiece library gives for a text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        # the mark of a space only begins pieces, and each text begins with one: parts count as the whole does
        self.cuttable = all("▁" not in p.lstrip("▁") for p in pieces) and \
            "".join(sp.encode("a", out_type=str)) == "▁a"

    def parts(self, text: str) -> list[str]:
        out, lo = [], 0
        while self.cuttable and len(text) - lo > CUT_CHARS:
            cut = SAFE.search(text, lo + CUT_CHARS)
            if cut is None:
                break
            out.append(text[lo:cut.start()])
            lo = cut.end()
        return out + [text[lo:]]

    def __call__(self, texts: list[str]) -> list[int]:
        found = [self.parts(t) for t in texts]
        sizes = iter([len(x) for x in self.encode([p for parts in found for p in parts], num_threads=1)])
        return [sum(next(sizes) for _ in parts) for parts in found]


def piece_counter(path: str) -> tuple[Callable[[], Callable[[list[str]], list[int]]], str]:
    """What tasks call to get a counter for the model at ``path`` (read here, sent by value), and its version digest."""
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    version = hashlib.sha256(b"sentencepiece " + sentencepiece.__version__.encode() + b"\0" + model).hexdigest()
    return lambda: PieceCounter(model), version


def _encoded(counter):
    def run(batches):
        count = counter()
        for batch in batches:
            texts = batch.column(1)
            n = np.zeros(len(texts), np.int64)
            for lo, hi in K.slices(texts):
                n[lo:hi] = count(texts.slice(lo, hi - lo).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["_key", "n_tokens"])

    return run


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache, one row a key (runs at the same time may have appended the same key twice)."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:  # nothing was appended yet
        return spark.createDataFrame([], CACHE_SCHEMA)
    return rows.groupBy("_key").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, counter: Callable, version: str, cache: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens``.

    ``counter`` gives, in a task, a function from texts to counts; ``version`` names all that its counts depend on;
    ``cache`` is a folder that all executors share (none: an own, empty one in the shared folder).  Counts of other
    versions are never used.  A null text counts as empty; repeated rows and rows without doc_id each give a row;
    other columns are ignored; an empty table gives an empty result and appends nothing.
    """
    spark = docs.sparkSession
    path = f"{(cache or shared_dir(spark)).rstrip('/')}/version={version}"
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_key", F.unhex(F.sha2("_text", 256)))
    thin = stored(rows.select("_id", "_key", F.octet_length("_text").cast("long").alias("n_bytes")))
    total = thin.count()

    keys = thin.groupBy("_key").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    keys = stored(keys.join(cached(spark, path), "_key", "left"))
    misses = keys.where("n_tokens is null").select("_key", F.col("_first").alias("_id"))
    new = misses.count()
    if new:
        same = lambda other: (F.col("t._key") == F.col(f"{other}._key")) & F.col("t._id").eqNullSafe(F.col(f"{other}._id"))
        if 2 * new <= total:
            some, how = misses, "left_semi"
        else:  # most rows are encoded: the others are fewer to name
            some, how = stored(thin.alias("t").join(misses.alias("m"), same("m"), "left_anti").select("_key", "_id").distinct()), "left_anti"
        few = min(new, total - new) <= BROADCAST_KEYS
        chosen = rows.alias("t").join((F.broadcast(some) if few else some).alias("s"), same("s"), how).select("_key", "_text")
        counted = chosen.mapInArrow(_encoded(counter), CACHE_SCHEMA)  # rows of one text and one doc_id are told apart by nothing
        counted.groupBy("_key").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(path)

    found = stored(keys.select("_key", "_rows").join(cached(spark, path), "_key"))
    hot = F.col("_rows") > max(16, total // (4 * tasks(spark)))
    often = F.broadcast(found.where(hot).select("_key", "n_tokens"))
    out = ["_id", "n_bytes", "n_tokens"]
    common = thin.join(often, "_key").select(*out)
    rest = thin.join(often, "_key", "left_anti").join(found.where(~hot), "_key").select(*out)
    return common.unionByName(rest).withColumnRenamed("_id", "doc_id")
