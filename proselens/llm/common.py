"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word of the contracts: bytes other than ASCII white space
WORD = r"[^\x20\x09-\x0D]+"

#: rows of a key table up to which it may be broadcast (40-byte keys: 40 MB); beyond it the join shuffles
BROADCAST_KEYS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder that ``spark.checkpoint.dir`` names.

    Unset, a local session gets a private scratch folder; any other master is an error,
    because executors on other machines could not read such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="proselens-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def rounds(runs: int, fan_in: int) -> int:
    return max(1, math.ceil(math.log(max(2, runs), fan_in) - 1e-9))


def bounded(stored_rows: DataFrame) -> DataFrame:
    """Stored thin rows, marked for broadcast only where their count is bounded."""
    return F.broadcast(stored_rows) if stored_rows.count() <= BROADCAST_KEYS else stored_rows


def join_keys(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join with stored, distinct ``keys``; broadcast only when their count is bounded."""
    return rows.join(bounded(keys), on, how)
