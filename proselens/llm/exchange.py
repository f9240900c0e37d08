"""Asking all of a corpus about keys of a batch of documents, and getting the answers back packed.

Documents are dealt to batches by a hash of their identifier.  A batch sends each key once,
packed by key range ("bucket"); a bucket sees every batch's keys, so it can count or compare them
over the whole corpus; its answer to a batch has one value for each key sent, in the same
order (keys are sorted, so the order does not depend on the order of rows).  A key that a third
of all documents hold is sent at most once a batch, and no row is made for each key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, tasks

#: documents and text bytes of a batch, on average
BATCH, BATCH_BYTES = 1500, 6 << 20
#: text bytes of a corpus for each bucket, beyond as many buckets as there are shuffle partitions
BUCKET_BYTES = 32 << 20


def batched(rows: DataFrame, *by: str, text: str = "_text") -> tuple[DataFrame, int]:
    """Adds ``_batch`` by a hash of the columns ``by`` and deals the rows by it; also the number of buckets to ask.

    Batches follow the rows and the bytes of the texts, so that long texts do not make them larger; one text stays whole.
    """
    parts = tasks(rows.sparkSession)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("bytes")).first()
    n = max(parts, math.ceil(size["n"] / BATCH), math.ceil(size["bytes"] / BATCH_BYTES))
    dealt = rows.withColumn("_batch", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")).repartition(parts, "_batch")
    return dealt, max(parts, math.ceil(size["bytes"] / BUCKET_BYTES))


def kept_by_batch(dealt: DataFrame) -> DataFrame:
    """The dealt rows, written once as a table bucketed by ``_batch`` in the shared folder.

    Steps that group by ``_batch`` read it as it lies, without another exchange of the texts.  The catalog holds only its name.
    """
    spark = dealt.sparkSession
    name = f"proselens_{uuid.uuid4().hex}"
    dealt.write.format("parquet").bucketBy(tasks(spark), "_batch").option("path", shared_dir(spark)).saveAsTable(name)
    return spark.table(name)


def cut(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted unsigned 64-bit keys begins (buckets + 1 places)."""
    width = (1 << 64) // buckets + 1
    edges = np.array([min(width * b, (1 << 64) - 1) for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]))


def pack(batch: int, kind: int, keys: np.ndarray, values: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """Rows ``_bucket, _batch, _kind, _n`` and one binary column for each of ``values``, without empty buckets."""
    at = cut(keys, buckets)
    used = np.flatnonzero(np.diff(at))
    columns = {"_bucket": pa.array(used, pa.int32()), "_batch": pa.array(np.full(len(used), batch), pa.int32()),
               "_kind": pa.array(np.full(len(used), kind), pa.int32()), "_n": pa.array(np.diff(at)[used], pa.int32())}
    for name, v in values.items():
        columns[name] = pa.array([v[at[b]:at[b + 1]].tobytes() for b in used], pa.binary())
    return pa.table(columns)


def unpack(column: pa.ChunkedArray, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def ask(sent: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies ``answer`` to all rows of each bucket."""
    return sent.groupBy("_bucket").applyInArrow(answer, schema)
