"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # groups of the array aggregates are sentences or documents: keep them hashed instead of sorting all rows
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def get_session(master: str | None = None, app: str = "proselens",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session; on a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: every task runs in the driver JVM
            b = b.config("spark.driver.memory", os.environ.get("PROSELENS_DRIVER_MEMORY", "8g"))
            # many sort / hash consumers share one task in the matrix join stage
            b = b.config("spark.buffer.pageSize", "2m")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Unset, a local session gets a private scratch folder; on any other master it is an
    error, because executors on other machines could not read such a folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="proselens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def new_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder that no other run uses."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "proselens", uuid.uuid4().hex, *parts])


def stored(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and read it back (cuts lineage, survives lost executors)."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
