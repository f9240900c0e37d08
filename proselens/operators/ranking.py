"""Exact positions without a one-task window: range sort, stored once, plus per-partition offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def ranked(df: DataFrame, order: list[Column], out: str = "rank", by: str | None = None) -> DataFrame:
    """Adds the 0-based position of each row in ``order`` (within its class ``by``, if given).

    Rows are range-partitioned by (class, order) and sorted, so a class lies in neighbouring partitions
    and a partition may hold the end of one class and the start of the next.  The sorted rows are
    written once: a second evaluation could sample other range borders.  The offsets table has one row
    for each partition and class present in it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = ([F.col(by).asc()] if by else []) + order
    name = "_class"
    rows = df.withColumn(name, F.col(by) if by else F.lit(0))
    placed = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                    .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    found = sorted(placed.groupBy(name, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect(),
                   key=lambda r: ((r[name] is not None, r[name]), r["_part"]))
    offsets, before, last = [], 0, object()
    for r in found:
        if r[name] != last:
            before, last = 0, r[name]
        offsets.append((r[name], r["_part"], before - r["first"]))
        before += r["n"]
    kind = dict(placed.dtypes)[name]
    table = spark.createDataFrame(offsets, f"_class2 {kind}, _part2 int, _shift long")
    joined = placed.join(F.broadcast(table), placed[name].eqNullSafe(table["_class2"]) & (placed["_part"] == table["_part2"]))
    return joined.withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")) \
        .drop(name, "_part", "_at", "_class2", "_part2", "_shift")
