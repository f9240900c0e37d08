"""Exact dedup: tree-merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to as many runs as the session has shuffle partitions.  A run is
a sorted list of (digest, best identifier, count) with one row per digest.  In
each round ``fan_in`` runs meet and are merged: the exchange goes by (merged run,
digest), so that a merged run is spread over all tasks by digest while no key
ever has more than ``fan_in`` rows, however many copies a text has.  The window
over (run, digest, identifier) is the multiway merge of sorted rows; it keeps the
best identifier of each digest and adds the counts.

The first tree moves digests only and finds those that repeat.  The second runs
over the rows of repeated digests with the text itself as part of the key, so at
every level rows are merged only where their bytes are equal.  The winners then
go back down to the leaf runs, again at most ``runs`` rows a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_keys, rounds, stored, tasks, text_of


def _leaf_runs(rows: DataFrame, keys: list[str], best) -> DataFrame:
    return rows.groupBy("_run", *keys).agg(best("_id").alias("_best"), F.count(F.lit(1)).alias("_n"))


def _merge(runs: DataFrame, keys: list[str], fan_in: int, smallest: bool) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs become one sorted run."""
    merged = runs.withColumn("_run", F.floor(F.col("_run") / F.lit(fan_in)).cast("int"))
    group = Window.partitionBy("_run", *keys)
    order = F.col("_best").asc_nulls_last() if smallest else F.col("_best").desc_nulls_last()
    ranked = merged.withColumn("_rank", F.row_number().over(group.orderBy(order))) \
        .withColumn("_n", F.sum("_n").over(group.orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.where("_rank = 1").drop("_rank")


def _tree(leaves: DataFrame, keys: list[str], n_runs: int, fan_in: int, smallest: bool) -> DataFrame:
    top = leaves
    for _ in range(rounds(n_runs, fan_in)):
        top = _merge(top, keys, fan_in, smallest)
    return top


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                fan_in: int = 16, runs: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; a null text counts as empty.  ``keep`` says which
    identifier of a group stays, ``smallest`` or ``largest``.  A null identifier never wins over
    another one; a group of null identifiers only has a null ``keep_id`` and all its rows stay.
    Rows that repeat the winning identifier all stay.  Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    smallest = keep == "smallest"
    best = F.min if smallest else F.max
    n_runs = runs or tasks(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).select(
        "_id", F.pmod(F.xxhash64("_id"), F.lit(n_runs)).cast("int").alias("_run"),
        F.sha2("_text", 256).alias("_digest"), "_text")

    # digests that repeat
    thin = rows.drop("_text")
    repeated = stored(_tree(_leaf_runs(thin, ["_digest"], best), ["_digest"], n_runs, fan_in, smallest)
                      .where("_n > 1").select("_digest"))

    # rows of those digests, merged by their bytes
    keys = ["_digest", "_text"]
    members = join_keys(rows, repeated, "_digest", "left_semi")
    leaves = _leaf_runs(members, keys, best)
    top = _tree(leaves, keys, n_runs, fan_in, smallest).select(
        *keys, F.col("_best").alias("_keep"), F.col("_n").alias("_size"))
    down = leaves.select("_run", *keys).join(top, keys)
    grouped = members.join(down, ["_run", *keys]).select("_id", "_digest", "_keep", "_size")

    alone = join_keys(thin, repeated, "_digest", "left_anti").select(
        "_id", "_digest", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"))
    return grouped.unionByName(alone).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("text_sha256"))

