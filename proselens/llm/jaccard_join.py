"""N-gram Jaccard join: MinHash banding and exact verification.

Documents become sets of word shingles.  Equal sets form one copy class, found by a
digest of the set; all later work is on one representative a class.  A representative
has one key in each band ("tree"), which stands for ``depth`` MinHash values; two documents
meet when they share a key.  The depth is the same for all data: the greatest at which the
chance to meet in some band, at the threshold, reaches the target recall (``trie_depth``).
It stands in for an LSH forest; no prefix trees are built.

Documents that share a prefix are linked into candidate components by passing the
least label along (no pairs are made).  A component is cut into blocks; each pair of
blocks meets in one place, with the sets of its members, and all pairs there are
compared exactly by a product of sparse incidence columns.  Only the number of links of
each member and its least neighbour group leave that place, so no pair is emitted however
large a group of near copies is.  The near-duplicate classes are the components of the
verified links.

Lookups that a large copy class would skew go through (run, digest) keys, runs being a
hash of the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded, stored, tasks, text_of

TREES, MAX_DEPTH, TARGET_RECALL = 16, 8, 0.9995
#: members of a component that are compared with each other at a time
BLOCK = 192
#: columns of the incidence matrix at a time
COLUMNS = 8192


def trie_depth(threshold: float, trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix that still meets the target recall for pairs at the threshold."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of 1 to n-1 words is one shingle, without words none."""
    words, first = K.words_of(*K.text_buffer(column))
    grams = K.sequence_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(K.sequence_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, factors: np.ndarray, depth: int) -> list[int]:
    """One number for each tree, standing for its prefix of ``depth`` MinHash values."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, at:at + 4096] * factors[:, None]).min(axis=1))
    low = K.mix(low).reshape(-1, depth)
    key = np.arange(len(low), dtype=np.uint64)
    for d in range(depth):
        key = K.mix(key * np.uint64(K.BASE) + low[:, d])
    return key.view(np.int64).tolist()


def _describe(n: int, depth: int, trees: int):
    factors = K.mix(np.arange(1, trees * depth + 1, dtype=np.uint64)) | np.uint64(1)
    schema = pa.schema([("_id", pa.int64()), ("_digest", pa.binary()), ("_labels", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, labels = [], []
            for s in shingle_sets(b.column("_text"), n):
                digests.append(hashlib.sha256(s.tobytes()).digest() if len(s) else b"")
                labels.append(signature(s, factors, depth) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(digests, pa.binary()), pa.array(labels, pa.list_(pa.int64()))], schema=schema)

    return run


def components(groups: DataFrame) -> DataFrame:
    """``_node, _root``: least node of each component of the bipartite graph ``(_group, _node)``.

    Each round takes the least label of every group to its members, then follows the label of that
    label (halving long chains); it ends when nothing changes.
    """
    labels = stored(groups.groupBy("_node").agg(F.min("_node").alias("_root")))
    while True:
        least = groups.join(labels, "_node").groupBy("_group").agg(F.min("_root").alias("_root"))
        new = groups.join(least, "_group").groupBy("_node").agg(F.min("_root").alias("_new"))
        step = labels.join(new, "_node").select("_node", F.col("_root").alias("_old"), F.least("_root", "_new").alias("_root"))
        above = labels.select(F.col("_node").alias("_root"), F.col("_root").alias("_above"))
        labels = stored(step.join(above, "_root", "left").select(
            "_node", F.least("_root", F.coalesce("_above", "_root")).alias("_root"), "_old"))
        changed = labels.where("_root <> _old").limit(1).count()
        labels = labels.drop("_old")
        if not changed:
            return labels


def _sets(n: int):
    schema = pa.schema([("_rep", pa.int64()), ("_comp", pa.int64()), ("_blocks", pa.int32()), ("_block", pa.int32()),
                        ("_weight", pa.int64()), ("_set", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(b.column("_text"), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(f.name) if f.name != "_set" else sets for f in schema], schema=schema)

    return run


def link_counts(sets: list[np.ndarray], weights: np.ndarray, block: np.ndarray, i: int, j: int,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each member, and the first member of its group, over the pairs of blocks i and j."""
    size = np.array([len(s) for s in sets], np.int64)
    joined = np.concatenate(sets)
    values, column, often = np.unique(joined, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = often[column] > 1  # a shingle of one member only is in no intersection
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        common += dense[left] @ dense[right].T
    union = size[left][:, None] + size[right][None, :] - common
    linked = common >= threshold * union - 1e-6
    if i == j:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[left] += linked @ weights[right]
    if i != j:
        links[right] += linked.T @ weights[left]
    first = np.arange(len(sets))
    x, y = np.nonzero(linked)
    x, y = left[x], right[y]
    while len(x):  # least index along links until nothing changes
        new = first.copy()
        np.minimum.at(new, x, first[y])
        np.minimum.at(new, y, first[x])
        new = new[new]
        if (new == first).all():
            break
        first = new
    return links, first


def _verify(threshold: float):
    def compare(key: tuple, part: list[tuple]) -> pd.DataFrame:
        part = sorted({r[0]: r for r in part}.values())  # a repeated row counts in its class's weight
        rep = np.array([r[0] for r in part], np.int64)
        links, first = link_counts([np.frombuffer(r[3], np.uint64) for r in part],
                                   np.array([r[2] for r in part], np.int64),
                                   np.array([r[1] for r in part]), key[1], key[2], threshold)
        found = pd.DataFrame({"_node": rep, "_links": links, "_first": rep[first]})
        found["_place"] = f"{key[0]}/{key[1]}/{key[2]}"
        return found

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, done, rows = None, [], [], 0
        for b in batches:
            for comp, i, j, rep, block, weight, data in b.itertuples(index=False, name=None):
                if (comp, i, j) != key:
                    if part:
                        done.append(compare(key, part))
                        rows += len(part)
                    key, part = (comp, i, j), []
                    if rows > 20_000:
                        yield pd.concat(done)
                        done, rows = [], 0
                part.append((rep, block, weight, data))
        if part:
            done.append(compare(key, part))
        if done:
            yield pd.concat(done)

    return run


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text",
                 trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, copy_id, copies``.

    Words are separated by ASCII white space and taken as they are; a shingle is ``n`` of them in a row
    (a text of 1 to n-1 words is one shingle).  Two rows are linked when the Jaccard similarity of their
    shingle sets is ``threshold`` at least; ``n_links`` counts a row's links to other rows.  ``class_id`` is
    the least doc_id that the row reaches over links, ``copy_id`` the least one with an equal shingle set and
    ``copies`` the number of rows with that set.  A text without words (null and empty too) has no links and
    is its own class.  Rows that repeat a doc_id with an equal text are linked like other copies.  Rows
    without doc_id are left out.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    runs = tasks(spark)
    depth = trie_depth(threshold, trees, max_depth, target)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    described = stored(rows.mapInArrow(_describe(n, depth, trees), "_id long, _digest binary, _labels array<long>"))

    # copy classes
    filled = described.where(F.length("_digest") > 0).withColumn("_run", F.pmod(F.xxhash64("_id"), F.lit(runs)).cast("int"))
    leaves = filled.groupBy("_run", "_digest").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n"))
    classes = stored(leaves.groupBy("_digest").agg(F.min("_rep").alias("_rep"), F.sum("_n").alias("_n")))

    # the bands: groups of representatives that share a key
    reps = classes.join(filled.select(F.col("_id").alias("_rep"), "_digest", "_labels").dropDuplicates(["_rep", "_digest"]),
                        ["_rep", "_digest"])
    prefixes = reps.select(F.col("_rep").alias("_node"), F.explode("_labels").alias("_group"))
    shared = prefixes.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_group")
    comps = components(stored(prefixes.join(shared, "_group")))

    # exact comparison within components, block by block
    counts = comps.groupBy("_root").agg(F.count(F.lit(1)).alias("_n"))
    members = stored(
        comps.join(counts, "_root").select(
            F.col("_node").alias("_rep"), F.col("_root").alias("_comp"),
            F.ceil(F.col("_n") / F.lit(BLOCK)).cast("int").alias("_blocks"))
        .withColumn("_block", F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int"))
        .join(classes.select("_rep", F.col("_n").alias("_weight")), "_rep"))
    texts = rows.withColumnRenamed("_id", "_rep").join(bounded(members), "_rep")
    sets = texts.select("_rep", "_comp", "_blocks", "_block", "_weight", "_text").mapInArrow(
        _sets(n), "_rep long, _comp long, _blocks int, _block int, _weight long, _set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    placed = sets.withColumn("_other", other).select(
        "_comp", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"),
        "_rep", "_block", "_weight", "_set")
    verified = stored(
        placed.repartition(runs, "_comp", "_i", "_j").sortWithinPartitions("_comp", "_i", "_j")
        .mapInPandas(_verify(threshold), "_node long, _links long, _first long, _place string"))

    # classes of verified links, then back to all rows
    linked = verified.groupBy("_node").agg(F.sum("_links").alias("_links"))
    joined = verified.where("_node <> _first")
    edges = joined.select(F.concat_ws("/", "_place", "_first").alias("_g"), "_node") \
        .unionByName(joined.select(F.concat_ws("/", "_place", "_first").alias("_g"), F.col("_first").alias("_node"))) \
        .select(F.xxhash64("_g").alias("_group"), "_node").distinct()
    near = components(stored(edges))
    result = classes.join(linked, classes["_rep"] == linked["_node"], "left").drop("_node") \
        .join(near, classes["_rep"] == near["_node"], "left") \
        .select("_digest", "_rep", "_n", F.coalesce("_root", "_rep").alias("_class"), F.coalesce("_links", F.lit(0)).alias("_links"))
    down = leaves.select("_run", "_digest").join(result, "_digest")
    found = filled.select("_id", "_run", "_digest").join(down, ["_run", "_digest"]).select(
        F.col("_id").alias("doc_id"), F.col("_class").alias("class_id"),
        (F.col("_n") - 1 + F.col("_links")).alias("n_links"), F.col("_rep").alias("copy_id"), F.col("_n").alias("copies"))
    alone = described.where(F.length("_digest") == 0).select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("_id").alias("copy_id"), F.lit(1).cast("long").alias("copies"))
    return found.unionByName(alone)
