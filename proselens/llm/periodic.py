"""Periodic runs of words, found by descending-LCP Kruskal over suffix classes.

A run is a maximal stretch of words with smallest period q and at least max(least, 2 * q) words.
If it begins at i, the suffixes at i and i + q share exactly length - q >= q words, and they are
neighbours among all positions that share that many with them.  So:

1. positions whose first ``least // 2`` words occur twice in the text are sorted as suffixes, by doubling blocks;
2. the sorted neighbours are edges, weighted by their longest common prefix (LCP);
3. edges are taken by descending LCP; a union-find holds the ordered positions of each class, and the
   smaller class goes into the larger one; two positions that become neighbours in it at a distance
   within the LCP are a square, and the seed of a run if the words before them differ.

Texts are worked on where they lie, some hundred thousand words at a time; words of different texts
get different numbers, so no match crosses texts.  No exchange is needed.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: words worked on at once; one longer text is a batch of its own
BATCH_WORDS = 1 << 18
#: an odd multiplier for the pre-selection of repeated grams (equal grams have equal values)
ODD = np.uint64(0x9E3779B97F4A7C15)

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def repeated(ids: np.ndarray, gram: int) -> np.ndarray:
    """Positions whose next ``gram`` numbers occur elsewhere too (and few others, by chance of the hash)."""
    n = len(ids) - gram + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = (h ^ ids[j:j + n].astype(np.uint64)) * ODD
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    flag = np.zeros(n, bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return np.flatnonzero(flag)


def suffix_edges(ids: np.ndarray, ends: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes (i, j) in sorted order that share ``gram`` words at least, and their LCP.

    ``ids`` numbers the words, differently in each text; ``ends`` has for each position the end of its text.
    """
    hot = repeated(ids, gram)
    none = np.zeros(0, np.int64)
    if len(hot) == 0:
        return none, none, none
    # a block that occurs twice is followed by a position of this set, or by the end of the text
    at = np.union1d(hot, (hot + gram)[hot + gram < ends[hot]])
    m = len(at)
    place = np.full(len(ids) + 1, -1, np.int64)
    place[at] = np.arange(m)
    padded = np.concatenate((ids, np.full(gram, -1, ids.dtype)))
    columns = [np.where(at + j < ends[at], padded[at + j], -1) for j in range(gram)]
    order = np.lexsort(columns[::-1])
    new = np.zeros(m, np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    # a gram that the end of its text cuts short equals none: its length is its own
    rank = np.empty(m, np.int64)
    rank[order] = np.cumsum(new)
    levels, length = [rank], gram
    while rank.max() + 1 < m:
        after = at + length
        inside = after < ends[at]
        follow = place[np.where(inside, after, len(ids))]
        key = rank * (m + 1) + np.where(follow >= 0, rank[follow] + 1, 0)
        _, rank = np.unique(key, return_inverse=True)
        levels.append(rank)
        length *= 2
    order = np.argsort(rank)
    i, j = order[:-1], order[1:]
    both = levels[0][i] == levels[0][j]
    i, j = at[i[both]], at[j[both]]
    lcp = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        inside = (a < ends[i]) & (b < ends[j])
        a, b = place[np.where(inside, a, len(ids))], place[np.where(inside, b, len(ids))]
        lcp += (gram << k) * (inside & (a >= 0) & (b >= 0) & (levels[k][a] == levels[k][b]))
    for _ in range(gram - 1):
        a, b = i + lcp, j + lcp
        lcp += (a < ends[i]) & (b < ends[j]) & (padded[np.minimum(a, len(ids))] == padded[np.minimum(b, len(ids))])
    return i, j, lcp


def kruskal(ids: list, i: np.ndarray, j: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from edges of suffixes; each run once."""
    order = np.argsort(-lcp, kind="stable")
    nodes, where = np.unique(np.concatenate((i, j)), return_inverse=True)
    a_of, b_of = where[:len(i)][order].tolist(), where[len(i):][order].tolist()
    parent = list(range(len(nodes)))
    members = [[x] for x in nodes.tolist()]
    runs = []

    def seed(p, q, common):
        d = q - p
        if d <= common and d + common >= least and (p == 0 or ids[p - 1] != ids[q - 1]):
            runs.append((p, d + common, d))

    for a, b, common in zip(a_of, b_of, lcp[order].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        large, small = members[a], members[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        members[b] = None
        last = len(small) - 1
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (k == 0 or small[k - 1] < large[at - 1]):
                seed(large[at - 1], x, common)
            if at < len(large) and (k == last or small[k + 1] > large[at]):
                seed(x, large[at], common)
        if last < 4:
            for x in small:
                large.insert(bisect_left(large, x), x)
        else:
            large += small
            large.sort()  # two ascending stretches: one linear merge
    return runs


def runs_of(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words), by start, then period."""
    parts, base = [], 0
    for words in texts:
        number: dict[bytes, int] = {}
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + base)
        base += len(number)
    sizes = np.array([len(p) for p in parts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not first[-1]:
        return out
    ids = np.concatenate(parts)
    edges = suffix_edges(ids, np.repeat(first[1:], sizes), least // 2)
    if len(edges[0]):
        for start, length, period in sorted(kruskal(ids.tolist(), *edges, least), key=lambda r: (r[0], r[2])):
            text = int(np.searchsorted(first, start, "right")) - 1
            out[text].append((start - int(first[text]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that some run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]


def _batches(least: int):
    def made(ids, texts):
        found = runs_of(texts, least)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], RUNS),
            pa.array([b" ".join(collapse(t, r)) for t, r in zip(texts, found)], pa.binary()).cast(pa.string()),
        ], names=["doc_id", "n_words", "runs", "text"])

    def run(batches):
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = t.as_py().split()  # bytes are split at ASCII white space
                if ids and held + len(words) > BATCH_WORDS:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(words)
                held += len(words)
            if ids:
                yield made(ids, texts)

    return run


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, runs, text``.

    ``runs`` holds (start, length, period) of every run of ``least`` words or more (even, 2 at least), in words
    numbered from 0, by start, then period; ``text`` is what is left without the repeats, joined by one space.
    Words are separated by ASCII white space and compared as they are, byte for byte.  A null or empty text has
    no words and no runs.  Rows are judged one by one, so repeated rows and rows without doc_id stay as they
    are; other columns are ignored; an empty table gives an empty result.  A text of n words takes about
    200 n bytes in its task.
    """
    if least < 2 or least % 2:
        raise ValueError("least is an even number of words")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(_batches(least), SCHEMA)
