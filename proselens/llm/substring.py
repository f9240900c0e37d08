"""Substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping runs of BLOCK = WINDOW // 2 words of every
document.  Any window of WINDOW words holds one of its document's blocks whole, so a window
that occurs twice shows up as a rolling run of BLOCK words elsewhere that equals a block.

1. Every batch sends the fingerprints of its rolling runs, once each, with a mark on those that
   are blocks; a bucket answers which of them meet a block of another place (or are one that
   another place meets).
2. Around these hits the batch extends to whole windows, and sends each distinct window with
   its first place in the batch; a bucket answers whether that is the first place of all.
3. Windows that are not the first of all are removed; neighbouring ones join to maximal repeats.

The texts are dealt to batches once, as a table bucketed by batch; all three steps read it as it lies.

Fingerprints in step 1 are 30 bits inside their bucket and only select windows.  Windows are compared by a keyless
BLAKE2 digest of 128 bits of their bytes, words joined by one space, so that no two different windows are taken for one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import stored, text_of
from .exchange import ask, batched, cut, kept_by_batch, pack, unpack

NO_ID = np.iinfo(np.int64).min

ASKED = "_bucket int, _batch int, _kind int, _n int, _marks binary"
PLACED = "_bucket int, _batch int, _kind int, _n int, _keys binary, _checks binary, _docs binary, _starts binary"
ANSWER = "_bucket int, _batch int, _kind int, _n int, _bits binary"


class Batch:
    """The words of a batch of texts, ordered by document."""

    def __init__(self, table: pa.Table, window: int):
        ids = np.asarray(table["_id"].combine_chunks().fill_null(NO_ID))
        order = np.argsort(ids, kind="stable")
        self.table = table.take(pa.array(order))
        self.ids, self.window, self.block = ids[order], window, window // 2
        self.data, self.offsets = K.text_buffer(self.table["_text"].combine_chunks())
        self.starts, self.ends = K.spans(self.data, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.words = K.word_hashes(self.data, self.starts, self.ends, 5)
        # the words of all texts joined by one space, and where each word begins there
        self.joined_at = np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.place = np.arange(len(self.words)) - self.first[self.owner]

    def runs(self, n: int) -> np.ndarray:
        """First words of all runs of n words of one text."""
        return np.flatnonzero(self.owner[:max(0, len(self.owner) - n + 1)] == self.owner[n - 1:])

    def rolling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the rolling runs, their distinct hashes, and which of these each run has."""
        at = self.runs(self.block)
        keys, which = np.unique(K.sequence_hashes(self.words, self.block)[at], return_inverse=True)
        return at, keys, which

    def joined(self) -> bytes:
        size = int(self.joined_at[-1])
        out = np.full(size, 32, np.uint8)
        inside = np.ones(size, bool)
        inside[self.joined_at[1:] - 1] = False
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts] += 1
        edge[self.ends] -= 1
        out[inside] = self.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        return out.tobytes()

    def candidates(self, bits: np.ndarray):
        """First words of the windows that hold a hit, sorted distinct windows (two halves of a digest), which each is, and first places."""
        at, _, which = self.rolling()
        hit = np.zeros(len(self.words) + 1, np.int64)
        hit[at[bits[which]] + 1] = 1
        total = np.cumsum(hit)
        start = self.runs(self.window)
        reach = np.minimum(start + self.window - self.block, len(self.words))
        start = start[total[reach] > total[start]]
        text = memoryview(self.joined()) if len(start) else b""
        lo, hi = self.joined_at[start].tolist(), (self.joined_at[start + self.window] - 1).tolist()
        blake2b = hashlib.blake2b
        digests = np.frombuffer(b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(lo, hi)]), np.uint64).reshape(-1, 2)
        keys, checks = digests[:, 0], digests[:, 1]
        order = np.lexsort((checks, keys))  # stable: the first of equal windows is the first place
        k, c = keys[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return start, k[new], c[new], which, order[new]


def _probe(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        own = Batch(table, window)
        at, keys, which = own.rolling()
        anchor = np.bincount(which[own.place[at] % own.block == 0], minlength=len(keys)) > 0
        twice = np.bincount(which, minlength=len(keys)) > 1
        edges = cut(keys, buckets)
        low = np.repeat(np.arange(buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets + 1), np.diff(edges))
        scale = ((1 << 64) // buckets + 1) // (1 << 30) + 1
        marks = ((keys - low) // np.uint64(scale)).astype(np.uint32) << np.uint32(2)
        marks |= anchor.astype(np.uint32) | twice.astype(np.uint32) << np.uint32(1)
        return pack(table["_batch"][0].as_py(), 1, keys, {"_marks": marks}, buckets)

    return run


def _answer(table: pa.Table, bits: np.ndarray) -> pa.Table:
    n = np.asarray(table["_n"])
    at = np.concatenate(([0], np.cumsum(n)))
    return pa.table({"_bucket": table["_bucket"], "_batch": table["_batch"], "_kind": table["_kind"], "_n": table["_n"],
                     "_bits": pa.array([np.packbits(bits[at[i]:at[i + 1]]).tobytes() for i in range(len(n))], pa.binary())})


def _meet(table: pa.Table) -> pa.Table:
    """A run is a hit if some run of its fingerprint is a block and there are two of them at least."""
    marks = unpack(table["_marks"], np.uint32)
    order = np.argsort(marks >> np.uint32(2), kind="stable")
    prints = (marks >> np.uint32(2))[order]
    begin = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))) if len(prints) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((begin, [len(prints)])))
    mark = np.bitwise_or.reduceat(marks[order], begin) if len(begin) else marks
    hit = ((mark & 1) > 0) & (((mark & 2) > 0) | (size > 1))
    bits = np.empty(len(marks), bool)
    bits[order] = np.repeat(hit, size)
    return _answer(table, bits)


def _bits(answers: pa.Table, kind: int) -> np.ndarray:
    mine = answers.filter(pc.equal(answers["_kind"], kind)).sort_by("_bucket")
    parts = [np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), count=n).astype(bool)
             for b, n in zip(mine["_bits"], mine["_n"].to_pylist())]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _place(window: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Batch(left, window)
        start, keys, checks, _, first = own.candidates(_bits(right, 1))
        at = start[first]
        return pack(left["_batch"][0].as_py(), 2, keys, {
            "_keys": keys, "_checks": checks, "_docs": own.ids[own.owner[at]], "_starts": own.place[at].astype(np.uint32)}, buckets)

    return run


def _earliest(table: pa.Table) -> pa.Table:
    keys, checks = unpack(table["_keys"], np.uint64), unpack(table["_checks"], np.uint64)
    docs, starts = unpack(table["_docs"], np.int64), unpack(table["_starts"], np.uint32)
    order = np.lexsort((starts, docs, checks, keys))
    k, c, d, s = keys[order], checks[order], docs[order], starts[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    bits = np.empty(len(order), bool)
    bits[order] = (d == d[head]) & (s == s[head])
    return _answer(table, bits)


def _remove(window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Batch(left, window)
        start, _, _, which, first = own.candidates(_bits(right, 1))
        earliest = _bits(right, 2)
        head = start[first][which]  # first place of each window in the batch
        same = (own.ids[own.owner[start]] == own.ids[own.owner[head]]) & (own.place[start] == own.place[head])
        gone = start[~(earliest[which] & same)] if len(start) else start
        cover = np.zeros(len(own.words) + 1, np.int64)
        cover[gone] += 1
        cover[gone + window] -= 1
        keep = np.cumsum(cover)[:-1] == 0
        kept = np.flatnonzero(keep)
        follows = np.zeros(len(kept), bool)  # another kept word of the text comes after
        follows[:-1] = own.owner[kept[1:]] == own.owner[kept[:-1]]
        data = own.data.copy()
        data[own.ends[kept[follows]]] = 32
        edge = np.zeros(len(data) + 2, np.int64)
        edge[own.starts[kept]] += 1
        edge[own.ends[kept] + follows] -= 1
        inside = np.cumsum(edge)[:len(data)] > 0
        offsets = np.concatenate(([0], np.cumsum(inside)))[own.offsets].astype(np.int32)
        text = pa.StringArray.from_buffers(len(own.ids), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
        words = np.diff(own.first)
        removed = np.bincount(own.owner[~keep], minlength=len(own.ids))
        return pa.table({"doc_id": own.table["_id"], "n_words": pa.array(words, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "text": text})

    return run


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, text`` (kept words, joined by one space).

    Words are separated by ASCII white space and compared as they are.  A word is removed when it is in a
    window of ``window`` (even) words whose sequence also starts earlier: in a smaller doc_id, or in the same
    document before.  Windows are those of the input.  A null text has no words.  Rows without doc_id come
    before all others, as one document; rows that repeat a doc_id count as the same document, so their
    windows at equal places are not earlier than each other.  Other columns are ignored; an empty table gives
    an empty result.
    """
    if window < 2 or window % 2:
        raise ValueError("window is an even number of words")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    dealt, buckets = batched(rows, "_id")
    groups = kept_by_batch(dealt).groupBy("_batch")
    hits = stored(ask(groups.applyInArrow(_probe(window, buckets), ASKED), _meet, ANSWER))
    placed = groups.cogroup(hits.groupBy("_batch")).applyInArrow(_place(window, buckets), PLACED)
    first = stored(ask(placed, _earliest, ANSWER))
    return groups.cogroup(hits.unionByName(first).groupBy("_batch")).applyInArrow(
        _remove(window), "doc_id long, n_words long, n_removed long, text string")
