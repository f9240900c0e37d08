"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is encoded by halves: both halves are cut into the pattern's pieces, and two
neighbours are joined by cutting a window around their border again, growing it
until the cuts outside can no longer change.  Long pieces are merged the same way
on the level of tokens: halves are encoded, and a window of tokens around the
border is encoded again, growing until the tokens on both sides are compatible with
the window's outer tokens.  Decoding concatenates the tokens' bytes up the tree.

Why the outside is stable:

* A match of the pattern depends only on the text from its start to two code points
  after its end (a contraction needs two letters, a run of white space the letter
  after it).  So a piece of the left half that ends three code points or more before
  the border is final, and once the window's cut meets a cut of the right half, all
  later cuts are the same.
* A token sequence is the merge result of its bytes exactly when each pair of
  neighbouring tokens is the merge result of the pair's bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: code points of a leaf text, bytes of a leaf piece, ids of a decoding leaf
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 1 << 14, 8, 1 << 15
#: bytes from which pairs are kept in a heap; more than any rank
HEAP_BYTES, NO_RANK = 256, 1 << 32
#: pieces remembered by a task
MEMO = 500_000
#: code points before a border up to which a piece may still change
LOOK_AHEAD = 3

SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"


class ByteBpe:
    """``ranks`` maps bytes to ids; ``pattern`` cuts a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.token = {i: b for b, i in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # tokens of one piece

    def _merge(self, data: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        if len(data) > HEAP_BYTES:
            return self._merge_long(data)
        get = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = [get(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]
        while rank:
            least = min(rank)
            if least == NO_RANK:
                break
            i = rank.index(least)
            joined = parts[i] + parts.pop(i + 1)
            parts[i] = joined
            del rank[i]
            if i < len(rank):
                rank[i] = get(joined + parts[i + 1], NO_RANK)
            if i:
                rank[i - 1] = get(parts[i - 1] + joined, NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs: (rank, place), stale entries passed over."""
        get, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))  # end of the part that begins at each place; 0 where none begins
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i:end[i]]])
            i = end[i]
        return out

    def _fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if self._fits(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1  # left[:i] and right[j:] are outside the window
        grow_left = grow_right = 1
        while True:
            window = b"".join([self.token[t] for t in left[i:] + right[:j]])
            middle = self._tree(window) if len(window) <= LEAF_BYTES else self._merge(window)
            open_left = i > 0 and not self._fits(left[i - 1], middle[0])
            open_right = j < len(right) and not self._fits(middle[-1], right[j])
            if not (open_left or open_right):
                return left[:i] + middle + right[j:]
            if open_left:
                i, grow_left = max(0, i - grow_left), 2 * grow_left
            if open_right:
                j, grow_right = min(len(right), j + grow_right), 2 * grow_right

    def _tree(self, data: bytes) -> list[int]:
        known = self.parts.get(data)
        if known is not None:
            return known
        if len(data) <= LEAF_BYTES:
            known = self._merge(data)
        else:
            half = len(data) // 2
            known = self._join_tokens(self._tree(data[:half]), self._tree(data[half:]))
        if len(data) <= 2 * LEAF_BYTES:
            if len(self.parts) >= MEMO:
                self.parts.clear()
            self.parts[data] = known
        return known

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, packed; a piece that is a token as a whole is that token."""
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self._tree(data)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    # pieces of one text

    def _join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        keep, tail = len(left), 0
        while keep and tail < LOOK_AHEAD:  # a piece that ends less than LOOK_AHEAD before the border is cut again
            keep -= 1
            tail += len(left[keep])
        head, size = "".join(left[keep:]), 4
        while True:
            size = min(size, len(right))
            window = head + "".join(right[:size])
            cuts, at = {}, len(head)
            for q in range(size + 1):
                cuts[at] = q
                at += len(right[q]) if q < size else 0
            firm = len(window) if size == len(right) else len(window) - LOOK_AHEAD
            again, at = self.find(window), 0
            for n, p in enumerate(again):
                at += len(p)
                if at > firm:
                    break
                if at in cuts:
                    return left[:keep] + again[:n + 1] + right[cuts[at]:]
            size *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.find(text)
        half = len(text) // 2
        return self._join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for p in self.pieces(text):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = self.piece(p)
                if len(p) <= 64:
                    memo[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        if len(ids) > 4 * LEAF_IDS:
            half = len(ids) // 8 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids`` (packed, unsigned 32 bits, little endian), ``decoded`` (bytes).

    ``vocabulary`` is a rank file that every executor can open.  A null or empty text has no ids.  Rows
    are independent: repeated rows and ids are encoded as often as they occur; other columns are ignored.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe.from_file(vocabulary, pattern)
        for b in batches:
            for at in range(0, len(b), 64):  # results of a few texts at a time
                part = b.iloc[at:at + 64]
                ids = [bpe.encode(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_tokens": [len(x) // 4 for x in ids],
                                    "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA)

