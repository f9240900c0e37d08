"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may differ from a passage by at most ``floor(error_rate * m)``
word edits (insert, delete, replace).  The item is split into one piece more than
that, so any such passage contains a piece unchanged.  All pieces of a block of items
are found in one pass over a text by an Aho-Corasick automaton; around each hit the
item is compared with the text by Myers' bit-parallel algorithm, which gives the
least edit distance to any passage there.

Items are the query set: they are read in blocks of bounded size, and each block is
matched against all documents in place, without a shuffle of texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: words that are compared: runs of letters and digits, lower case
TOKEN = re.compile(r"\w+")
#: characters of items in one block (automaton of about 100 MB)
BLOCK_CHARS = 2_000_000

SCHEMA = "doc_id bigint, item_id bigint, distance int, budget int, first_word int, last_word int"


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def pieces(item: list[str], budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` neighbouring spans of nearly equal length."""
    n = budget + 1
    return [(len(item) * i // n, len(item) * (i + 1) // n) for i in range(n)]


def least_distance(item: list[str], text: list[str]) -> tuple[int, int]:
    """Myers: least edit distance of the item to a passage of the text, and the passage's last word."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score = mask, 0, m
    best, end = m, -1
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus = down | ~(h | up) & mask
        minus = up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & mask, minus << 1 & mask
        up = minus | ~(v | plus) & mask
        down = plus & v
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """A block of items: (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], error_rate: float):
        import ahocorasick

        self.items = items
        self.budget = [math.floor(error_rate * len(w) + 1e-9) for _, w in items]
        self.machine = ahocorasick.Automaton()
        spans: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, w) in enumerate(items):
            for a, b in pieces(w, self.budget[k]):
                spans.setdefault(" " + " ".join(w[a:b]) + " ", []).append((k, a, b - a))
        for key, value in spans.items():
            self.machine.add_word(key, value)
        self.machine.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item index, distance, budget, first and last word of the passage) of all items found in the text."""
        own = words(text)
        joined = " " + " ".join(own) + " "
        regions: dict[int, list[list[int]]] = {}
        seen = at = 0
        for end, spans in self.machine.iter(joined):
            seen += joined.count(" ", at, end + 1)
            at = end + 1
            for k, offset, length in spans:
                first = seen - 1 - length - offset  # where the item would start
                m, e = len(self.items[k][1]), self.budget[k]
                a, b = max(0, first - e), min(len(own), first + m + e)
                mine = regions.setdefault(k, [])
                if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
        out = []
        for k, found in regions.items():
            item, e = self.items[k][1], self.budget[k]
            best = None
            for a, b in found:
                d, end = least_distance(item, own[a:b])
                if d <= e and (best is None or (d, a + end) < best[:2]):
                    best = (d, a + end)
            if best is not None:
                d, last = best
                # the start: the same search backwards from the last word
                back = own[max(0, last + 1 - len(item) - e):last + 1][::-1]
                length = _prefix_length(item[::-1], back, d)
                out.append((k, d, e, last + 1 - length, last))
        return sorted(out)


def _prefix_length(item: list[str], text: list[str], distance: int) -> int:
    """Length of the shortest prefix of ``text`` at that edit distance from ``item``."""
    row = list(range(len(item) + 1))
    if row[-1] == distance:
        return 0
    for j, w in enumerate(text, 1):
        last, row[0] = row[0], j
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != w))
        if row[-1] == distance:
            return j
    return len(text)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of about BLOCK_CHARS characters, one block on the driver at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).distinct().collect()
        block = sorted(((r.i, words(r.t)) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if block := [x for x in block if x[1]]:
            yield block


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = 0.15, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row and item found in it: ``doc_id, item_id, distance, budget, first_word, last_word``.

    Words are runs of letters and digits in lower case; ``distance`` is the least number of word edits
    between the item and a passage of the text, at most ``budget = floor(error_rate * words)``, and the
    words of that passage are numbered from 0 (the earliest such passage).  Items without words (null or
    empty texts too) are in no document; items with the same id and text count once; null ids stay null.
    A text without words has no rows; repeated rows give repeated results.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def matched(block: list[tuple[int, list[str]]]) -> DataFrame:
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(block, error_rate)
            for b in batches:
                out = [(i, block[k][0], *rest) for i, t in zip(b["doc_id"], b["text"])
                       for k, *rest in matcher.match(t)]
                frame = pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "budget", "first_word", "last_word"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        return rows.mapInPandas(run, SCHEMA)

    out = None
    for block in _blocks(items, item_id_col, item_text_col):
        out = matched(block) if out is None else out.unionByName(matched(block))
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)
