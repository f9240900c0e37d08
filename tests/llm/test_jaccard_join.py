"""N-gram Jaccard join against all pairs."""

import random
import re

import numpy as np

from proselens.llm import jaccard_join as J

from tables import table  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[y] = x
    return {rows[k][0]: (rows[find(k)][0], links[k]) for k in range(len(rows))}


def test_same_as_all_pairs(table, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 12)  # many blocks in the large group
    rng = random.Random(2)
    rows, n = [], 0
    for family, size in [(80, 60), (30, 10), (12, 5), (300, 8)] + [(25, 1)] * 20:
        base = [f"{family}x{n}w{rng.randrange(10**6)}" for _ in range(family)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            rows.append((n * 7 % 1009, "  ".join(w)))
            n += 1
    rows += [(2001, rows[0][1]), (2002, rows[0][1].replace("  ", "\n")), (2003, None), (2004, ""), (2005, "a b"), (2006, "a b"), (2007, "b a"),
             (2008, "z " * 20_000)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(table(rows)).collect()}
    assert got == brute(rows)


def test_edges(table):
    assert J.jaccard_join(table([])).collect() == []
    got = J.jaccard_join(table([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.copies) for r in got) == [(1, 1, 1, 2), (1, 1, 1, 2), (2, 2, 0, 1)]


def test_depth_meets_recall():
    for t in (0.5, 0.8, 0.9):
        d = J.trie_depth(t)
        assert d == 1 or 1 - (1 - t ** d) ** J.TREES >= J.TARGET_RECALL
    rng = np.random.default_rng(0)
    depth = J.trie_depth(0.8)
    factors = J.K.mix(np.arange(1, J.TREES * depth + 1, dtype=np.uint64)) | np.uint64(1)
    met = 0
    for _ in range(300):  # pairs exactly at the threshold
        x = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        a, b = (set(J.signature(s, factors, depth)) for s in (x[:81], x[9:]))
        met += bool(a & b)
    assert met >= 295
