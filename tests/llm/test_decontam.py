"""Benchmark decontamination against edit distances to all passages."""

import random

from proselens.llm import decontam as D

from tables import table  # noqa: F401

ITEMS = "item_id long, text string, doc_id long, distance int"


def least(item, text):
    """Least edit distance of the item to a passage, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != w))
        best = min(best, row[-1])
    return best


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k:k + 1] = [[], ["new"], ["new", words[k]]][rng.randrange(3)]
    return words


def test_same_as_brute_force(spark, table):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 15, 30, 70]))]) for k in range(25)]
    rows = []
    for i in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        if i % 2:
            k, w = rng.choice(items)
            at = rng.randrange(len(text) + 1)
            text[at:at] = edited(w, rng.randrange(7), rng) if len(w) > 5 else w
        rows.append((i, " ".join(text).upper() + "." if i % 3 else ", ".join(text)))
    frame = spark.createDataFrame([(k, " ".join(w), 1, 2) for k, w in items], ITEMS)
    got = {(r.doc_id, r.item_id): r for r in D.decontaminate(table(rows), frame).collect()}
    want = {}
    for i, t in rows:
        text = D.words(t)
        for k, w in items:
            budget = int(0.15 * len(w) + 1e-9)
            d = least(w, text)
            if d <= budget:
                want[i, k] = d
                r = got[i, k]
                assert least(w, text[r.first_word:r.last_word + 1]) == d
                assert r.budget == budget
    assert {k: r.distance for k, r in got.items()} == want
    assert len({d for d in want.values()}) > 3


def test_edges(spark, table, monkeypatch):
    frame = spark.createDataFrame([(1, "alpha beta gamma", 0, 0), (1, "alpha beta gamma", 0, 0), (2, None, 0, 0), (3, "", 0, 0),
                                   (4, "?!", 0, 0), (None, "delta", 0, 0)], ITEMS)
    rows = [(1, None), (2, ""), (3, "x alpha, beta GAMMA y"), (3, "x alpha, beta GAMMA y"), (None, "alpha beta gamma"),
            (5, "filler " * 30_000 + "alpha beta gamma"), (6, "delta"), (7, "alphabeta gamma")]
    want = sorted([(3, 1), (3, 1), (None, 1), (5, 1), (6, None)], key=str)
    for limit in (D.BLOCK_CHARS, 5):  # one block, and several
        monkeypatch.setattr(D, "BLOCK_CHARS", limit)
        got = D.decontaminate(table(rows), frame).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == want
    assert D.decontaminate(table(rows), frame.where("false")).collect() == []
    assert D.decontaminate(table([]), frame).collect() == []
