"""Substring dedup against a dictionary of all windows."""

import random
import re

import pytest

from proselens.llm import substring as S

from tables import table  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (i, s):
                gone[s:s + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("window", [4, 20])
def test_same_as_brute_force(table, window):
    rng = random.Random(window)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "ß", " x"]
    passages = [[rng.choice(vocabulary) for _ in range(window + rng.randrange(2 * window))] for _ in range(8)]
    rows = []
    for i in range(200):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages)[rng.randrange(3):] if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        rows.append((i * 17 % 997, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)))
    rows += [(1500, "same " * 3000), (1501, "same " * 60), (1502, None), (1503, ""), (1504, " \n "), (1505, rows[7][1]), (1506, "a b c a b c a b c " * 9)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in S.substring_dedup(table(rows), window=window).collect())
    assert got == brute(rows, window)
    assert sum(r[2] for r in got) > 500


def test_edges(table):
    assert S.substring_dedup(table([])).collect() == []
    text = " ".join(f"k{i}" for i in range(25))
    got = S.substring_dedup(table([(None, text), (3, text), (3, text), (4, "a")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (3, 25), (3, 25), (4, 0)]
    with pytest.raises(ValueError):
        S.substring_dedup(table([]), window=7)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_in_polynomial_hashes(table):
    """Two Thue-Morse words: equal under polynomials modulo 2**64, but they are different words."""
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    text = lambda w: " ".join([f"w{i}" for i in range(10)] + [w] + [f"w{i}" for i in range(10, 30)])
    got = sorted((r.doc_id, r.n_removed) for r in S.substring_dedup(table([(1, text(x)), (2, text(y))])).collect())
    assert got == [(1, 0), (2, 20)]
    hashes = [S.K.words_of(*S.K.text_buffer(S.pa.array([w])))[0][0] for w in (x, y, x[:64], y[:64], "ab", "a\0", "a")]
    assert len(set(hashes)) == 7


def test_texts_of_a_megabyte(table):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(150_000))
    rows = [(1, long), (2, "x" * 1_000_000), (3, "head " + long), (4, long[:1000])]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.substring_dedup(table(rows)).collect())
    assert got == [(i, n, removed) for i, n, removed, _ in brute(rows, 20)]


def test_batches_follow_bytes(spark, monkeypatch):
    from proselens.llm import exchange as X
    monkeypatch.setattr(X, "BATCH_BYTES", 1000)
    rows = spark.createDataFrame([(i, "x" * 500) for i in range(400)], "_id long, _text string")
    dealt, _ = X.batched(rows, "_id")
    sizes = [r["count"] for r in dealt.groupBy("_batch").count().collect()]
    assert max(sizes) < 12 and len(sizes) > 100


def test_the_texts_are_exchanged_once(table):
    rows = S.substring_dedup(table([(1, "a " * 30), (2, "a " * 40)]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("_text") > 0
    assert all("_text" not in line for line in plan.splitlines() if "Exchange" in line)
