"""Periodic runs against brute force over all periods, and the damage and digests of the query."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proselens.llm import periodic as P
from proselens.llm import queries as Q

from tables import table  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    out = []
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            part = words[i:i + length]
            if length >= max(least, 2 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def damaged(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def row(doc_id, text):
    words = damaged(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(
    st.lists(st.sampled_from("ab"), max_size=70),
    st.lists(st.sampled_from(["a b", "a b c", "c", "a b a b a b", "d e f g h i j"]), max_size=20).map(lambda x: " ".join(x).split()),
    st.tuples(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=25), st.integers(1, 6)).map(lambda x: x[0] * x[1])), max_size=4),
    least=st.sampled_from([2, 4, 12]))
def test_same_as_brute_force(texts, least):
    got = P.runs_of([[w.encode() for w in t] for t in texts], least)
    assert got == [brute(t, least) for t in texts]


def test_known_words():
    fib, prev = ["a"], ["b"]
    while len(fib) < 400:
        fib, prev = fib + prev, fib
    thue = [str(bin(i).count("1") % 2) for i in range(512)]
    for words in (fib, thue, ["x"] * 300, [str(i % 37) for i in range(500)], [str(i) for i in range(300)]):
        assert P.runs_of([[w.encode() for w in words]], 12) == [brute(words)]


def test_query_same_as_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "ß x", "long"]) for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(i, "\n".join(f"w{k}\tz{k} " for k in range(rng.randrange(90)))) for i in range(150, 300)]
    rows += [(300, None), (301, ""), (302, " \n "), (7, rows[7][1]), (None, "a b " * 40), (None, None), (303, "x " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in Q.op13_periodic_runs(spark, str(tmp_path)).collect()]
    small = [r for r in rows if r[0] != 303]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r for r in got if r[0] != 303), key=key) == sorted((row(*r) for r in small), key=key)
    assert sum(r[1] for r in got) > 40
    assert [r[1:6] for r in got if r[0] == 303] == [(1, 0, 5000, 1, 5_000_000)]


def test_edges(table):
    got = P.periodic_runs(table([(1, "a b " * 6), (1, "a b " * 6), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got) == \
        [(1, 12, [(0, 12, 2)], "a b")] * 2 + [(2, 0, [], "")]
    assert P.periodic_runs(table([])).collect() == []
    with pytest.raises(ValueError):
        P.periodic_runs(table([]), least=3)


def test_long_text_in_bounded_time():
    words = [b"w%d" % (i % 1000) for i in range(300_000)]
    assert P.runs_of([words], 12) == [[(0, 300_000, 1000)]]
