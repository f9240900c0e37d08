"""Exact dedup and line dedup against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from proselens.llm import exact_dedup as E
from proselens.llm import line_dedup as L

from tables import table  # noqa: F401

ROWS = [(5, "a"), (1, "a"), (9, "a"), (2, "b"), (3, None), (4, ""), (6, "A"), (7, "long " * 30_000), (8, "long " * 30_000),
        (10, "é"), (11, "é"), (12, "a "), *((100 + i, "hot") for i in range(300))]


@pytest.mark.parametrize("keep,runs,fan_in", [("smallest", 1, 2), ("largest", 7, 2), ("largest", 37, 3), ("smallest", None, 16)])
def test_exact_dedup(table, keep, runs, fan_in):
    got = {r.doc_id: r for r in E.exact_dedup(table(ROWS), keep=keep, runs=runs, fan_in=fan_in).collect()}
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        own = groups[t or ""]
        best = min(own) if keep == "smallest" else max(own)
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (best, len(own), i == best)
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_edges(table):
    assert E.exact_dedup(table([])).collect() == []
    got = E.exact_dedup(table([(None, "x"), (3, "x"), (3, "x"), (None, "y")]), keep="largest").collect()
    assert sorted((r.doc_id is None, r.keep_id is None, r.group_size, r.kept) for r in got) == [
        (False, False, 3, True), (False, False, 3, True), (True, False, 3, False), (True, True, 1, True)]
    with pytest.raises(ValueError):
        E.exact_dedup(table([]), keep="any")


def brute_lines(rows):
    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
    cut = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        r = [h(x) if k == 0 else h(lines[k - 1]) * L.ROLL_BASE + h(x) for k, x in enumerate(lines)]
        ends = [k for k in range(1, len(lines) - 1) if r[k] < r[k - 1] and r[k] < r[k + 1]] + [len(lines) - 1]
        starts = [0] + [e + 1 for e in ends[:-1]]
        cut[i] = [lines[a:b + 1] for a, b in zip(starts, ends)]
    first = {}
    for i in sorted(cut):
        for p, c in enumerate(cut[i]):
            first.setdefault(tuple(c), (i, p))
    return {i: [c for p, c in enumerate(cut[i]) if len(c) < 2 or first[tuple(c)] == (i, p)] for i in cut}


def test_line_dedup(table):
    rng = random.Random(3)
    pool = [f"line {k} {rng.random()}" for k in range(60)]
    passage = pool[:14]
    rows = []
    for i in range(120):
        body = [rng.choice(pool[14:]) for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            body[len(body) // 2:len(body) // 2] = passage
        rows.append((i, "\n".join(body)))
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "\n\n\n\n"), (504, "\n\n\n\n"), (505, "x\n" * 5000), (506, "one line"), (507, "one line")]
    got = {r.doc_id: r for r in L.line_dedup(table(rows)).collect()}
    want = brute_lines(rows)
    removed = 0
    for i, t in rows:
        lines = [x for c in want[i] for x in c]
        assert got[i].text == "\n".join(lines), i
        assert got[i].n_lines == len((t or "").split("\n"))
        assert got[i].n_removed == got[i].n_lines - len(lines)
        removed += got[i].n_removed
    assert removed > 200 and got[506].n_removed == got[507].n_removed == 0


def test_line_dedup_edges(table):
    assert L.line_dedup(table([])).collect() == []
    same = "a\nb\nc"
    got = L.line_dedup(table([(1, same), (1, same), (None, same)])).collect()
    # the row without an identifier comes first; repeated rows are treated alike
    assert Counter((r.doc_id, r.n_removed > 0) for r in got) == {(None, False): 1, (1, True): 2}
