"""Conversation repair against a plain dynamic programme over whole audit strings."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proselens.llm import conversation as V
from proselens.llm import queries as Q

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LETTER = {"user": "u", "assistant": "a"}


def damage(conv, turn, role, text):
    t = lambda x: " " if x is None else str(x)
    h = zlib.crc32(f"{t(conv)}:{t(turn)}".encode()) % 20
    role, text = t(role), t(text)
    if h == 0:
        return []
    text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
    return [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        seen_before = (role, text) in seen
        seen.add((role, text))
        shown = VISIBLE.findall(text)
        out.append("blank" if not shown else "duplicate" if seen_before else "truncated" if shown[-1] not in ".!?" else "")
    return out


def best_edits(rows):
    """(cost, audit, lines) by a recursion over (row, state) on whole answers."""
    kind = faults(rows)
    inf = (float("inf"), "", ())

    def options(i, after):
        table = {}
        for s in range(4):
            found = []
            if i == len(rows):
                found.append((0, "", ()) if s in (0, 3) else inf)
            else:
                role, text = rows[i]
                more = 5 if kind[i] == "truncated" else 0
                found.append((2 + after[s][0], "D" + after[s][1], after[s][2]))
                if kind[i] not in ("blank", "duplicate"):
                    if (s, role[:1]) in NEXT:
                        c = after[NEXT[s, role[:1]]]
                        found.append((more + c[0], "K" + c[1], (f"{role}:{text}",) + c[2]))
                    for name, x in LETTER.items():
                        if (s, x) in NEXT:
                            c = after[NEXT[s, x]]
                            found.append((1 + more + c[0], "R" + c[1], (f"{name}:{text}",) + c[2]))
            table[s] = min(found)
        for _ in range(4):
            for s in range(4):
                for name, x in LETTER.items():
                    if (s, x) in NEXT:
                        c = table[NEXT[s, x]]
                        table[s] = min(table[s], (5 + c[0], "I" + c[1], (f"{name}:",) + c[2]))
        return table

    table = options(len(rows), None)
    for i in range(len(rows) - 1, -1, -1):
        table = options(i, table)
    return table[0]


def want(conv, rows):
    """Rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    turns = [t for t, _, _ in rows if t is not None]
    kind = faults([r[1:] for r in rows])
    cost, audit, lines = best_edits([r[1:] for r in rows])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, gaps, kind.count("blank"), kind.count("duplicate"), kind.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@settings(max_examples=300, deadline=None)
@given(codes=st.lists(st.integers(0, 8), max_size=40), size=st.integers(1, 7))
def test_fix_up_of_chunks_is_exact(codes, size):
    """Chunks from speculation, rerun from their neighbour's head, end at the vectors and costs of one long walk."""
    w, codes = V.Walker(), bytes(codes)
    end = w.number(V.END)
    parts = [codes[i:i + size] for i in range(0, len(codes), size)]
    old = [w.run(p, end) for p in parts]
    v, total = end, 0
    for k in range(len(parts) - 1, -1, -1):
        v, cost = w.rerun(parts[k], v, end, *old[k])
        total += cost
    assert (v, total) == w.run(codes, end)


def sample(rng, n_conv):
    texts = ["Yes.", "No!", "Maybe", "", " \n", "What?", "é ß.", "a. b"]
    rows = []
    for conv in range(n_conv):
        for turn in range(rng.choice([1, 2, 3, 6, 9, 30])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.4 else rng.choice([role, role, role, role, "tool", "", "unknown", None])
            text = rng.choice(texts) if rng.random() < 0.4 else f"word {rng.randrange(1000)}" + rng.choice([".", "!", "", ". "])
            rows.append((conv, None if rng.random() < 0.03 else turn + rng.choice([0, 0, 0, 3, 7]), role, rng.choice([text, text, text, None])))
    return rows + [(500, t, ["user", "assistant"][t % 2], f"t{t}.") for t in range(200)] \
        + [(501, t, "user", "cut short") for t in range(150)] + [(502, t, "user", f"cut {t}") for t in range(150)] \
        + [(503, 1, "user", "same.")] * 120 + [(504, t, "assistant", f"a{t}.") for t in range(90)] + [(None, None, None, None), (None, 3, "user", "x.")]


@pytest.mark.parametrize("chunk", [4096, 7, 2])
def test_query_same_as_brute_force(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(V, "CHUNK_ROWS", chunk)
    rows = sample(random.Random(chunk), 60)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.conv_id, *[r[c] for c in COLUMNS]) for r in Q.op12_conversation_repair(spark, str(tmp_path)).collect()}
    kept = {}
    for r in rows:
        kept.setdefault(r[0], []).extend(x[1:] for x in damage(*r))
    expected = {c: want(c, x) for c, x in kept.items()}
    assert got == expected
    assert set("".join(r[7] for r in expected.values())) == set("DKR")  # deleting a neighbour is always cheaper than an insert


def test_edges(spark):
    schema = "conv_id string, turn int, role string, text string, _g long, _conv string, _at int, line string, cost long"
    none = V.repair_conversations(spark.createDataFrame([], schema))
    assert none.summary.collect() == [] and none.lines.collect() == []
    rows = [("c", 2, "assistant", "b.", 1, "x", 2, "y", 3), ("c", 1, "user", "a.", 1, "x", 2, "y", 3), (None, 1, "", "", None, None, None, None, None)]
    out = V.repair_conversations(spark.createDataFrame(rows, schema))
    assert sorted((r._conv, r.audit, r.cost) for r in out.summary.collect()) == [("", "D", 2), ("=c", "KK", 0)]
    assert [r.line for r in out.lines.orderBy("chunk", "at").collect()] == ["user:a.", "assistant:b."]


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK_BYTES", 1000)
    rows = [(1, 0, "user", "w " * 400_000 + "."), (1, 1, "assistant", "x" * 700 + "."), (1, 2, "user", "y" * 700 + "."), (1, 3, "assistant", "z.")]
    (r,) = V.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).summary.collect()
    assert r.audit == "KKKK" and r.repaired_sha256 == hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in rows).encode()).hexdigest()
