"""Byte-level BPE against the tiktoken library, with tiny leaves so that texts and pieces have many borders."""

import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from proselens.llm import bpe as B

from tables import table  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = B.ByteBpe(RANKS, PATTERN)
PARTS = st.sampled_from(["a", "b", "e", "the", " ", "  ", "\n", "'", "re", "'s", "'l", "l", "1", "é", "ß", "!", "?", "漢", "o", "\t", " ", "😀"])


def ids(text):
    return list(memoryview(OWN.encode(text)).cast("I"))


@pytest.mark.parametrize("chars,size", [(1, 1), (5, 2), (16, 8), (1 << 14, 8), (1 << 14, 48)])
@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.lists(PARTS, max_size=60).map("".join), st.text(alphabet="abeo", max_size=200),
                      st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60)))
def test_same_as_tiktoken(chars, size, text):
    old = B.LEAF_CHARS, B.LEAF_BYTES
    B.LEAF_CHARS, B.LEAF_BYTES = chars, size
    OWN.memo.clear()
    OWN.parts.clear()
    try:
        assert ids(text) == ORACLE.encode_ordinary(text)
        assert OWN.decode(OWN.encode(text)) == text.encode()
    finally:
        B.LEAF_CHARS, B.LEAF_BYTES = old


def test_table(table):
    rows = [(1, "It's the end."), (2, None), (3, ""), (4, "x" * 200_000), (5, " \n" * 50_000), (1, "It's the end."), (None, "a<|endoftext|>b"),
            (6, "word " * 40_000)]
    got = B.bpe_round_trip(table(rows), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, bytes(r.decoded)): list(memoryview(bytes(r.ids)).cast("I")) for r in got}
    for i, t in rows:
        want = [] if not t else ORACLE.encode_ordinary(t) if len(t) < 100_000 or " " in t and "word" in t else None
        own = by[i, (t or "").encode()]
        assert want is None or own == want
    assert all(r.n_tokens == len(bytes(r.ids)) // 4 for r in got)
    assert B.bpe_round_trip(table([]), PATH, PATTERN).collect() == []
