"""Token counts against the library; the cache is used, kept by version, and only misses are encoded."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from proselens.llm import queries as Q
from proselens.llm import token_counts as T

from tables import table  # noqa: F401

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
ROWS = [(1, "It's the end."), (2, None), (3, ""), (4, "It's the end."), (1, "It's the end."), (None, "a<s>b</s>"), (None, None), (5, "x" * 5000),
        (6, " \t\n  two  spaces "), (7, "漢字 😀 é ﬁ"), (5, "another text of five"), (8, "word " * 3000), (9, "a\0b")] + [(i, "copy") for i in range(10, 60)]


def want(rows):
    return sorted(((-1 if i is None else i), len((t or "").encode()), len(SP.encode(t or ""))) for i, t in rows)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "▁", "é", "9", "1 0", "<s>", "漢", "́"]), max_size=80).map("".join), st.text(
    alphabet=st.characters(exclude_categories=["Cs"]), max_size=60)), size=st.sampled_from([1, 3, 10]))
def test_cut_texts_count_as_the_library_does(text, size):
    old, T.CUT_CHARS = T.CUT_CHARS, size
    try:
        assert COUNTER([text, "a b " * 9, text]) == [len(SP.encode(t)) for t in (text, "a b " * 9, text)]
    finally:
        T.CUT_CHARS = old


with open(PATH, "rb") as f:
    COUNTER = T.PieceCounter(f.read())


def test_cuts_are_used():
    assert COUNTER.cuttable and len(COUNTER.parts("ab " * (1 << 20))) == 3


@pytest.mark.parametrize("bound", [T.BROADCAST_KEYS, 0])
def test_same_as_library(table, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(T, "BROADCAST_KEYS", bound)
    assert got(T.token_counts(table(ROWS), *T.piece_counter(PATH))) == want(ROWS)


def test_cache(spark, table, tmp_path):
    cache = str(tmp_path / "cache")
    first, second = ROWS[:5], ROWS
    assert got(T.token_counts(table(first), *T.piece_counter(PATH), cache=cache)) == want(first)
    assert spark.read.parquet(cache).count() == 2  # distinct texts

    def refuse():
        raise AssertionError("nothing is to be encoded")
    version = T.piece_counter(PATH)[1]
    assert got(T.token_counts(table(first + [(90, None)]), refuse, version, cache=cache)) == want(first + [(90, None)])
    assert got(T.token_counts(table(second), *T.piece_counter(PATH), cache=cache)) == want(second)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ROWS})
    # another version never sees these counts
    one = lambda: (lambda texts: [1] * len(texts))
    assert {r[2] for r in got(T.token_counts(table(first), one, "other", cache=cache))} == {1}
    # a key appended twice counts once
    spark.read.parquet(f"{cache}/version={version}").write.mode("append").parquet(f"{cache}/version={version}")
    assert got(T.token_counts(table(first), refuse, version, cache=cache)) == want(first)


def test_empty_table(table):
    assert T.token_counts(table([]), *T.piece_counter(PATH)).collect() == []


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS + [(200, "long " * 5000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = Q.op11_token_counts(spark, str(tmp_path)).collect()
    assert len(rows) == len(ROWS) + 1
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and sum(r.over_limit for r in rows) == 1
