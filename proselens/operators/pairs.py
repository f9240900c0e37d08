"""Referential cohesion: sentence-pair overlap (J6, W3), families C and M.

Counting sentence pairs that share an item is quadratic in the number of
sentences of a document in the worst case (it contains the orthogonal-vectors
problem), so the work is organised to never emit a row per sentence pair:

* Spark deals the words that can be items by document and sorts them by sentence;
  nothing but those words is exchanged, and every other column is folded into four bits;
* a task reads the sorted words as Arrow batches, cuts them at document ends and
  numbers their strings (dictionary codes of the strings themselves, no hashes);
* a sentence looks its items up among the earlier sentences of its document by binary
  search in the sorted (item, sentence) pairs; the shared items of a block of
  sentences with all sentences before them are one ``bincount``, whatever the number of items.

A block holds at most ``BLOCK`` counters or hits, one sentence at least, so memory does not
grow with the square of a document.  Everything is keyed by ``doc_id`` first, so no key is
hotter than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_div
from . import annotate as A
from .metrics import finish

C = F.col
#: counters (and hits) of one block of sentences
BLOCK = 1 << 20
#: words that a task gathers before it works on the documents they complete
WORDS = 1 << 18

NOUN, PRS, CONTENT, THIRD = 1, 2, 4, 8
KINDS = ("noun", "arg", "stem", "anp")
STATS = ", ".join(["doc_id bigint"] + [f"{k}_{x} bigint" for k in KINDS for x in ("all", "adj")]
                  + [f"{x} double" for x in ("cw_s", "cw_q", "cwa_s", "cwa_q")])


def _words(tok: DataFrame) -> DataFrame:
    """The words that are items of a sentence, dealt by document and sorted by sentence.

    ``bits``: noun, personal pronoun, content word, third person.
    """
    flags = ((NOUN, C("upos").isin("NOUN", "PROPN")), (PRS, (C("upos") == "PRON") & (C("prontype") == "Prs")),
             (CONTENT, A.is_content(C("upos"))), (THIRD, C("person") == "3"))
    bits = sum((F.when(c, F.lit(b)).otherwise(F.lit(0)) for b, c in flags), F.lit(0))
    agr = F.concat(F.coalesce(C("number"), F.lit("-")), F.lit("/"), F.coalesce(C("gender"), F.lit("-")))
    return (tok.where(C("form").isNotNull() & C("doc_id").isNotNull() & C("sent_id").isNotNull())
            .select(C("doc_id").cast("long").alias("doc_id"), C("sent_id").cast("long").alias("sent_id"),
                    "form", "lemma", "stem", agr.alias("agr"), bits.alias("bits"))
            .where(C("bits").bitwiseAND(F.lit(NOUN | PRS | CONTENT)) > 0)
            .repartition("doc_id").sortWithinPartitions("doc_id", "sent_id"))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each string; a null (which matches nothing) has -1."""
    return column.chunk(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _of(sent: np.ndarray, code: np.ndarray, keep: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    keep = keep & (code >= 0)
    return sent[keep], code[keep] * 2 + shift


def _both(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers, by one sort (``np.unique`` hashes them first, which takes far longer)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[:len(x)]]


def _shared(n: int, first: np.ndarray, held: tuple, asked: tuple) -> Iterator[tuple]:
    """Blocks of sentences with their counts of shared items.

    ``held`` and ``asked``: (sentence, item) pairs; ``first``: the first sentence that each sentence looks at.
    A block is ``(a, b, base, k)``: sentence j of a to b - 1 asks for ``k[base[j - a] + i - first[j]]`` items that the earlier
    sentence i holds.
    """
    held = _distinct(held[1] * n + held[0])
    asked = _distinct(asked[0] * (asked[1].max(initial=0) + 1) + asked[1]), asked[1].max(initial=0) + 1
    sent, item = asked[0] // asked[1], asked[0] % asked[1]
    lo, hi = np.searchsorted(held, item * n + first[sent]), np.searchsorted(held, item * n + sent)
    hits = np.bincount(sent, weights=hi - lo, minlength=n).astype(np.int64)
    size = np.arange(n) - first
    at = np.searchsorted(sent, np.arange(n + 1))
    done = np.concatenate([[0], np.cumsum(np.maximum(hits, size))])
    holder = held % n
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(done, done[a] + BLOCK, side="right")) - 1)
        x = slice(at[a], at[b])
        times = hi[x] - lo[x]
        start = np.cumsum(times) - times
        i = holder[np.repeat(lo[x] - start, times) + np.arange(times.sum())]
        base = np.concatenate([[0], np.cumsum(size[a:b])])
        yield a, b, base, np.bincount(np.repeat(base[sent[x] - a] - first[sent[x]], times) + i, minlength=base[-1])
        a = b


def _named(first: np.ndarray, a: int, b: int, base: np.ndarray, k: np.ndarray) -> tuple:
    """The pairs of a block that share items: ``(j, i, k)``."""
    place = np.flatnonzero(k)
    j = np.repeat(np.arange(a, b), np.diff(base))[place]
    return j, place - base[j - a] + first[j], k[place]


def _pair_batch(t: pa.Table, adjacent: bool) -> pa.RecordBatch:
    """The sums of whole documents: words sorted by document and sentence -> one row a document."""
    t = t.combine_chunks()
    doc, number = (t[c].to_numpy().astype(np.int64) for c in ("doc_id", "sent_id"))
    bits = t["bits"].to_numpy()
    form, lemma, stem, agr = (_codes(t[c]) for c in ("form", "lemma", "stem", "agr"))
    noun, prs, content = bits & NOUN > 0, bits & PRS > 0, bits & CONTENT > 0
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    new_sent = new_doc | np.concatenate([[True], number[1:] != number[:-1]])
    sent = np.cumsum(new_sent) - 1
    n, ids, number = int(sent[-1]) + 1, doc[new_doc], number[new_sent]
    owner = (np.cumsum(new_doc) - 1)[new_sent]
    first = np.searchsorted(owner, owner)
    if adjacent:
        first = np.maximum(first, np.arange(n) - 1)
    words = _of(sent, form, content)
    same = {"noun": _of(sent, form, noun), "arg": _both(_of(sent, lemma, noun), _of(sent, form, prs, 1))}
    pairs = {k: (v, v) for k, v in same.items()}
    # stem overlap: a noun stem of one sentence equals a content-word stem of the other
    pairs["stem"] = (_both(_of(sent, stem, noun), _of(sent, stem, content, 1)), _both(_of(sent, stem, noun, 1), _of(sent, stem, content)))
    # anaphor: a noun of the earlier sentence, a 3rd-person pronoun of the later one
    pairs["anp"] = (_of(sent, agr, noun), _of(sent, agr, prs & (bits & THIRD > 0)))
    d = len(ids)
    out = [ids]
    for kind in KINDS:
        total, near = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for a, b, base, k in _shared(n, first, *pairs[kind]):
            # the pairs of a sentence are side by side, that with the sentence before it the last: none needs its names
            upto = np.searchsorted(np.flatnonzero(k), base)
            total += np.bincount(owner[a:b], weights=np.diff(upto), minlength=d).astype(np.int64)
            s = np.flatnonzero(np.diff(base))
            j = a + s
            near += np.bincount(owner[j[(k[base[s + 1] - 1] > 0) & (number[j - 1] + 1 == number[j])]], minlength=d)
        out += [total, near]
    # Dice over content words
    sizes = np.bincount(_distinct(words[0] * (words[1].max(initial=0) + 1) + words[1]) // (words[1].max(initial=0) + 1), minlength=n)
    sums = [np.zeros(d) for _ in range(4)]
    for block in _shared(n, first, words, words):
        j, i, k = _named(first, *block)
        x = 2.0 * k / (sizes[i] + sizes[j])
        near = number[i] + 1 == number[j]
        for s, (o, w) in zip(sums, ((owner[j], x), (owner[j], x * x), (owner[j[near]], x[near]), (owner[j[near]], x[near] ** 2))):
            s += np.bincount(o, weights=w, minlength=d)
    names = [c.split()[0] for c in STATS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out + sums], names=names)


def _pair_batches(adjacent: bool):
    """Sorted words -> one row a document; a document that a batch does not complete waits for the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= WORDS:
                t = pa.Table.from_batches(held)
                doc = t["doc_id"].to_numpy()
                whole = int(np.searchsorted(doc, doc[-1]))
                if whole:
                    yield _pair_batch(t.slice(0, whole), adjacent)
                held = t.slice(whole).to_batches()
                rows = len(doc) - whole
        if held:
            yield _pair_batch(pa.Table.from_batches(held), adjacent)
    return run


def pair_stats(tok: DataFrame, adjacent: bool = False) -> DataFrame:
    """Per document and kind: overlapping adjacent / earlier pair counts; Dice sums.

    ``adjacent``: a sentence is compared with the one before it only, in time linear in its document.
    """
    return _words(tok).mapInArrow(_pair_batches(adjacent), STATS)


def _mean_std_pairs(s: Column, q: Column, m: Column) -> tuple[Column, Column]:
    mean = safe_div(s, m)
    std = F.when(m > 0, F.sqrt(F.greatest(q / m.cast("double") - mean * mean, F.lit(0.0))))
    return mean, std


def sentence_counts(tok: DataFrame) -> DataFrame:
    """Kept sentences per document, those without words too."""
    return tok.groupBy("doc_id").agg(
        F.count_if(C("sent_id").isNotNull() & (C("tok_id").isNull() | (C("tok_id") == 0))).alias("S_all"))


def adjacent_cohesion(tok: DataFrame) -> DataFrame:
    """The adjacent-sentence metrics alone."""
    m = C("S_all").cast("long") - 1
    return sentence_counts(tok).join(pair_stats(tok, adjacent=True), "doc_id", "left").select("doc_id", *[
        safe_div(F.coalesce(C(x), F.lit(0)), m).alias(name)
        for x, name in (("noun_adj", "CRFNO1"), ("arg_adj", "CRFAO1"), ("stem_adj", "CRFSO1"), ("cwa_s", "CRFCWO1"), ("anp_adj", "CRFANP1"))])


def cohesion(documents: DataFrame, tok: DataFrame | None = None) -> DataFrame:
    """All referential-cohesion values per document (family C names)."""
    tok = tok if tok is not None else A.tokens(documents)
    d = sentence_counts(tok).join(pair_stats(tok), "doc_id", "left")
    S = C("S_all").cast("long")
    m_adj, m_all = S - 1, S * (S - 1) / 2

    def z(c):
        return F.coalesce(C(c), F.lit(0))

    cwo1, cwo1d = _mean_std_pairs(z("cwa_s"), z("cwa_q"), m_adj)
    cwoa, cwoad = _mean_std_pairs(z("cw_s"), z("cw_q"), m_all)
    return d.select(
        "doc_id",
        safe_div(z("noun_adj"), m_adj).alias("CRFNO1"), safe_div(z("arg_adj"), m_adj).alias("CRFAO1"),
        safe_div(z("stem_adj"), m_adj).alias("CRFSO1"), cwo1.alias("CRFCWO1"), cwo1d.alias("CRFCWO1d"),
        safe_div(z("anp_adj"), m_adj).alias("CRFANP1"),
        safe_div(z("noun_all"), m_all).alias("CRFNOa"), safe_div(z("arg_all"), m_all).alias("CRFAOa"),
        safe_div(z("stem_all"), m_all).alias("CRFSOa"), cwoa.alias("CRFCWOa"), cwoad.alias("CRFCWOad"),
        safe_div(z("anp_all"), m_all).alias("CRFANPa"),
    )


C_REFERENTIAL_COHESION = ["CRFNO1", "CRFAO1", "CRFSO1", "CRFCWO1", "CRFCWO1d", "CRFANP1",
                          "CRFNOa", "CRFAOa", "CRFSOa", "CRFCWOa", "CRFCWOad", "CRFANPa"]

M_FROM_C = {
    "argument_overlap_adjacent": "CRFAO1", "argument_overlap_all": "CRFAOa",
    "content_overlap_adjacent_mean": "CRFCWO1", "content_overlap_adjacent_std": "CRFCWO1d",
    "content_overlap_all_mean": "CRFCWOa", "content_overlap_all_std": "CRFCWOad",
    "noun_overlap_adjacent": "CRFNO1", "noun_overlap_all": "CRFNOa",
    "stem_overlap_adjacent": "CRFSO1", "stem_overlap_all": "CRFSOa",
}
M_REFERENTIAL_COHESION = list(M_FROM_C)


def c_referential_cohesion(documents: DataFrame, tok: DataFrame | None = None) -> DataFrame:
    return finish(cohesion(documents, tok), C_REFERENTIAL_COHESION)


def m_referential_cohesion(documents: DataFrame, tok: DataFrame | None = None) -> DataFrame:
    d = cohesion(documents, tok).select("doc_id", *[C(c).alias(m) for m, c in M_FROM_C.items()])
    return finish(d, M_REFERENTIAL_COHESION)
