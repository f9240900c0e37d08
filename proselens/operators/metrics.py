"""Per-document metric operators, families C (48) and M (98): SURVEY 2.8-2.9.

Every key is a function ``documents -> DataFrame[doc_id, metrics...]``.  They are
aggregates over the token rows of ``annotate.tokens``:

* ``doc_counts``: one ``groupBy(doc_id)``.  All rows of a document come from one
  input row, so the partial aggregate finishes each document map-side and the
  exchange carries about one row per document.  Sentence and paragraph length
  moments need no sentence-level group: a sentence of n words has
  ``n^2 = sum over its tokens of (2*tok_id + 1)``; the same identity on the
  position of a sentence in its paragraph gives paragraph moments.
* ``sentence_level``: ``groupBy(doc_id, sent_id)`` then ``groupBy(doc_id)`` for
  what needs a per-sentence value (words without stopwords, first verb, tag runs).
* ``form_level``, ``lemma_level``: ``groupBy(doc_id, value)`` with a bit mask of tags,
  then ``groupBy(doc_id)``: distinct counts in fixed-width buffers.

A key is the columns it computes over the per-document frames it needs (``metric_key``),
so the full matrix joins each frame once and selects the columns of all keys.

Empty denominators give null, which ``finish`` turns into 0 (P5); NaN stays.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import lexicon as L
from ..functions.text import incidence, punct_count, safe_div
from . import annotate as A

C = F.col


def mean_std(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
    """Mean and population std from count, sum and sum of squares (all bigint, exact)."""
    mean = safe_div(s, n)
    std = F.when(n > 0, F.sqrt(F.greatest(n * q - s * s, F.lit(0)).cast("double") / (n * n).cast("double")))
    return mean, std


def finish(df: DataFrame, names: list[str]) -> DataFrame:
    """P5: null -> 0, NaN kept; every metric a double."""
    return df.select("doc_id", *[F.coalesce(C(m).cast("double"), F.lit(0.0)).alias(m) for m in names])


# --------------------------------------------------------------------------- base aggregates

def _tok_flags(tok: DataFrame) -> DataFrame:
    u = C("upos")
    return tok.select(
        "*",
        A.is_content(u).alias("content"),
        ((u == "PRON") & (C("prontype") == "Prs")).alias("prs"),
    )


def doc_counts(tok: DataFrame) -> DataFrame:
    """Token-level sums per document: fixed-width buffers only (code-generated hash aggregate)."""
    t = _tok_flags(tok)
    u, lemma, w = C("upos"), C("lemma"), C("form").isNotNull()
    first = w & (C("tok_id") == 0)

    def cnt(cond):
        return F.count_if(w & cond)

    aggs = [
        F.count("form").alias("N"),
        F.count_if(first).alias("S"),
        F.count_if(first & (C("sent_in_para") == 0)).alias("P"),
        F.sum(F.when(w, 2 * C("tok_id") + 1)).alias("sent_q"),
        F.sum(F.when(first, 2 * C("sent_in_para") + 1)).alias("para_q"),
        F.sum("n_syll").alias("syl_s"), F.sum(C("n_syll") * C("n_syll")).alias("syl_q"),
        F.sum("n_char").alias("chr_s"), F.sum(C("n_char") * C("n_char")).alias("chr_q"),
        F.sum(F.length(lemma)).alias("lem_s"), F.sum(F.length(lemma) * F.length(lemma)).alias("lem_q"),
        cnt(~C("stop")).alias("ns_n"),
        F.sum(F.when(~C("stop"), C("n_char"))).alias("ns_chr_s"),
        F.sum(F.when(~C("stop"), C("n_char") * C("n_char"))).alias("ns_chr_q"),
        cnt(u == "NOUN").alias("noun"), cnt(u == "PROPN").alias("propn"), cnt(u == "VERB").alias("verb"),
        cnt(u == "ADJ").alias("adj"), cnt(u == "ADV").alias("adv"), cnt(u == "SCONJ").alias("sconj"),
        cnt(C("content")).alias("content_n"), cnt(C("prs")).alias("prs_n"),
        cnt(C("neg")).alias("neg_n"),
        cnt(C("verbform") == "Ger").alias("ger"), cnt(C("verbform") == "Inf").alias("inf"),
        cnt(C("mood") == "Imp").alias("imp"), cnt(C("mood") == "Ind").alias("ind"),
        cnt(C("tense") == "Past").alias("past"), cnt(C("tense") == "Pres").alias("pres"),
        cnt((C("tense") == "Past") & C("irregular")).alias("past_irr"),
    ]
    for p in ("1", "2", "3"):
        aggs.append(cnt(C("prs") & (C("person") == p)).alias(f"prs{p}"))
        for num, tag in (("Sing", "s"), ("Plur", "p")):
            aggs.append(cnt(C("prs") & (C("person") == p) & (C("number") == num)).alias(f"prs{p}{tag}"))
    return t.groupBy("doc_id", "lang").agg(*aggs)


# tag code per token for phrase runs (W4): N noun, A adjective, D determiner/number,
# V verb, X auxiliary, '.' anything else
CODES = ".ADNVX"


def _code(u: Column) -> Column:
    """The place of a token's code in ``CODES``."""
    code = (F.when(u.isin("NOUN", "PROPN"), "N").when(u == "ADJ", "A").when(u.isin("DET", "NUM"), "D")
            .when(u == "VERB", "V").when(u == "AUX", "X").otherwise("."))
    return F.instr(F.lit(CODES), code) - 1


def sentence_level(tok: DataFrame) -> DataFrame:
    """Per-sentence values rolled up per document."""
    u = C("upos")
    s = (tok.groupBy("doc_id", "sent_id").agg(
        F.count_if(C("form").isNotNull() & ~C("stop")).alias("m"),
        F.coalesce(F.min(F.when(u == "VERB", C("tok_id"))), F.min(F.when(u == "AUX", C("tok_id")))).alias("mv"),
        # a word is one number, (place, code): a sort of numbers
        F.array_join(F.transform(F.sort_array(F.collect_list(C("tok_id").cast("long") * 8 + _code(u))),
                                 lambda x: F.substring(F.lit(CODES), (x % 8).cast("int") + 1, F.lit(1))), "").alias("codes"))
         .where(C("sent_id").isNotNull()))
    np_runs = F.filter(F.regexp_extract_all("codes", F.lit("[NAD]+"), 0), lambda r: F.instr(r, "N") > 0)
    vp_runs = F.filter(F.regexp_extract_all("codes", F.lit("[VX]+"), 0), lambda r: F.instr(r, "V") > 0)
    s = s.select(
        "doc_id", "m", "mv",
        F.size(np_runs).alias("np"),
        F.aggregate(np_runs, F.lit(0), lambda a, r: a + F.length(r) - F.length(F.replace(r, F.lit("A"), F.lit("")))).alias("np_adj"),
        F.aggregate(np_runs, F.lit(0), lambda a, r: a + F.length(r)).alias("np_len"),
        F.size(vp_runs).alias("vp"),
    )
    return s.groupBy("doc_id").agg(
        F.count("*").alias("S2"), F.sum("m").alias("m_s"), F.sum(C("m") * C("m")).alias("m_q"),
        F.sum("mv").alias("mv_s"), F.count("mv").alias("mv_n"),
        F.sum("np").alias("NP"), F.sum("np_adj").alias("NP_adj"), F.sum("np_len").alias("NP_len"),
        F.sum("vp").alias("VP"),
    )


TAG_BITS = (("content", 1), ("adj", 2), ("adv", 4), ("noun", 8), ("verb", 16))


def _tag_mask() -> Column:
    """Bits of a token's tags: content word, ADJ, ADV, NOUN, VERB."""
    u = C("upos")
    flags = [A.is_content(u), u == "ADJ", u == "ADV", u == "NOUN", u == "VERB"]
    return sum((F.when(f, F.lit(bit)).otherwise(F.lit(0)) for f, (_, bit) in zip(flags, TAG_BITS)), F.lit(0))


def _distinct(tok: DataFrame, col: str, prefix: str, *extra) -> DataFrame:
    """Distinct values of a column per document, in all and by tag (a value counts for each tag it occurs with)."""
    g = tok.where(C("form").isNotNull()).groupBy("doc_id", col).agg(F.count("*").alias("n"), F.bit_or(_tag_mask()).alias("tags"))
    return g.groupBy("doc_id").agg(
        F.count("*").alias(prefix),
        *[F.count_if(C("tags").bitwiseAND(F.lit(bit)) > 0).alias(f"{prefix}_{name}") for name, bit in TAG_BITS], *extra)


def form_level(tok: DataFrame) -> DataFrame:
    """Distinct forms per document (V, by tag) and forms seen once (V1)."""
    return _distinct(tok, "form", "V", F.count_if(C("n") == 1).alias("V1"))


def lemma_level(tok: DataFrame) -> DataFrame:
    """Distinct lemmas per document (VL, by tag)."""
    return _distinct(tok, "lemma", "VL")


def punct_level(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", punct_count(C("text")).alias("punct"))


def connective_counts(documents: DataFrame, preprocess=None) -> DataFrame:
    """Connective matches per document and class (n-grams of 1-4 words in a sentence).

    The lexicon is a fixed table of ~100 phrases, compiled into hash-set tests on ``lang|ngram`` keys.
    N-grams are formed only where a phrase can start, and counted inside the sentence's array: one row
    a sentence reaches the per-document partial aggregate.
    """
    rows = A.L.connective_rows()
    max_n = max(r[2] for r in rows)
    first = sorted({f"{lg}|{p.split(' ')[0]}" for lg, p, _, _ in rows})
    keys = {None: sorted({f"{lg}|{p}" for lg, p, _, _ in rows})}
    keys |= {cls: sorted({f"{lg}|{p}" for lg, p, _, c in rows if c == cls}) for cls in L.CONNECTIVE_CLASSES}
    s = A.sentences(documents, preprocess)
    s = s.select("doc_id", "lang", F.transform(A.T.words_of(C("raw")), F.lower).alias("w"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))),
                      lambda i: F.concat(C("lang"), F.lit("|"), F.get(C("w"), i - 1)).isin(first))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(max_n)), lambda n: i + n - 1 <= F.size("w")),
        lambda n: F.concat(C("lang"), F.lit("|"), F.array_join(F.slice("w", i, n), " ")))))
    g = s.select("doc_id", F.filter(grams, lambda x: x.isin(keys[None])).alias("g"))
    count = lambda k: F.sum(F.greatest(F.size(F.filter("g", lambda x: x.isin(k))), F.lit(0)))
    return g.groupBy("doc_id").agg(F.sum(F.greatest(F.size("g"), F.lit(0))).alias("conn_all"),
                                   *[count(keys[cls]).alias(f"conn_{cls}") for cls in L.CONNECTIVE_CLASSES])


# --------------------------------------------------------------------------- helpers

FRAMES = {
    "doc": lambda documents, tok: doc_counts(tok),
    "sent": lambda documents, tok: sentence_level(tok),
    "form": lambda documents, tok: form_level(tok),
    "lemma": lambda documents, tok: lemma_level(tok),
    "conn": lambda documents, tok: connective_counts(documents),
    "punct": lambda documents, tok: punct_level(documents),
    "mtld": lambda documents, tok: doc_words(documents).select("doc_id", mtld_expr(C("words")).alias("mtld")),
}


def cleaned(documents: DataFrame, preprocess=None) -> DataFrame:
    """The documents with ``preprocess`` (Column -> Column) applied to the text that every frame reads."""
    return documents if preprocess is None else documents.withColumn("text", preprocess(C("text")))


def base(documents: DataFrame, tok: DataFrame | None, need: tuple[str, ...]) -> DataFrame:
    """The per-document frames a key needs, joined on ``doc_id``; the first one has every document."""
    tok = tok if tok is not None else A.tokens(documents)
    out = FRAMES[need[0]](documents, tok)
    for k in need[1:]:
        out = out.join(FRAMES[k](documents, tok), "doc_id", "left")
    return out


def metric_key(names: list[str], need: tuple[str, ...]):
    """A metric key from a function that gives its columns over the joined frames ``need``.

    The key is ``documents[, tok] -> doc_id, metrics``; ``key.columns()`` are the columns themselves, so that
    the full matrix selects the columns of all keys from one joined frame.
    """
    def wrap(columns):
        def key(documents: DataFrame, tok: DataFrame | None = None, preprocess=None) -> DataFrame:
            return finish(base(cleaned(documents, preprocess), tok, need).select("doc_id", *columns()), names)
        key.columns, key.names, key.need, key.__doc__, key.__name__ = columns, names, need, columns.__doc__, columns.__name__
        return key
    return wrap


# --------------------------------------------------------------------------- family C

C_DESCRIPTIVE = ["DESPC", "DESSC", "DESWC", "DESPL", "DESPLd", "DESSL", "DESSLd",
                 "DESWLsy", "DESWLsyd", "DESWLlt", "DESWLltd"]


@metric_key(C_DESCRIPTIVE, ("doc",))
def c_descriptive() -> list[Column]:
    N, S, P = C("N"), C("S"), C("P")
    pl, pld = mean_std(P, S, C("para_q"))
    sl, sld = mean_std(S, N, C("sent_q"))
    sy, syd = mean_std(N, C("syl_s"), C("syl_q"))
    lt, ltd = mean_std(N, C("chr_s"), C("chr_q"))
    return [P.alias("DESPC"), S.alias("DESSC"), N.alias("DESWC"),
                   pl.alias("DESPL"), pld.alias("DESPLd"), sl.alias("DESSL"), sld.alias("DESSLd"),
                   sy.alias("DESWLsy"), syd.alias("DESWLsyd"), lt.alias("DESWLlt"), ltd.alias("DESWLltd")]


C_WORD_INFORMATION = ["WRDNOUN", "WRDVERB", "WRDADJ", "WRDADV", "WRDPRO", "WRDPRP1s", "WRDPRP1p",
                      "WRDPRP2s", "WRDPRP2p", "WRDPRP3s", "WRDPRP3p"]


@metric_key(C_WORD_INFORMATION, ("doc",))
def c_word_information() -> list[Column]:
    N = C("N")
    cols = [incidence(C("noun") + C("propn"), N).alias("WRDNOUN"), incidence(C("verb"), N).alias("WRDVERB"),
            incidence(C("adj"), N).alias("WRDADJ"), incidence(C("adv"), N).alias("WRDADV"),
            incidence(C("prs_n"), N).alias("WRDPRO")]
    for p in ("1", "2", "3"):
        for tag in ("s", "p"):
            cols.append(incidence(C(f"prs{p}{tag}"), N).alias(f"WRDPRP{p}{tag}"))
    return cols


C_PATTERN_DENSITY = ["DRNP", "DRVP", "DRNEG"]


@metric_key(C_PATTERN_DENSITY, ("doc", "sent"))
def c_pattern_density() -> list[Column]:
    N = C("N")
    return [incidence(C("NP"), N).alias("DRNP"), incidence(C("VP"), N).alias("DRVP"),
                   incidence(C("neg_n"), N).alias("DRNEG")]


C_SYNTACTIC_COMPLEXITY = ["SYNNP", "SYNLE"]


@metric_key(C_SYNTACTIC_COMPLEXITY, ("doc", "sent"))
def c_syntactic_complexity() -> list[Column]:
    return [safe_div(C("NP_adj"), C("NP")).alias("SYNNP"), safe_div(C("mv_s"), C("mv_n")).alias("SYNLE")]


C_CONNECTIVES = ["CNCAll", "CNCCaus", "CNCLogic", "CNCADC", "CNCTemp", "CNCAdd"]


@metric_key(C_CONNECTIVES, ("doc", "conn"))
def c_connectives() -> list[Column]:
    N = C("N")
    return [*[incidence(C(src), N).alias(dst) for dst, src in (
        ("CNCAll", "conn_all"), ("CNCCaus", "conn_causal"), ("CNCLogic", "conn_logical"),
        ("CNCADC", "conn_adversative"), ("CNCTemp", "conn_temporal"), ("CNCAdd", "conn_additive"))]]


C_LEXICAL_DIVERSITY = ["LDTTRa", "LDTTRcw"]


@metric_key(C_LEXICAL_DIVERSITY, ("doc", "form"))
def c_lexical_diversity() -> list[Column]:
    return [safe_div(C("V"), C("N")).alias("LDTTRa"),
                   safe_div(C("V_content"), C("content_n")).alias("LDTTRcw")]


C_READABILITY = ["RDFHGL"]


def _huerta(syl: Column, n: Column, s: Column) -> Column:
    return F.lit(206.84) - F.lit(60.0) * safe_div(syl, n) - F.lit(1.02) * safe_div(n, s)


def _flesch_en(syl: Column, n: Column, s: Column) -> Column:
    return F.lit(206.835) - F.lit(84.6) * safe_div(syl, n) - F.lit(1.015) * safe_div(n, s)


@metric_key(C_READABILITY, ("doc",))
def c_readability() -> list[Column]:
    return [_huerta(C("syl_s"), C("N"), C("S")).alias("RDFHGL")]


# --------------------------------------------------------------------------- family M

M_CONNECTIVES = ["adversative_connectives_incidence", "all_connectives_incidence",
                 "causal_connectives_incidence", "conditional_connectives_incidence",
                 "logical_connectives_incidence", "temporal_connectives_incidence"]


@metric_key(M_CONNECTIVES, ("doc", "conn"))
def m_connectives() -> list[Column]:
    N = C("N")
    return [*[incidence(C("conn_" + m.split("_")[0]), N).alias(m) for m in M_CONNECTIVES]]


M_DESCRIPTIVE = ["lemmas_length_mean", "lemmas_length_std", "num_paragraphs_incidence",
                 "num_sentences_incidence", "num_syllables_words_mean", "num_syllables_words_std",
                 "sentences_length_mean", "sentences_length_no_stopwords_mean",
                 "sentences_length_no_stopwords_std", "sentences_length_std",
                 "sentences_per_paragraph_mean", "sentences_per_paragraph_std", "words_length_mean",
                 "words_length_no_stopwords_mean", "words_length_no_stopwords_std", "words_length_std"]


@metric_key(M_DESCRIPTIVE, ("doc", "sent"))
def m_descriptive() -> list[Column]:
    N, S, P = C("N"), C("S"), C("P")
    lm, ls = mean_std(N, C("lem_s"), C("lem_q"))
    sy, syd = mean_std(N, C("syl_s"), C("syl_q"))
    sl, sld = mean_std(S, N, C("sent_q"))
    nsl, nsld = mean_std(C("S2"), C("m_s"), C("m_q"))
    pl, pld = mean_std(P, S, C("para_q"))
    wl, wld = mean_std(N, C("chr_s"), C("chr_q"))
    nwl, nwld = mean_std(C("ns_n"), C("ns_chr_s"), C("ns_chr_q"))
    return [lm.alias("lemmas_length_mean"), ls.alias("lemmas_length_std"),
                   incidence(P, N).alias("num_paragraphs_incidence"),
                   incidence(S, N).alias("num_sentences_incidence"),
                   sy.alias("num_syllables_words_mean"), syd.alias("num_syllables_words_std"),
                   sl.alias("sentences_length_mean"), nsl.alias("sentences_length_no_stopwords_mean"),
                   nsld.alias("sentences_length_no_stopwords_std"), sld.alias("sentences_length_std"),
                   pl.alias("sentences_per_paragraph_mean"), pld.alias("sentences_per_paragraph_std"),
                   wl.alias("words_length_mean"), nwl.alias("words_length_no_stopwords_mean"),
                   nwld.alias("words_length_no_stopwords_std"), wld.alias("words_length_std")]


M_LEXICAL_DIVERSITY = ["adj_density", "adj_ttr", "adv_density", "adv_ttr", "content_ttr", "honore",
                       "lemma_adj_ttr", "lemma_adv_ttr", "lemma_content_ttr", "lemma_nttr", "lemma_ttr",
                       "lemma_vttr", "lexical_density", "maas", "mtld", "negation_incidence",
                       "noun_density", "nttr", "simple_ttr", "verb_density", "vttr"]


def previous_places(words: Column, both) -> Column:
    """``both(before, after)`` of a word array: for each word the place (from 0) of the same word before it, or -1; the same for
    the reversed array.

    One sort of strings (word, place) puts the same words side by side; what is put back into the order of the places
    are plain numbers, (place, place of the same word + 1).  Words hold no NUL character.
    """
    digits = 10

    def linked(keys):
        place = lambda x: F.right(x, F.lit(digits)).cast("long")
        word = lambda x: F.left(x, F.length(x) - digits)
        last = F.size(keys).cast("long") - 1

        def link(x, k):  # the neighbour before k in ``keys`` is the same word at an earlier place
            return F.when((k > 0) & (word(F.get(keys, k - 1)) == word(x)), place(F.get(keys, k - 1))).otherwise(F.lit(-1).cast("long"))

        def link_back(x, k):
            return F.when((k < last) & (word(F.get(keys, k + 1)) == word(x)), last - place(F.get(keys, k + 1))).otherwise(F.lit(-1).cast("long"))

        def in_order(packed):
            return F.transform(F.sort_array(F.coalesce(packed, F.array().cast("array<bigint>"))), lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - 1).cast("int"))
        ahead = F.transform(keys, lambda x, k: F.shiftleft(place(x), 32) + link(x, k) + 1)
        back = F.transform(keys, lambda x, k: F.shiftleft(last - place(x), 32) + link_back(x, k) + 1)
        return both(in_order(ahead), in_order(back))

    keys = F.sort_array(F.transform(words, lambda w, i: F.concat(w, F.lit("\0"), F.lpad(i.cast("string"), digits, "0"))))
    return F.transform(F.array(keys), linked)[0]  # bound to a variable: sorted once


def mtld_expr(words: Column, threshold: float = L.MTLD_THRESHOLD) -> Column:
    """MTLD of an ordered word array: mean of the forward and backward factor counts.

    A segment closes when its type-token ratio falls below the threshold; the last open segment counts as
    ``(1 - ttr) / (1 - threshold)``.  A word is a new type of its segment if the same word last stood before the
    segment's start, so the fold over the places of the previous occurrences carries three numbers and no
    set; it is a built-in ``aggregate`` inside the task that holds the document, linear but for one sort.
    """
    start = F.struct(F.lit(0.0).alias("f"), F.lit(0).alias("s"), F.lit(0).alias("types"), F.lit(0).alias("n"))

    def step(acc, p):
        types, n = acc["types"] + F.when(p < acc["s"], 1).otherwise(0), acc["n"] + 1
        closes = types.cast("double") / n.cast("double") < F.lit(threshold)
        return F.when(closes, F.struct((acc["f"] + 1.0).alias("f"), (acc["s"] + n).alias("s"), F.lit(0).alias("types"), F.lit(0).alias("n"))) \
            .otherwise(F.struct(acc["f"].alias("f"), acc["s"].alias("s"), types.alias("types"), n.alias("n")))

    def factors(places):
        def fin(acc):
            ttr = acc["types"].cast("double") / acc["n"].cast("double")
            part = F.when(acc["n"] > 0, (F.lit(1.0) - ttr) / F.lit(1.0 - threshold)).otherwise(F.lit(0.0))
            return acc["f"] + part
        return F.aggregate(places, start, step, fin)

    n = F.size(words)
    both = previous_places(words, lambda before, after: F.struct(factors(before).alias("a"), factors(after).alias("b")))
    return F.when(n > 0, F.transform(F.array(both), lambda x: F.when((x["a"] > 0) & (x["b"] > 0), (n / x["a"] + n / x["b"]) / 2.0))[0])


def mtld_one(words, threshold: float = L.MTLD_THRESHOLD):
    """MTLD of one word sequence: the same arithmetic as ``mtld_expr``."""
    def factors(ws):
        f, types, n = 0.0, set(), 0
        for w in ws:
            types.add(w)
            n += 1
            if len(types) / n < threshold:
                f, types, n = f + 1.0, set(), 0
        if n > 0:
            f += (1.0 - len(types) / n) / (1.0 - threshold)
        return f
    n = len(words)
    if n == 0:
        return None
    a, b = factors(words), factors(words[::-1])
    if a <= 0 or b <= 0:
        return None
    return (n / a + n / b) / 2.0


@F.pandas_udf(DoubleType())
def mtld_udf(words: pd.Series) -> pd.Series:
    """Arrow-batched MTLD, the same as ``mtld_expr``: a sequential fold with resets and a hash set (for the full matrix)."""
    return words.map(lambda ws: mtld_one(list(ws)) if ws is not None else None).astype("float64")


def doc_words(documents: DataFrame, preprocess=None) -> DataFrame:
    """Ordered lower-cased words of each document, in-row (for sequential metrics)."""
    text = C("text") if preprocess is None else preprocess(C("text"))
    sents = F.flatten(F.transform(A.T.paragraphs(text), A.T.sentences_of))
    words = F.flatten(F.transform(sents, lambda s: F.transform(A.T.words_of(s), F.lower)))
    return documents.select("doc_id", words.alias("words"))


def mtld_level(documents: DataFrame) -> DataFrame:
    """The frame ``mtld`` by Arrow batches, which takes less than sorting every document's words: the full matrix uses it."""
    return doc_words(documents).select("doc_id", mtld_udf(C("words")).alias("mtld"))


@metric_key(M_LEXICAL_DIVERSITY, ("doc", "form", "lemma", "mtld"))
def m_lexical_diversity() -> list[Column]:
    N, V = C("N"), C("V")
    honore = F.when((V > 0) & (C("V1") < V),
                    F.lit(100.0) * F.log(N.cast("double")) / (F.lit(1.0) - C("V1").cast("double") / V.cast("double")))
    maas = F.when((N > 1) & (V > 0), (F.log(N.cast("double")) - F.log(V.cast("double")))
                  / (F.log(N.cast("double")) * F.log(N.cast("double"))))
    return [
        safe_div(C("adj"), N).alias("adj_density"), safe_div(C("V_adj"), C("adj")).alias("adj_ttr"),
        safe_div(C("adv"), N).alias("adv_density"), safe_div(C("V_adv"), C("adv")).alias("adv_ttr"),
        safe_div(C("V_content"), C("content_n")).alias("content_ttr"),
        honore.alias("honore"),
        safe_div(C("VL_adj"), C("adj")).alias("lemma_adj_ttr"),
        safe_div(C("VL_adv"), C("adv")).alias("lemma_adv_ttr"),
        safe_div(C("VL_content"), C("content_n")).alias("lemma_content_ttr"),
        safe_div(C("VL_noun"), C("noun")).alias("lemma_nttr"),
        safe_div(C("VL"), N).alias("lemma_ttr"),
        safe_div(C("VL_verb"), C("verb")).alias("lemma_vttr"),
        safe_div(C("content_n"), N).alias("lexical_density"),
        maas.alias("maas"), C("mtld"),
        incidence(C("neg_n"), N).alias("negation_incidence"),
        safe_div(C("noun"), N).alias("noun_density"),
        safe_div(C("V_noun"), C("noun")).alias("nttr"),
        safe_div(V, N).alias("simple_ttr"),
        safe_div(C("verb"), N).alias("verb_density"),
        safe_div(C("V_verb"), C("verb")).alias("vttr")]


M_READABILITY = ["flesch"]


@metric_key(M_READABILITY, ("doc",))
def m_readability() -> list[Column]:
    syl, n, s = C("syl_s"), C("N"), C("S")
    return [F.when(C("lang") == "es", _huerta(syl, n, s)).otherwise(_flesch_en(syl, n, s)).alias("flesch")]


M_SYNTAX = ["gerund_incidence", "infinitive_incidence", "left_embeddedness", "mean_depth_per_sentence",
            "mean_np_per_sentence", "mean_propositions_per_sentence", "mean_vp_per_sentence",
            "noun_phrase_density_incidence", "num_decendents_noun_phrase", "num_modifiers_noun_phrase",
            "num_punct_marks_per_sentence", "num_subord_incidence", "verb_phrase_density_incidence"]


def m_syntax_columns(has_depth: bool = False) -> list[Column]:
    N, S = C("N"), C("S")
    md = C("mean_depth") if has_depth else F.lit(None).cast("double")
    return [
        incidence(C("ger"), N).alias("gerund_incidence"), incidence(C("inf"), N).alias("infinitive_incidence"),
        safe_div(C("mv_s"), C("mv_n")).alias("left_embeddedness"),
        md.alias("mean_depth_per_sentence"),
        safe_div(C("NP"), S).alias("mean_np_per_sentence"),
        safe_div(C("verb"), S).alias("mean_propositions_per_sentence"),
        safe_div(C("VP"), S).alias("mean_vp_per_sentence"),
        incidence(C("NP"), N).alias("noun_phrase_density_incidence"),
        safe_div(C("NP_len") - C("NP"), C("NP")).alias("num_decendents_noun_phrase"),
        safe_div(C("NP_adj"), C("NP")).alias("num_modifiers_noun_phrase"),
        safe_div(C("punct"), S).alias("num_punct_marks_per_sentence"),
        incidence(C("sconj"), N).alias("num_subord_incidence"),
        incidence(C("VP"), N).alias("verb_phrase_density_incidence"),
    ]


def m_syntax(documents: DataFrame, tok: DataFrame | None = None, depth: DataFrame | None = None) -> DataFrame:
    """``depth``: optional ``doc_id, mean_depth`` from a supplied parse; without it the depth metric is 0."""
    d = base(documents, tok, ("doc", "sent", "punct"))
    if depth is not None:
        d = d.join(depth.select("doc_id", "mean_depth"), "doc_id", "left")
    return finish(d.select("doc_id", *m_syntax_columns(depth is not None)), M_SYNTAX)


M_MORPHOLOGY = ["num_adj_incidence", "num_adv_incidence", "num_first_pers_pron_incidence",
                "num_first_pers_sing_pron_incidence", "num_impera_incidence", "num_indic_incidence",
                "num_noun_incidence", "num_past_incidence", "num_past_irregular_incidence",
                "num_past_irregular_mean", "num_personal_pronouns_incidence", "num_pres_incidence",
                "num_proper_noun_incidence", "num_third_pers_pron_incidence", "num_verb_incidence",
                "ratio_proper_nouns_per_nouns"]


@metric_key(M_MORPHOLOGY, ("doc",))
def m_morphology() -> list[Column]:
    N = C("N")
    return [
        incidence(C("adj"), N).alias("num_adj_incidence"), incidence(C("adv"), N).alias("num_adv_incidence"),
        incidence(C("prs1"), N).alias("num_first_pers_pron_incidence"),
        incidence(C("prs1s"), N).alias("num_first_pers_sing_pron_incidence"),
        incidence(C("imp"), N).alias("num_impera_incidence"), incidence(C("ind"), N).alias("num_indic_incidence"),
        incidence(C("noun"), N).alias("num_noun_incidence"), incidence(C("past"), N).alias("num_past_incidence"),
        incidence(C("past_irr"), N).alias("num_past_irregular_incidence"),
        safe_div(C("past_irr"), C("past")).alias("num_past_irregular_mean"),
        incidence(C("prs_n"), N).alias("num_personal_pronouns_incidence"),
        incidence(C("pres"), N).alias("num_pres_incidence"),
        incidence(C("propn"), N).alias("num_proper_noun_incidence"),
        incidence(C("prs3"), N).alias("num_third_pers_pron_incidence"),
        incidence(C("verb"), N).alias("num_verb_incidence"),
        safe_div(C("propn"), C("noun") + C("propn")).alias("ratio_proper_nouns_per_nouns")]


LIGHT = C_DESCRIPTIVE + C_LEXICAL_DIVERSITY + C_READABILITY


def light_matrix(documents: DataFrame, tok: DataFrame | None = None, raw: bool = False) -> DataFrame:
    """Descriptive, lexical-diversity and readability metrics of family C from one aggregate.

    ``raw=True`` keeps nulls (before the P5 rule).
    """
    d = base(documents, tok, ("doc", "form"))
    N, S, P = C("N"), C("S"), C("P")
    pl, pld = mean_std(P, S, C("para_q"))
    sl, sld = mean_std(S, N, C("sent_q"))
    sy, syd = mean_std(N, C("syl_s"), C("syl_q"))
    lt, ltd = mean_std(N, C("chr_s"), C("chr_q"))
    out = d.select("doc_id", P.alias("DESPC"), S.alias("DESSC"), N.alias("DESWC"),
                   pl.alias("DESPL"), pld.alias("DESPLd"), sl.alias("DESSL"), sld.alias("DESSLd"),
                   sy.alias("DESWLsy"), syd.alias("DESWLsyd"), lt.alias("DESWLlt"), ltd.alias("DESWLltd"),
                   safe_div(C("V"), N).alias("LDTTRa"), safe_div(C("V_content"), C("content_n")).alias("LDTTRcw"),
                   _huerta(C("syl_s"), N, S).alias("RDFHGL"))
    if raw:
        return out.select("doc_id", *[C(m).cast("double").alias(m) for m in LIGHT])
    return finish(out, LIGHT)
