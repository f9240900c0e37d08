"""Word frequency and word meaning metrics (family M): corpus vocabulary joins.

Zipf values come from the corpus itself: ``zipf = log10(1e9 * count / tokens of
the language)``.  The join of tokens with that vocabulary is split by frequency:

* frequent forms (zipf >= 4, i.e. relative frequency >= 1e-5) number at most
  100 000 per language by definition; they are the hot keys, and they go
  through a broadcast hash join after an explicit size check;
* the remaining forms each hold less than 1e-5 of the tokens, so the shuffle
  join on ``(lang, form)`` has no hot key.

The semantic lexicon is a user table (``lang, form, n_senses, hyper_depth``),
broadcast only when a bounded count shows it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import incidence, safe_div
from ..session import stored
from . import annotate as A
from .metrics import base, finish

C = F.col
BROADCAST_MAX_ROWS = 2_000_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Bounded size check: scans at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def vocabulary(tok: DataFrame) -> DataFrame:
    """``lang, form, n, total, zipf`` over the whole corpus (map-side combine handles hot words)."""
    v = tok.where(C("form").isNotNull()).groupBy("lang", "form").agg(F.count("*").alias("n"))
    totals = v.groupBy(C("lang").alias("_lang")).agg(F.sum("n").alias("total"))  # one row per language
    return (v.join(totals, v["lang"].eqNullSafe(totals["_lang"])).drop("_lang")
            .withColumn("zipf", F.log10(F.lit(1e9) * C("n").cast("double") / C("total").cast("double"))))


def with_zipf(rows: DataFrame, vocab: DataFrame, rare_zipf: float = L.RARE_ZIPF) -> DataFrame:
    """Attach ``zipf`` to rows keyed by ``lang, form`` (null-safe on ``lang``); ``vocab`` is stored.

    A vocabulary of bounded size is broadcast whole; a larger one is split into frequent and rare forms.
    """
    def joined(left, right, name):
        v = right.select(C("lang").alias("_lang"), C("form").alias("_form"), C("zipf").alias(name))
        return left.join(v, left["lang"].eqNullSafe(v["_lang"]) & (left["form"] == v["_form"]), "left").drop("_lang", "_form")

    if fits_broadcast(vocab):
        return joined(rows, F.broadcast(vocab), "zipf")
    frequent, rare = vocab.where(C("zipf") >= rare_zipf), vocab.where(C("zipf") < rare_zipf)
    # bounded: at most 10**(9 - rare_zipf) forms of a language can be that frequent
    a = joined(rows, F.broadcast(frequent) if fits_broadcast(frequent) else frequent, "zf")
    hit = a.where(C("zf").isNotNull()).withColumnRenamed("zf", "zipf")
    return hit.unionByName(joined(a.where(C("zf").isNull()).drop("zf"), rare, "zipf"))


M_WORD_FREQUENCY = ["mean_distinct_rare", "mean_rare", "min_wf_per_sentence", "num_dif_rare_words_incidence",
                    "num_different_forms_incidence", "num_lexic_words_incidence", "num_rare_adj_incidence",
                    "num_rare_advb_incidence", "num_rare_nouns_incidence", "num_rare_verbs_incidence",
                    "num_rare_words_incidence"]


def frequency_level(tok: DataFrame, vocab: DataFrame | None = None, rare_zipf: float = L.RARE_ZIPF) -> DataFrame:
    """Word-frequency sums per document: one join with the stored vocabulary, rolled up by sentence."""
    vocab = stored(vocabulary(tok)) if vocab is None else vocab
    # the joined words go straight into their sentence's buffer: no group of (sentence, form) in between, which would be nearly every word
    z = with_zipf(tok.where(C("form").isNotNull()).select("doc_id", "sent_id", "lang", "form", "upos"), vocab, rare_zipf)
    content = A.is_content(C("upos"))
    rare = content & (C("zipf") < rare_zipf)
    sent = z.groupBy("doc_id", "sent_id").agg(
        F.min("zipf").alias("mz"), F.sum(F.when(rare, 1)).alias("rare_n"),
        *[F.sum(F.when(rare & (C("upos") == u), 1)).alias(f"rare_{u}") for u in ("ADJ", "ADV", "NOUN", "VERB")],
        F.collect_set(F.when(rare, C("form"))).alias("rare_forms"))  # bounded by the sentence
    return sent.groupBy("doc_id").agg(
        F.avg("mz").alias("min_wf"), *[F.sum(x).alias(x) for x in ("rare_n", "rare_ADJ", "rare_ADV", "rare_NOUN", "rare_VERB")],
        F.size(F.array_distinct(F.flatten(F.collect_list("rare_forms")))).alias("V_rare"))


def m_word_frequency_columns() -> list[Column]:
    N = C("N")
    return [
        (F.lit(100.0) * safe_div(C("V_rare"), C("V_content"))).alias("mean_distinct_rare"),
        (F.lit(100.0) * safe_div(C("rare_n"), C("content_n"))).alias("mean_rare"),
        C("min_wf").alias("min_wf_per_sentence"),
        incidence(C("V_rare"), N).alias("num_dif_rare_words_incidence"),
        incidence(C("V"), N).alias("num_different_forms_incidence"),
        incidence(C("content_n"), N).alias("num_lexic_words_incidence"),
        incidence(C("rare_ADJ"), N).alias("num_rare_adj_incidence"),
        incidence(C("rare_ADV"), N).alias("num_rare_advb_incidence"),
        incidence(C("rare_NOUN"), N).alias("num_rare_nouns_incidence"),
        incidence(C("rare_VERB"), N).alias("num_rare_verbs_incidence"),
        incidence(C("rare_n"), N).alias("num_rare_words_incidence"),
    ]


def m_word_frequency(documents: DataFrame, tok: DataFrame | None = None, vocab: DataFrame | None = None,
                     rare_zipf: float = L.RARE_ZIPF) -> DataFrame:
    vocab = stored(vocabulary(A.forms(documents))) if vocab is None and tok is None else vocab
    tok = tok if tok is not None else A.tokens(documents)
    d = base(documents, tok, ("doc", "form")).join(frequency_level(tok, vocab, rare_zipf), "doc_id", "left")
    return finish(d.select("doc_id", *m_word_frequency_columns()), M_WORD_FREQUENCY)


def default_semantic_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(L.semantic_rows()), "lang string, form string, n_senses int, hyper_depth double")


M_SEMANTICS = ["hypernymy_index", "hypernymy_nouns_index", "hypernymy_verbs_index", "polysemic_index"]


def semantic_level(tok: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Means over the semantic lexicon per document, under the metrics' names."""
    lex = lexicon if lexicon is not None else default_semantic_lexicon(tok.sparkSession)
    lex = F.broadcast(lex) if fits_broadcast(lex) else lex
    t = tok.join(lex, ["lang", "form"], "left")
    u = C("upos")
    return t.groupBy("doc_id").agg(
        F.avg(F.when(u.isin("NOUN", "PROPN", "VERB"), C("hyper_depth"))).alias("hypernymy_index"),
        F.avg(F.when(u.isin("NOUN", "PROPN"), C("hyper_depth"))).alias("hypernymy_nouns_index"),
        F.avg(F.when(u == "VERB", C("hyper_depth"))).alias("hypernymy_verbs_index"),
        F.avg(F.when(A.is_content(u), C("n_senses"))).alias("polysemic_index"),
    )


def m_semantics(documents: DataFrame, tok: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    return finish(semantic_level(tok if tok is not None else A.tokens(documents), lexicon), M_SEMANTICS)
