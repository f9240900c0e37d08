"""Documents -> sentence rows and token rows.

``sentences``: one row per kept sentence, from a ``posexplode`` of an in-row
array, so no shuffle.  ``tokens``: one row per word, tagged by one probe of the
broadcast closed-class lexicon (a fixed table) and plain column expressions (suffix
rules as ``endswith``), all inside whole-stage codegen.  Every aggregate downstream
groups by ``doc_id`` or ``(doc_id, sent_id)``; since all rows of a document
come from one input row they sit in one partition, so the map-side partial
aggregate collapses them before the exchange.

Token columns: ``doc_id lang para_id sent_id tok_id form lemma stem upos cap
person number gender prontype tense mood verbform irregular neg stop n_syll
n_char``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

CLOSED_UPOS = ("DET", "PRON", "ADP", "CCONJ", "SCONJ", "AUX", "VERB", "ADV", "NUM")
TOKEN_COLUMNS = ("doc_id", "lang", "para_id", "sent_id", "tok_id", "form", "lemma", "stem", "upos",
                 "cap", "person", "number", "gender", "prontype", "tense", "mood", "verbform",
                 "irregular", "neg", "stop", "n_syll", "n_char")


def _case(pairs) -> Column:
    expr = None
    for cond, val in pairs:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


#: features of the closed-class lexicon and the values that tokens may show
LEXICON_FEATS = {"Person": ("1", "2", "3"), "Number": ("Sing", "Plur"), "Gender": ("Masc", "Fem", "Neut"), "PronType": ("Prs", "Rel"),
                 "Tense": ("Pres", "Past"), "Mood": ("Ind", "Imp"), "VerbForm": ("Inf", "Ger", "Part"), "Irregular": ("Yes",), "Polarity": ("Neg",)}


def closed_class(spark: SparkSession) -> DataFrame:
    """The fixed closed-class table: ``lx_key`` (``lang|form``), ``lx_upos`` and its features."""
    names = ["key", "upos", *(k.lower() for k in LEXICON_FEATS)]
    rows = [dict(zip(names, (f"{lang}|{form}", upos, *[feats.get(k) if feats.get(k) in v else None for k, v in LEXICON_FEATS.items()])))
            for lang, form, upos, feats in L.closed_class_rows()]
    schema = "array<struct<" + ", ".join(f"lx_{n}: string" for n in names) + ">>"
    table = F.from_json(F.lit(json.dumps([{f"lx_{k}": v for k, v in r.items()} for r in rows])), schema)
    return spark.range(1).select(F.inline(table))


def _ends_any(form: Column, pattern: str) -> Column:
    """``form`` ends with one of the alternatives of a ``(a|b|c)$`` pattern: bytes compared in place, no substring is made."""
    return reduce(lambda a, b: a | b, [form.endswith(s) for s in pattern.strip("()$").split("|")])


def stem_expr(form: Column) -> Column:
    """Strip the longest listed ending (what the anchored regex does) if 3+ letters remain."""
    alts = L.STEM_SUFFIX.strip("()$").split("|")
    # per length the letters to cut, if enough remain: no test is copied
    cut = _case((_ends_any(form, "|".join(s for s in alts if len(s) == n)), F.when(F.length(form) >= n + L.STEM_MIN_LETTERS, n).otherwise(0))
                for n in sorted({len(s) for s in alts}, reverse=True)).otherwise(0)
    return F.substring(form, F.lit(1), F.length(form) - cut)


def sentences(documents: DataFrame, preprocess=None) -> DataFrame:
    """``doc_id, lang, para_id, sent_in_para, sent_id, raw`` for every kept sentence.

    A document without any sentence keeps one row with null ``sent_id`` so that
    every document reaches the per-document aggregates (no join back needed).
    """
    text = F.col("text")
    if preprocess is not None:
        text = preprocess(text)
    psents = F.transform(T.paragraphs(text), T.sentences_of)
    flat = F.flatten(F.transform(
        psents, lambda ss, i: F.transform(
            ss, lambda s, j: F.struct(i.alias("para_id"), j.alias("sent_in_para"), s.alias("raw")))))
    return (documents.select("doc_id", "lang", F.posexplode_outer(flat).alias("sent_id", "s"))
            .select("doc_id", "lang", "s.para_id", "s.sent_in_para", "sent_id", "s.raw"))


def tag(words: DataFrame) -> DataFrame:
    """Tag rows holding ``word`` (original case), ``lang`` and ``tok_id``.

    The closed-class lexicon is a fixed table: one hash probe a token gives its class and all its features.
    """
    w, lang = F.col("word"), F.col("lang")
    form = F.lower(w)
    cap = F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))
    x = words.withColumn("form", form).withColumn("cap", cap).withColumn("key", F.concat(lang, F.lit("|"), form))
    x = x.join(F.broadcast(closed_class(words.sparkSession)), F.col("key") == F.col("lx_key"), "left")
    form, lx = F.col("form"), lambda name: F.col(f"lx_{name.lower()}")
    rule = (F.when(form.isNull(), F.lit(None).cast("int")).when(lx("upos").isNotNull(), F.lit(0))
            .when(F.col("cap") & (F.col("tok_id") > 0), F.lit(90)))
    for i, (pat, _, _) in enumerate(L.SUFFIX_RULES, start=1):
        rule = rule.when(_ends_any(form, pat), F.lit(i))
    rule = rule.when(F.length(form) >= L.NOUN_MIN_LETTERS, F.lit(98)).otherwise(F.lit(99))
    # generators of one row: rule and class are worked out once a token, no filter or projection above copies their expressions
    x = x.select("*", F.explode(F.array(rule)).alias("rule"))
    rule = F.col("rule")
    upos = _case([(rule.isNull(), F.lit(None).cast("string")), (rule == 0, lx("upos")), (rule == 90, F.lit("PROPN"))]
                 + [(rule == i, F.lit(u)) for i, (_, u, _) in enumerate(L.SUFFIX_RULES, start=1)]
                 + [(rule == 98, F.lit("NOUN"))]).otherwise(F.lit("X"))
    x = x.select("*", F.explode(F.array(upos)).alias("upos"))
    upos = F.col("upos")

    def feat(name: str) -> Column:
        pairs = [(rule == i, F.lit(v)) for i, (_, _, fs) in enumerate(L.SUFFIX_RULES, start=1)
                 if (v := L._parse_feats(fs).get(name))]
        return F.when(rule == 0, lx(name)).otherwise(_case(pairs) if pairs else F.lit(None).cast("string"))

    nominal = upos.isin("NOUN", "PROPN", "ADJ")
    plural = _ends_any(form, L.PLURAL_SUFFIX)
    number = F.when(rule == 0, lx("Number")).when(nominal & plural, F.lit("Plur")).when(nominal, F.lit("Sing"))
    gender = F.when(rule == 0, lx("Gender"))
    for lg, pat in L.FEM_SUFFIX.items():
        gender = gender.when(nominal & (F.col("lang") == lg) & _ends_any(form, pat), F.lit("Fem"))
    for lg, pat in L.MASC_SUFFIX.items():
        gender = gender.when(nominal & (F.col("lang") == lg) & _ends_any(form, pat), F.lit("Masc"))
    lemma = F.when(upos.isin("NOUN", "ADJ") & plural & (F.length(form) > 3),
                   F.left(form, F.length(form) - 1)).otherwise(form)
    cols = [c for c in words.columns if c != "word"]
    return x.select(
        *cols,
        form.alias("form"),
        lemma.alias("lemma"),
        stem_expr(form).alias("stem"),
        upos.alias("upos"),
        F.col("cap"),
        lx("Person").alias("person"),
        number.alias("number"),
        gender.alias("gender"),
        lx("PronType").alias("prontype"),
        feat("Tense").alias("tense"),
        feat("Mood").alias("mood"),
        feat("VerbForm").alias("verbform"),
        lx("Irregular").isNotNull().alias("irregular"),
        lx("Polarity").isNotNull().alias("neg"),
        (rule == 0).alias("stop"),
        syllables_of(form, F.col("lang")).alias("n_syll"),
        F.length(form).alias("n_char"),
    )


def syllables_of(form: Column, lang: Column) -> Column:
    """vowel groups of a form, one at least."""
    return F.when(form.isNotNull(), F.greatest(F.lit(1), F.when(lang == "es", F.regexp_count(form, F.lit(L.SYLLABLE_ES)))
                                               .otherwise(F.regexp_count(form, F.lit(L.SYLLABLE_OTHER)))))


def forms(documents: DataFrame, preprocess=None) -> DataFrame:
    """``lang, form`` of every word: the tokens without their tags."""
    s = sentences(documents, preprocess)
    return s.select("lang", F.explode(T.words_of(F.col("raw"))).alias("word")).select("lang", F.lower("word").alias("form"))


def tokens(documents: DataFrame, preprocess=None) -> DataFrame:
    """One tagged row per word of every kept sentence."""
    s = sentences(documents, preprocess)
    w = s.select("doc_id", "lang", "para_id", "sent_in_para", "sent_id",
                 F.posexplode_outer(T.words_of(F.col("raw"))).alias("tok_id", "word"))
    return tag(w)


def is_content(upos: Column) -> Column:
    return upos.isin(*L.CONTENT_UPOS)
