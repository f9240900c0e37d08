"""Column-level text functions (F1-F9): all built-in Spark expressions, no Python UDF."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

ColFn = Callable[[Column], Column]


def lower_group(c: Column) -> Column:
    """lower-case a group name."""
    return F.lower(c)


def run_name(*parts: Column) -> Column:
    """compose a run name ``family_group``."""
    return F.concat_ws("_", *parts)


def split_marker(raw: Column, marker: str) -> Column:
    """text after the first occurrence of a literal marker (null when absent)."""
    pos = F.instr(raw, marker)
    return F.when(pos > 0, F.substring(raw, pos + F.lit(len(marker)), 1 << 30))


def json_to_map(js: Column) -> Column:
    """parse a JSON array of objects into ``array<map<string,double>>``."""
    return F.from_json(js, "array<map<string,double>>")


def preprocess_text(text: Column) -> Column:
    """F7 default hook: trim and collapse horizontal blanks (newlines are kept)."""
    return F.trim(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "))


def has_letter(c: Column) -> Column:
    return c.rlike(L.LETTER)


def paragraphs(text: Column) -> Column:
    """F8: paragraphs that contain a letter."""
    return F.filter(F.split(text, L.PARA_SPLIT), has_letter)


def sentences_of(par: Column) -> Column:
    """F8: sentences of one paragraph that contain a letter."""
    return F.filter(F.split(par, L.SENT_SPLIT), has_letter)


def words_of(sent: Column) -> Column:
    """F8: letter runs of a sentence (original case); group index 0 is required."""
    return F.regexp_extract_all(sent, F.lit(L.WORD), 0)


def syllables(form: Column, lang: Column) -> Column:
    """syllable count, at least 1."""
    es = F.size(F.regexp_extract_all(form, F.lit(L.SYLLABLE_ES), 0))
    other = F.size(F.regexp_extract_all(form, F.lit(L.SYLLABLE_OTHER), 0))
    return F.greatest(F.lit(1), F.when(lang == "es", es).otherwise(other))


def stem(form: Column) -> Column:
    s = F.regexp_replace(form, L.STEM_SUFFIX, "")
    return F.when(F.length(s) >= L.STEM_MIN_LETTERS, s).otherwise(form)


def punct_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(L.PUNCT))


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields null on a zero denominator (ANSI mode would raise)."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def incidence(x: Column, n_words: Column) -> Column:
    """inc(x) = 1000 * x / N."""
    return safe_div(x * F.lit(1000.0), n_words)
