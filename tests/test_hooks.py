import math

import pytest
from pyspark.sql import functions as F

from proselens.operators import hooks as H
from proselens.operators import metrics as M


def docs(spark):
    return spark.createDataFrame([(1, "en", "One two three. Four five!"), (2, "en", ""), (3, "en", None)],
                                 "doc_id long, lang string, text string")


def test_registered_metric_over_shared_frames(spark):
    H.register_metric("words_per_form", "USER", lambda: F.col("N") / F.col("V"), ("doc", "form"))
    H.register_metric("double_words", "USER", lambda: F.col("N") * 2)
    got = {r.doc_id: r for r in H.user_metrics(docs(spark)).collect()}
    assert got[1].words_per_form == 1.0 and got[1].double_words == 10.0 and got[2].words_per_form == 0.0
    with pytest.raises(ValueError):
        H.register_metric("bad", "USER", lambda: F.lit(1), ("nothing",))


def test_preprocess_reaches_every_frame(spark):
    strip = lambda c: F.regexp_replace(c, "Four five!", "")
    got = {r.doc_id: r for r in M.c_descriptive(docs(spark), preprocess=strip).collect()}
    assert got[1].DESWC == 3.0 and got[1].DESSC == 1.0
    syntax = {r.doc_id: r.num_punct_marks_per_sentence for r in M.m_syntax(M.cleaned(docs(spark), strip)).collect()}
    assert syntax[1] == 1.0


def test_external_analyzer(spark):
    def analyzer():
        return lambda texts: [{"chars": len(t), "odd": None if not t else float("nan")} for t in texts]
    got = {r.doc_id: r for r in H.external_metrics(docs(spark), analyzer, ["chars", "odd", "missing"], batch=2).collect()}
    assert got[1].chars == 25.0 and math.isnan(got[1].odd) and got[3].odd == got[3].missing == 0.0
    with pytest.raises(Exception, match="results for"):
        H.external_metrics(docs(spark), lambda: lambda texts: [], ["chars"]).collect()


def test_analyzer_as_a_table_function(spark):
    def analyzer():
        return lambda texts: [{"chars": len(t), "odd": None if not t else float("nan")} for t in texts]
    function = H.register_analyzer(spark, "analyze_here", analyzer, ["chars", "odd", "missing"], batch=2)
    d = docs(spark).select("doc_id", "text", F.lit("x").alias("extra"))
    d.createOrReplaceTempView("some_docs")
    want = sorted(map(str, H.external_metrics(docs(spark), analyzer, ["chars", "odd", "missing"]).collect()))
    for found in (spark.sql("SELECT * FROM analyze_here(TABLE(some_docs))"), function(d.asTable()),
                  spark.sql("SELECT * FROM analyze_here(TABLE(some_docs) PARTITION BY doc_id)")):
        assert sorted(map(str, found.collect())) == want
    assert spark.sql("SELECT * FROM analyze_here(TABLE(SELECT doc_id, text FROM some_docs WHERE false))").collect() == []
    H.register_analyzer(spark, "analyze_wrong", lambda: lambda texts: [], ["chars"])
    with pytest.raises(Exception, match="results for"):
        spark.sql("SELECT * FROM analyze_wrong(TABLE(some_docs))").collect()
