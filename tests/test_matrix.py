import math

from pyspark.sql import functions as F

from proselens.operators import matrix as MX
from proselens.sources import io as IO


def test_null_to_zero_keeps_nan(spark):
    df = spark.createDataFrame([(1, None, float("nan"))], "doc_id long, a double, b double")
    r = MX.null_to_zero(df, ["a", "b"]).first()
    assert r["a"] == 0.0 and math.isnan(r["b"])


def test_payload_roundtrip_and_missing_keys(spark):
    raw = spark.createDataFrame([(0, 'log\n' + IO.MARKER + '[{"a": 1.5, "b": null}, {"a": 2}]'),
                                 (1, "no marker here")], "batch long, raw string")
    recs = IO.scan_metric_payload(raw)
    wide = MX.null_to_zero(MX.map_to_wide(recs, "m", ["a", "b"], ["batch", "pos"]), ["a", "b"])
    got = sorted((r["batch"], r["pos"], r["a"], r["b"]) for r in wide.collect())
    assert got == [(0, 0, 1.5, 0.0), (0, 1, 2.0, 0.0)]


def test_row_index_consecutive(spark):
    df = spark.range(0, 500, 3).withColumnRenamed("id", "doc_id").repartition(7)
    idx = MX.row_index(df).orderBy("index").collect()
    assert [r["index"] for r in idx] == list(range(len(idx)))
    assert [r["doc_id"] for r in idx] == sorted(r["doc_id"] for r in idx)


def test_group_slicing(spark):
    gm = MX.group_map(spark, "coh_metrix")
    long = spark.createDataFrame([(1, "DESPC", 2.0), (1, "RDFHGL", 50.0)], "doc_id long, metric string, value double")
    g = MX.collect_group_metrics(MX.join_metric_group(long, gm))
    got = {r["group"]: (r["metrics"], r["n_values"]) for r in g.collect()}
    assert got["READABILITY"] == (["RDFHGL"], 1)
    assert got["DESCRIPTIVE"][0] == ["DESPC"]


def test_project_group_columns_missing_raises(spark):
    import pytest
    df = spark.createDataFrame([(1, 2.0)], "doc_id long, DESPC double")
    with pytest.raises(KeyError):
        MX.project_group_columns(df, ["DESPC", "DESSC"])


CONLLU = """# newdoc id = 7
# newpar
# sent_id = a
1-2\tdon't\t_\t_\t_\t_\t_\t_\t_\t_
1\tDo\tdo\tAUX\t_\tMood=Ind|VerbForm=Fin\t3\taux\t_\t_
2\tn't\tnot\tPART\t_\tPolarity=Neg\t3\tadvmod\t_\t_
3\trun\trun\tVERB\t_\tMood=Imp\t0\troot\t_\t_
3.1\tempty\t_\t_\t_\t_\t_\t_\t_\t_

# sent_id = b
1\tCats\tcat\tNOUN\t_\tNumber=Plur\t2\tnsubj\t_\t_
2\tsleep\tsleep\tVERB\t_\t_\t0\troot\t_\t_

# newdoc id = name
1\tA\ta\tX\t_\t_\t2\t_\t_\t_
2\tB\tb\tX\t_\t_\t1\t_\t_\t_
3\tC\tc\tX\t_\t_\t4\t_\t_\t_
4\tD\td\tX\t_\t_\t5\t_\t_\t_
5\tE\te\tX\t_\t_\t0\t_\t_\t_
"""


def test_conllu_to_metrics(spark, tmp_path):
    from proselens.operators import metrics as M
    (tmp_path / "x.conllu").write_text(CONLLU)
    t = IO.scan_annotated_tokens(spark, str(tmp_path), lang="en").cache()
    rows = sorted(((r.sent_id, r.tok_id, r.form, r.lemma, r.upos, r.head, r.neg, r.mood) for r in t.where("doc_id = 7").collect()))
    assert rows == [(0, 0, "do", "do", "AUX", 3, False, "Ind"), (0, 1, "n't", "not", "PART", 3, True, None),
                    (0, 2, "run", "run", "VERB", 0, False, "Imp"), (1, 0, "cats", "cat", "NOUN", 2, False, None),
                    (1, 1, "sleep", "sleep", "VERB", 0, False, None)]
    depth = {r.doc_id: r.mean_depth for r in IO.mean_depth(t).collect()}
    other = next(i for i in depth if i != 7)
    assert depth[7] == 2.0 and depth[other] == 3.0  # the cycle of the first two tokens does not count
    docs = spark.createDataFrame([(7, "en", "Don't run. Cats sleep."), (other, "en", "")], "doc_id long, lang string, text string")
    syntax = {r.doc_id: r for r in M.m_syntax(docs, tok=t, depth=IO.mean_depth(t)).collect()}
    assert syntax[7].mean_depth_per_sentence == 2.0 and syntax[7].mean_propositions_per_sentence == 1.0
    words = {r.doc_id: r for r in M.c_descriptive(docs, tok=t).collect()}
    assert (words[7].DESWC, words[7].DESSC, words[7].DESPC) == (5.0, 2.0, 1.0)


def _small_inputs(spark, tmp_path):
    docs = [(1, "The cat sees a house. The cat runs!", "en", "web", 35), (2, "", "de", "web", 0), (3, "Der Hund und die Katze.", "de", "book", 23)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, [1.0, 2.0], 5), (2, [3.0], 5)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_sinks_and_map_queries_return_their_whole_work(spark, tmp_path):
    from proselens.functions import groups as G
    from proselens.plans import matrix_queries as MQ
    sf = _small_inputs(spark, tmp_path)
    full = {r["doc_id"]: r.asDict() for r in MQ.full(spark, sf).collect()}
    sunk = {r["doc_id"]: r.asDict() for r in MQ.q_sink_metric_matrix(spark, sf).collect()}
    assert {k: {m: v for m, v in r.items() if m != "n_fields"} for k, r in sunk.items()} == full
    assert {r["n_fields"] for r in sunk.values()} == {147}
    assert {tuple(r) for r in MQ.q_distinct_groups(spark, sf).collect()} == {(f, g) for f, _, _, g in G.group_rows()}
    vectors = sorted(tuple(r) for r in MQ.q_sink_embeddings(spark, sf).collect())
    assert vectors == [(1, [1.0, 2.0], 5, 2), (2, [3.0], 5, 1)]
    wide = {r["doc_id"]: r.asDict() for r in MQ.q_map_to_wide(spark, sf).collect()}
    zero = {r["doc_id"]: r.asDict() for r in MQ.q_null_to_zero(spark, sf).collect()}
    for r in MQ.q_scan_metric_payload(spark, sf).collect():
        assert wide[r["doc_id"]] == r.asDict() | {"none": None} and zero[r["doc_id"]] == r.asDict() | {"none": 0.0}
    assert len(wide) == len(zero) == 3


def test_full_matrix_takes_mtld_in_batches_with_the_values_of_its_query(spark):
    from conftest import docs_df
    from proselens.operators import metrics as M
    from proselens.plans import jobs
    d = docs_df(spark, [(1, "en", "The cat saw the cat. The dog saw the cat again and the dog. " * 4), (2, "en", "One two three."), (3, "es", None), (4, "fr", "")])
    wide = jobs.full_matrix(d)
    assert "ArrowEvalPython" in wide._jdf.queryExecution().executedPlan().toString()
    want = {r["doc_id"]: r["mtld"] for r in M.m_lexical_diversity(d).select("doc_id", "mtld").collect()}
    assert want[1] > 0
    assert {r["doc_id"]: r["mtld"] for r in wide.select("doc_id", "mtld").collect()} == want
