"""Findings on time and shuffles: plans without the exchanges and groups that grew, and the same results."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import docs_df

from proselens.operators import annotate as A
from proselens.operators import frequency as FQ
from proselens.operators import metrics as M
from proselens.operators import pairs as PR
from proselens.plans import ml_queries as QM
from proselens.session import stored
from proselens.sources import corpus as CO
from proselens.sources import io as IO

TEXT = "The dog runs. Dogs run quickly and the dog barks!\nA quick nation walked."


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_join_their_frequency_without_a_group_of_their_own(spark):
    docs = docs_df(spark, [(1, "en", TEXT), (2, "en", "the dog"), (3, "en", "...")])
    tok = A.tokens(docs)
    df = FQ.frequency_level(tok, stored(FQ.vocabulary(tok)))
    assert "doc_id, sent_id, lang, form, upos]" not in "\n".join(x.replace("#", " ").split(" ", 1)[1] for x in plan(df).splitlines() if "Aggregate" in x)
    assert plan(df).count("Aggregate [") == 2


def test_vocabulary_is_counted_without_tags(spark):
    docs = docs_df(spark, [(1, "en", TEXT), (2, None, "Le chat"), (3, "en", None)])
    a = sorted(map(str, FQ.vocabulary(A.forms(docs)).collect()))
    assert a == sorted(map(str, FQ.vocabulary(A.tokens(docs)).collect())) and len(a) > 5
    assert "lx_upos" not in plan(FQ.vocabulary(A.forms(docs)))


def test_annotated_records_are_read_without_an_exchange(spark, tmp_path):
    docs = docs_df(spark, [(k, "en", TEXT) for k in range(4)] + [(9, "en", "One.\nTwo. Three.\nFour")])
    IO.tokens_to_conllu(A.tokens(docs)).write.text(str(tmp_path / "x"))
    t = IO.scan_annotated_tokens(spark, str(tmp_path / "x"))
    assert "Window" not in plan(t)
    got = [(r.para_id, r.sent_in_para, r.sent_id, r.form) for r in t.where("doc_id = 9").orderBy("sent_id").collect()]
    assert got == [(0, 0, 0, "one"), (1, 0, 1, "two"), (1, 1, 2, "three"), (2, 0, 3, "four")]


def test_mean_depth_of_long_chains_cycles_and_nulls(spark):
    n = 3000
    rows = [(1, 0, k, k) for k in range(n)]  # a chain: each word hangs from the one before it
    rows += [(1, 1, 0, 2), (1, 1, 1, 1)]  # a cycle
    rows += [(2, 0, 0, 0), (2, 0, 0, 0), (2, 0, 1, 9), (2, 1, 0, 2), (2, 1, 1, 0), (3, 0, 0, 5), (None, 0, 0, 0)]
    t = spark.createDataFrame(rows, "doc_id long, sent_id int, tok_id int, head int")
    df = IO.mean_depth(t)
    assert "element_at" not in plan(df) and "map_from_entries" not in plan(df)
    assert {r.doc_id: r.mean_depth for r in df.collect()} == {1: float(n), 2: 1.5, 3: None, None: 1.0}
    with pytest.raises(Exception, match="two heads"):
        IO.mean_depth(spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1)], t.schema)).collect()


def test_mtld_sorts_once_for_both_directions(spark):
    text = plan(M.m_lexical_diversity(docs_df(spark, [(1, "en", TEXT)])))
    assert "reverse(" not in text


def test_large_inputs_are_dealt_by_document(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id").repartition(3 * spark.sparkContext.defaultParallelism)
    parts = CO.spread(df).rdd.glom().collect()
    assert len(parts) > 3 * spark.sparkContext.defaultParallelism
    form = M.form_level(A.tokens(CO.spread(df.selectExpr("doc_id", "'en' AS lang", "'a b' AS text"))))
    assert form._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_result_sink_reads_one_feature_table(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(QM, "_features", lambda *a: tables.append(1))
    monkeypatch.setattr(QM.ML, "train_runs", lambda runs, table, models: [(name, m, 0.5, 0.5) for name, _ in runs for m in models])
    rows = QM.q_sink_results(spark, "").collect()
    assert len(tables) == 1 and {(r.run, r.model) for r in rows} == {(f"{f}_readability", m) for f in ("coh_metrix", "multiazter") for m in QM.MODELS}


def test_pair_counts_need_no_hashes_and_no_names(monkeypatch):
    def never(*a, **k):
        raise AssertionError("called")
    words = [(1, 0, "dog", 1), (1, 1, "dog", 1), (1, 3, "cat", 1), (1, 4, "dog", 1), (2, 0, "dog", 5)]
    t = pa.table({"doc_id": [w[0] for w in words], "sent_id": [w[1] for w in words], **{c: [w[2] for w in words] for c in ("form", "lemma", "stem")},
                  "agr": ["-/-"] * len(words), "bits": pa.array([w[3] for w in words], pa.int32())})
    monkeypatch.setattr(np, "unique", never)
    assert PR._distinct(np.array([], int)).tolist() == [] and PR._distinct(np.array([3, 1, 3, 2])).tolist() == [1, 2, 3]
    got = PR._pair_batch(t, False).to_pylist()
    assert [(r["doc_id"], r["noun_all"], r["noun_adj"]) for r in got] == [(1, 3, 1), (2, 0, 0)]
