from pyspark.sql import functions as F

from conftest import docs_df
from proselens.operators import annotate as A
from proselens.operators import metrics as M


def test_structure_counts(spark):
    d = docs_df(spark, [
        (1, "en", "The cat sat. The dog ran!\nA second paragraph here."),
        (2, "en", ""),
        (3, "en", "123 456 ..."),
        (4, "es", "Hola."),
    ])
    t = A.tokens(d)
    got = {r["doc_id"]: (r["P"], r["S"], r["N"]) for r in M.doc_counts(t).collect()}
    assert got[1] == (2, 3, 10)
    assert got[2] == (0, 0, 0)
    assert got[3] == (0, 0, 0)
    assert got[4] == (1, 1, 1)


def test_tags_and_features(spark):
    d = docs_df(spark, [(1, "en", "She quickly walked into the nation. Paris was walking")])
    rows = {r["form"]: r for r in A.tokens(d).collect()}
    assert rows["she"]["upos"] == "PRON" and rows["she"]["person"] == "3" and rows["she"]["gender"] == "Fem"
    assert rows["quickly"]["upos"] == "ADV"
    assert rows["walked"]["upos"] == "VERB" and rows["walked"]["tense"] == "Past"
    assert rows["into"]["upos"] == "ADP" and rows["into"]["stop"]
    assert rows["nation"]["upos"] == "NOUN"
    assert rows["walking"]["verbform"] == "Ger"
    assert rows["was"]["irregular"] and rows["was"]["tense"] == "Past"
    # capitalised first word of a sentence is not a proper noun; 'paris' is sentence-initial here
    assert rows["paris"]["upos"] != "PROPN"


def test_syllables(spark):
    d = docs_df(spark, [(1, "es", "casa ñ"), (2, "en", "beautiful rhythm")])
    got = {(r["doc_id"], r["form"]): r["n_syll"] for r in A.tokens(d).collect()}
    assert got[(1, "casa")] == 2
    assert got[(1, "ñ")] == 1          # no vowel: at least one
    assert got[(2, "beautiful")] == 3  # eau, i, u
    assert got[(2, "rhythm")] == 1     # y


def test_descriptive_golden(spark):
    # sentences of 2 and 4 words in one paragraph; then one paragraph of 3 words
    d = docs_df(spark, [(1, "en", "Red cat. Blue dogs run fast.\nGreen birds fly.")])
    r = M.c_descriptive(d).first()
    assert r["DESPC"] == 2 and r["DESSC"] == 3 and r["DESWC"] == 9
    assert abs(r["DESPL"] - 1.5) < 1e-12 and abs(r["DESPLd"] - 0.5) < 1e-12
    assert abs(r["DESSL"] - 3.0) < 1e-12
    assert abs(r["DESSLd"] - (2 / 3) ** 0.5) < 1e-12  # lengths 2, 4, 3
    assert abs(r["DESWLlt"] - (3 + 3 + 4 + 4 + 3 + 4 + 5 + 5 + 3) / 9) < 1e-12


def test_null_rule_empty_document(spark):
    d = docs_df(spark, [(1, "en", ""), (2, "en", "word")])
    for fn in (M.c_descriptive, M.m_lexical_diversity, M.m_syntax):
        rows = {r["doc_id"]: r for r in fn(d).collect()}
        assert set(rows) == {1, 2}
        assert all(v == 0.0 for k, v in rows[1].asDict().items() if k != "doc_id")


def test_permutation_invariance(spark):
    rows = [(i, "en", f"The text number {i}. It has words and more words.") for i in range(20)]
    a = M.m_descriptive(docs_df(spark, rows)).orderBy("doc_id").collect()
    b = M.m_descriptive(docs_df(spark, list(reversed(rows))).repartition(3)).orderBy("doc_id").collect()
    assert a == b


def test_tag_rule_is_not_copied_by_filters(spark):
    from proselens.operators import annotate as A
    docs = spark.createDataFrame([(1, "en", "A cat runs.")], "doc_id long, lang string, text string")
    t = A.tokens(docs).where(A.is_content(F.col("upos")) & F.col("number").isNotNull()).select("doc_id", "upos", "number", "lemma")
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("iendo") == 1, plan


def test_matrix_job_caches_no_token_rows(spark, monkeypatch, tmp_path):
    from proselens.plans import jobs
    spark.createDataFrame([(1, "A cat runs. It sees a house.", "en")], "doc_id long, text string, lang string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def refused(*_):
        raise AssertionError("token rows cached")
    monkeypatch.setattr(type(spark.range(1)), "persist", refused)
    assert jobs.compute_and_save_metrics(spark, str(tmp_path)).count() == 1
