"""Driver contract and oracle parity on the smallest data set."""

import duckdb
import pandas as pd

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "embeddings"]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 200
    assert df.columns[0] == "doc_id" and len(df.columns) == 12


def test_oracle_keys_are_queries():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def _canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True).astype(str)


def test_oracle_parity_small(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, sql = entry_mod.queries(), entry_mod.oracle_sql()
    for k in ["c_descriptive", "m_lexical_diversity", "c_referential_cohesion", "m_word_frequency", "macro_f1"]:
        a = _canon(q[k](spark, SF).toPandas())
        b = _canon(con.execute(sql[k]).df())
        assert a.equals(b), k


def test_full_matrix_equals_per_key(spark):
    from proselens.functions import groups as G
    from proselens.operators import metrics as M
    from proselens.plans import jobs
    from proselens.sources import corpus as CO
    docs = CO.read_documents(spark, SF).where("doc_id < 40")
    full = {r["doc_id"]: r for r in jobs.full_matrix(docs).collect()}
    assert len(full) == 40 and len(next(iter(full.values()))) == 1 + len(G.group_rows())
    for fn in (M.c_descriptive, M.m_syntax):
        for r in fn(docs).collect():
            for k, v in r.asDict().items():
                assert full[r["doc_id"]][k] == v, (k, r["doc_id"])
