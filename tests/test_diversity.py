import random

from pyspark.sql import functions as F

from proselens.functions import lexicon as L
from proselens.operators import metrics as M


def mtld_py(words, t=L.MTLD_THRESHOLD):
    def factors(ws):
        f, types, n = 0.0, set(), 0
        for w in ws:
            types.add(w)
            n += 1
            if len(types) / n < t:
                f, types, n = f + 1, set(), 0
        if n > 0:
            f += (1 - len(types) / n) / (1 - t)
        return f
    n = len(words)
    if n == 0:
        return None
    a, b = factors(words), factors(list(reversed(words)))
    if a == 0 or b == 0:
        return None
    return (n / a + n / b) / 2


def test_mtld_matches_plain_python(spark):
    rnd = random.Random(7)
    cases = [[rnd.choice("abcdefghij"[: rnd.randint(2, 10)]) for _ in range(rnd.randint(0, 80))] for _ in range(40)]
    cases.append(["x", "y", "z"])  # all distinct: no factor -> null
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, words array<string>")
    res = df.select("id", M.mtld_expr(F.col("words")).alias("m"), M.mtld_udf(F.col("words")).alias("u")).collect()
    got = {r["id"]: (r["m"], r["u"]) for r in res}
    for i, c in enumerate(cases):
        exp = mtld_py(c)
        for v in got[i]:
            if exp is None:
                assert v is None or v != v
            else:
                assert abs(v - exp) < 1e-9, (c, v, exp)


def test_ttr_bounds_and_self_concatenation(spark):
    from conftest import docs_df
    t = "Alpha beta gamma. Beta delta alpha epsilon."
    d = docs_df(spark, [(1, "en", t), (2, "en", t + " " + t)])
    r = {x["doc_id"]: x for x in M.base(d, None, ("doc", "form")).collect()}
    assert r[1]["V"] == r[2]["V"]
    lex = {x["doc_id"]: x for x in M.c_lexical_diversity(d).collect()}
    assert 0 < lex[1]["LDTTRa"] <= 1


def test_mtld_of_long_texts(spark):
    """Many segments, and one segment of distinct words that never closes, in time that is not quadratic."""
    rnd = random.Random(3)
    cases = [[f"w{rnd.randrange(3000)}" for _ in range(20_000)], [f"w{i}" for i in range(60_000)] + ["w1"] * 30, ["x"] * 5000]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, words array<string>")
    got = {r["id"]: r["m"] for r in df.select("id", M.mtld_expr(F.col("words")).alias("m")).collect()}
    for i, c in enumerate(cases):
        assert abs(got[i] - mtld_py(c)) < 1e-9 * got[i]


def test_mtld_runs_without_python(spark):
    from conftest import docs_df
    plan = M.m_lexical_diversity(docs_df(spark, [(1, "en", "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
