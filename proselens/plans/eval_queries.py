"""Registered queries for scoring, scaling, folds and candidate selection.

Inputs are derived from the given tables: predictions of a document-length
baseline classifier (``labels`` joined with ``documents``), the ``embeddings``
vectors as a feature matrix, and threshold candidates scored per fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..session import table_path

C = F.col
K_FOLDS = 5
SEED = 42
# FIXED VALUES: length thresholds (characters) scored as candidates by the CV queries.
THRESHOLDS = (500, 1000, 2000, 4000, 8000)
HIDDEN_TOKENS = 8


def _read(spark, sf_dir, name):
    return spark.read.parquet(table_path(sf_dir, name))


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label, n_chars, p, prediction``: longer than average -> class 1."""
    lab = _read(spark, sf_dir, "labels").select("doc_id", C("quality").cast("int").alias("label"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    st = j.agg(F.avg("n_chars").alias("mu"), F.max("n_chars").alias("mx")).first()  # one row: fitted state
    mu, mx = float(st["mu"] or 0.0), float(st["mx"] or 1.0)
    return j.select("doc_id", "label", "n_chars",
                    (C("n_chars").cast("double") / F.lit(mx)).alias("p"),
                    (C("n_chars").cast("double") > F.lit(mu)).cast("int").alias("prediction"))


def q_threshold_label(spark, sf_dir):
    b = baseline_predictions(spark, sf_dir)
    return b.select("doc_id", "label", "p", E.threshold_label(C("p")).alias("prediction"))


def q_confusion_counts(spark, sf_dir):
    return E.confusion_counts(baseline_predictions(spark, sf_dir))


def q_macro_f1(spark, sf_dir):
    return E.macro_f1(baseline_predictions(spark, sf_dir))


def q_binary_f1(spark, sf_dir):
    return E.binary_f1(baseline_predictions(spark, sf_dir))


def q_accuracy(spark, sf_dir):
    return E.accuracy(baseline_predictions(spark, sf_dir))


def q_log_loss(spark, sf_dir):
    return E.log_loss(baseline_predictions(spark, sf_dir))


def _emb(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _train_rows() -> F.Column:
    return C("vec_id") % K_FOLDS != 0


def q_minmax_scale(spark, sf_dir):
    return E.minmax_scale(_emb(spark, sf_dir), "embedding", _train_rows(), "x").select("vec_id", "x")


def q_zscore_scale(spark, sf_dir):
    return E.zscore_scale(_emb(spark, sf_dir), "embedding", _train_rows(), "x").select("vec_id", "x")


def q_argmax_label(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", E.argmax_label(C("embedding")).alias("argmax"))


def q_cls_vector(spark, sf_dir):
    """The 64-dim vector viewed as 8 token states of 8 values; keep the first state."""
    e = _emb(spark, sf_dir)
    hidden = F.transform(F.sequence(F.lit(0), F.lit(HIDDEN_TOKENS - 1)),
                         lambda t: F.slice("embedding", t * HIDDEN_TOKENS + 1, HIDDEN_TOKENS))
    return e.select("vec_id", E.cls_vector(hidden).cast("array<double>").alias("cls"))


def _labels(spark, sf_dir):
    return _read(spark, sf_dir, "labels").select("doc_id", C("quality").cast("int").alias("label"))


def q_stratified_fold(spark, sf_dir):
    return E.stratified_fold(_labels(spark, sf_dir), K_FOLDS)


def q_seeded_shuffle(spark, sf_dir):
    return E.seeded_shuffle(_labels(spark, sf_dir), seed=SEED)


def threshold_scores(spark, sf_dir) -> DataFrame:
    """Per (candidate, fold): validation / training F1 of length-threshold classifiers."""
    lab = E.stratified_fold(_labels(spark, sf_dir), K_FOLDS)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cand = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(t).alias("t"))
                               for i, t in enumerate(THRESHOLDS)]))
    s = lab.join(docs, "doc_id").select("fold", "label", "n_chars", cand.alias("c"))
    s = s.select(C("c.candidate").alias("candidate"), "fold", "label",
                 (C("n_chars") > C("c.t")).cast("int").alias("prediction"))
    return E.cv_scores(s, K_FOLDS)


def q_cv_mean_score(spark, sf_dir):
    return E.cv_mean_score(threshold_scores(spark, sf_dir)).select("candidate", "mean_score")


def q_cv_train_score(spark, sf_dir):
    return E.cv_mean_score(threshold_scores(spark, sf_dir)).select("candidate", "mean_train_score")


def q_best_candidate(spark, sf_dir):
    return E.best_candidate(E.cv_mean_score(threshold_scores(spark, sf_dir))).select("candidate", "mean_score")


QUERIES = {
    "threshold_label": q_threshold_label, "confusion_counts": q_confusion_counts, "macro_f1": q_macro_f1,
    "binary_f1": q_binary_f1, "accuracy": q_accuracy, "log_loss": q_log_loss,
    "minmax_scale": q_minmax_scale, "zscore_scale": q_zscore_scale, "argmax_label": q_argmax_label,
    "cls_vector": q_cls_vector, "stratified_fold": q_stratified_fold, "seeded_shuffle": q_seeded_shuffle,
    "cv_mean_score": q_cv_mean_score, "cv_train_score": q_cv_train_score, "best_candidate": q_best_candidate,
}

# --------------------------------------------------------------------------- oracle SQL

_BASE = """WITH b0 AS (SELECT l.doc_id, l.quality::INT AS label, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
st AS (SELECT avg(n_chars) AS mu, max(n_chars) AS mx FROM b0),
b AS (SELECT doc_id, label, n_chars, n_chars::DOUBLE / st.mx::DOUBLE AS p,
             (n_chars::DOUBLE > st.mu)::INT AS prediction FROM b0, st)"""

_FOLD = (f"((row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || l.doc_id::VARCHAR), l.doc_id) - 1) % {K_FOLDS})::INT")
_CV = f"""WITH f AS (SELECT l.doc_id, l.quality::INT AS label, {_FOLD} AS fold, d.n_chars
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
cands(candidate, t) AS (VALUES {', '.join(f'({i}, {t})' for i, t in enumerate(THRESHOLDS))}),
folds(ff) AS (SELECT * FROM range({K_FOLDS})),
s AS (SELECT c.candidate, fo.ff, CASE WHEN f.fold = fo.ff THEN 'val' ELSE 'train' END AS part, f.label,
             (f.n_chars > c.t)::INT AS prediction FROM f, cands c, folds fo),
g AS (SELECT candidate, ff, part,
             CASE WHEN count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE prediction = 1) = 0 THEN 0.0
                  ELSE 2.0 * count(*) FILTER (WHERE label = 1 AND prediction = 1)
                       / (count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE prediction = 1)) END AS f1
      FROM s GROUP BY candidate, ff, part),
m AS (SELECT candidate, avg(f1) FILTER (WHERE part = 'val') AS mean_score,
             avg(f1) FILTER (WHERE part = 'train') AS mean_train_score FROM g GROUP BY candidate)"""


def _r(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


def _rl(x: str) -> str:
    return f"list_transform({x}, lambda v: round(v::DOUBLE, 6))"


_DIMS = """WITH e AS (SELECT vec_id, embedding FROM embeddings),
u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM e),
st AS (SELECT i, min(x) AS lo, max(x) AS hi, avg(x) AS mu, var_pop(x) AS var FROM u WHERE vec_id % 5 <> 0 GROUP BY i)"""

ORACLE = {
    "threshold_label": _BASE + f"\nSELECT doc_id, label, {_r('p')} AS p, (p > 0.5)::INT AS prediction FROM b",
    "confusion_counts": _BASE + "\nSELECT label, prediction, count(*) AS n FROM b GROUP BY label, prediction",
    "macro_f1": _BASE + """,
cls AS (SELECT label AS c FROM b UNION SELECT prediction FROM b),
pc AS (SELECT c, 2.0 * (SELECT count(*) FROM b WHERE label = c AND prediction = c)
            / ((SELECT count(*) FROM b WHERE label = c) + (SELECT count(*) FROM b WHERE prediction = c)) AS f1 FROM cls)
SELECT """ + _r("avg(f1)") + " AS macro_f1 FROM pc",
    "binary_f1": _BASE + "\nSELECT " + _r("CASE WHEN sum((label = 1)::INT) + sum((prediction = 1)::INT) = 0 THEN 0.0 "
                                          "ELSE 2.0 * sum((label = 1 AND prediction = 1)::INT) / "
                                          "(sum((label = 1)::INT) + sum((prediction = 1)::INT)) END") + " AS f1 FROM b",
    "accuracy": _BASE + "\nSELECT " + _r("avg((label = prediction)::INT::DOUBLE)") + " AS accuracy FROM b",
    "log_loss": _BASE + ",\nq AS (SELECT label::DOUBLE AS y, least(greatest(p, 1e-7::DOUBLE), (1.0 - 1e-7)::DOUBLE) AS q FROM b)\n"
                "SELECT " + _r("avg(-(y * ln(q) + (1.0 - y) * ln(1.0 - q)))") + " AS log_loss FROM q",
    "minmax_scale": _DIMS + "\nSELECT vec_id, " + _rl("list(CASE WHEN st.hi = st.lo THEN u.x - st.lo "
                                                      "ELSE (u.x - st.lo) / (st.hi - st.lo) END ORDER BY u.i)")
                    + " AS x FROM u JOIN st USING (i) GROUP BY vec_id",
    "zscore_scale": _DIMS + "\nSELECT vec_id, " + _rl(f"list((u.x - st.mu) / greatest(sqrt(st.var), {E.EPS_KERAS}::DOUBLE) ORDER BY u.i)")
                    + " AS x FROM u JOIN st USING (i) GROUP BY vec_id",
    "argmax_label": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS argmax FROM embeddings",
    "cls_vector": "SELECT vec_id, " + _rl(f"embedding[1:{HIDDEN_TOKENS}]") + " AS cls FROM embeddings",
    "stratified_fold": f"SELECT doc_id, quality::INT AS label, {_FOLD} AS fold FROM labels l",
    "seeded_shuffle": f"SELECT doc_id, quality::INT AS label, (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) - 1)"
                      "::BIGINT AS position FROM labels",
    "cv_mean_score": _CV + "\nSELECT candidate, " + _r("mean_score") + " AS mean_score FROM m",
    "cv_train_score": _CV + "\nSELECT candidate, " + _r("mean_train_score") + " AS mean_train_score FROM m",
    "best_candidate": _CV + "\nSELECT candidate, " + _r("mean_score") + " AS mean_score FROM m "
                      "ORDER BY mean_score DESC, candidate LIMIT 1",
}
