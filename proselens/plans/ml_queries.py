"""Registered learning queries (L1-L21, S7, S8, O3): those without oracle SQL are checked on rows only.

They read the labelled feature table written by ``jobs.compute_and_save_metrics``
(derived from ``documents`` and ``labels``) and the ``embeddings`` table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import groups as G
from ..operators import binned as BN
from ..operators import boosting as BO
from ..operators import evaluate as E
from ..operators import models as ML
from ..operators import nodes as NT
from ..session import new_path, table_path
from ..sources import corpus as CO
from ..sources import io as IO
from . import jobs

C = F.col
MODELS = ("gbt", "svm", "lr")


def _features(spark, sf_dir):
    return jobs.feature_table(spark, sf_dir)


def _rows(spark, rows, schema=ML.RESULT_SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _family_run(spark, sf_dir, family, models, group=None):
    t = _features(spark, sf_dir)
    cols = G.metrics_of(family, group)
    name = family if group is None else f"{family}_{group.lower()}"
    return ML.train_models(name, t, cols, models=models)


def q_train_lr(spark, sf_dir):
    return _rows(spark, _family_run(spark, sf_dir, "coh_metrix", ("lr",)))


def q_train_svm(spark, sf_dir):
    return _rows(spark, _family_run(spark, sf_dir, "coh_metrix", ("svm",)))


def q_train_rf(spark, sf_dir):
    return _rows(spark, _family_run(spark, sf_dir, "multiazter", ("rf",)))


def q_train_svm_random(spark, sf_dir):
    return _rows(spark, _family_run(spark, sf_dir, "multiazter", ("svm_random",)))


def q_train_gbt_small(spark, sf_dir):
    """Boosted trees under random search (10 candidates), family M."""
    return _rows(spark, _family_run(spark, sf_dir, "multiazter", ("gbt_small",)))


def q_train_gbt(spark, sf_dir):
    """L1: boosted trees over the full grid (96 candidates), family C."""
    return _rows(spark, _family_run(spark, sf_dir, "coh_metrix", ("gbt",)))


def q_train_models(spark, sf_dir):
    """One run over all metrics of family C, the three models."""
    return _rows(spark, _family_run(spark, sf_dir, "coh_metrix", MODELS))


def q_train_families(spark, sf_dir):
    """A run per family."""
    runs = [(fam, G.metrics_of(fam, None)) for fam in ("coh_metrix", "multiazter")]
    return _rows(spark, ML.train_runs(runs, _features(spark, sf_dir), MODELS))


def q_train_groups(spark, sf_dir):
    """A run per metric group of both families (8 + 9 runs) on one cached feature table."""
    t = _features(spark, sf_dir).cache()
    runs = [(f"{fam}_{g.lower()}", G.metrics_of(fam, g)) for fam in ("coh_metrix", "multiazter") for g in G.groups_of(fam)]
    rows = ML.train_runs(runs, t, MODELS)
    t.unpersist()
    return _rows(spark, rows)


def q_grid_search(spark, sf_dir):
    """L4: mean validation and training score of every logistic-regression candidate."""
    t = ML.compact(ML.prepare(_features(spark, sf_dir), G.metrics_of("coh_metrix")))
    best = ML.linear_searches(t.where(C("split") == "train"), {"lr": ML.lr_candidates()})["lr"]
    rows = [(i, float(c["C"]), *m) for i, (c, m) in enumerate(zip(ML.lr_candidates(), best.means))]
    return spark.createDataFrame(rows, "candidate int, C double, mean_score double, mean_train_score double")


def q_random_search(spark, sf_dir):
    """The sampled random-forest candidates and their mean fold scores."""
    t = ML.compact(ML.prepare(_features(spark, sf_dir), G.metrics_of("multiazter")))
    cands = ML.rf_candidates()
    best = ML.forest_search(t.where(C("split") == "train"), cands)
    rows = [(i, {k: str(v) for k, v in c.items()}, m[0]) for i, (c, m) in enumerate(zip(cands, best.means))]
    return spark.createDataFrame(rows, "candidate int, params map<string,string>, mean_score double")


def _stored_models(spark, sf_dir):
    """The run of family C readability: its three models, each stored as a table."""
    t = _features(spark, sf_dir)
    cols = G.metrics_of("coh_metrix", "READABILITY")
    store = new_path(spark, "models")
    rows = ML.train_models("coh_metrix_readability", t, cols, models=MODELS, store=store)
    return t, cols, {r[1]: f"{store}/coh_metrix_readability_{r[1]}" for r in rows}, rows


def q_model_store(spark, sf_dir):
    """The stored search as it is read back, with the scores of its run."""
    _, _, paths, rows = _stored_models(spark, sf_dir)
    scores = next(r for r in rows if r[1] == "lr")
    return spark.read.schema(ML.LINEAR_SCHEMA).parquet(paths["lr"]).select(
        F.lit(scores[0]).alias("run"), F.size("w").alias("n_weights"), C("params")["C"].alias("c"), "cv",
        F.lit(scores[2]).cast("double").alias("train_score"), F.lit(scores[3]).cast("double").alias("test_score"))


def q_predict(spark, sf_dir):
    """The stored models loaded; a prediction of each for every labelled document."""
    t, cols, paths, _ = _stored_models(spark, sf_dir)
    return functools.reduce(DataFrame.unionByName, (
        ML.predict(paths[m], t, cols).select("doc_id", F.lit(m).alias("model"), "prediction") for m in MODELS))


TREE = BO.Run(depth=2, rate=0.3, rounds=1)


def q_predict_trees(spark, sf_dir):
    """L12 + S8: one boosted tree of all vectors (class 1: label >= 5), stored, read back, and walked for every vector."""
    e = spark.read.parquet(table_path(sf_dir, "embeddings")).select("vec_id", C("embedding").cast("array<double>").alias("x"),
                                                                   (C("label") >= 5).cast("int").alias("label"))
    rows = BN.BinnedRows(e.withColumn("fold", F.lit(0)), key="vec_id")
    try:
        (trees,), _ = BO.BoostSearch(None, rows=rows).grow([TREE])
    finally:
        rows.close()
    path = f"{new_path(spark, 'models')}/tree"
    ML.TreeModel("boosted", NT.node_rows(trees, rows.edges, None), {"maxDepth": TREE.depth}, 0.0, [], trees).save(spark, path)
    score = NT.score(NT.read_nodes(spark.read.parquet(path)), C("x"), TREE.depth)
    return e.select("vec_id", score.alias("score"), NT.prediction(score, "boosted", 1).alias("prediction"))


def q_sink_results(spark, sf_dir):
    """Result rows of the readability runs of both families, written partitioned by run and read back."""
    runs = [(f"{fam}_readability", G.metrics_of(fam, "READABILITY")) for fam in ("coh_metrix", "multiazter")]
    rows = ML.train_runs(runs, _features(spark, sf_dir), MODELS)  # one feature table, all trees grown together
    path = new_path(spark, "results")
    IO.sink_results(_rows(spark, rows), path)
    return spark.read.parquet(path)


def _emb_table(spark, sf_dir, family: str | None, group: str | None = None) -> DataFrame:
    """Embeddings (``vec_id`` taken as ``doc_id``, synthetic pairing) + metric columns + labels."""
    emb = spark.read.parquet(table_path(sf_dir, "embeddings")).select(
        C("vec_id").alias("doc_id"), C("embedding").cast("array<double>").alias("e"))
    t = _features(spark, sf_dir)
    cols = G.metrics_of(family, group) if family else []
    m = t.select("doc_id", "label", "split", F.array(*[C(c) for c in cols]).alias("m"))
    return emb.join(m, "doc_id").select("doc_id", "label", "split", F.concat("e", "m").alias("x"))


def q_train_embedding_metrics(spark, sf_dir):
    """Embeddings + family M; boosted trees, forest and SVM under random search, best params and CV score."""
    t = _emb_table(spark, sf_dir, "multiazter")
    rows = ML.train_models("berta_multiazter", t, array_col="x", models=("gbt_small", "rf", "svm_random"),
                           with_best=True)
    return _rows(spark, rows, ML.RESULT_SCHEMA_BEST)


def _network(spark, sf_dir, family, group, epochs, patience):
    return ML.train_mlp(_emb_table(spark, sf_dir, family, group), "x", epochs=epochs, patience=patience)


def _split_scores(spark, run, scored):
    s = {r["split"]: float(r["macro_f1"]) for r in E.macro_f1(scored, by=["split"]).collect()}
    return _rows(spark, [(run, "mlp", s.get("train"), s.get("test"))])


def _history(spark, run, network):
    return spark.createDataFrame([(run, e, float(t), float(v)) for e, t, v in network.history],
                                 "run string, epoch int, train_loss double, loss double")


def q_train_mlp(spark, sf_dir):
    """The losses of every epoch on embeddings + extra features (family C descriptive), early stopping."""
    network, _ = _network(spark, sf_dir, "coh_metrix", "DESCRIPTIVE", 100, 5)
    return _history(spark, "berta_descriptive", network)


def q_train_embedding_extra(spark, sf_dir):
    """Macro-F1 of the network of L10 on both splits."""
    return _split_scores(spark, "berta_descriptive", _network(spark, sf_dir, "coh_metrix", "DESCRIPTIVE", 100, 5)[1])


def q_train_mlp_fixed(spark, sf_dir):
    """The losses of 20 epochs on embeddings + family M, no early stopping."""
    network, _ = _network(spark, sf_dir, "multiazter", None, 20, None)
    return _history(spark, "berta_multiazter", network)


def q_train_embedding_metrics_mlp(spark, sf_dir):
    """Macro-F1 of the network of L11 on both splits."""
    return _split_scores(spark, "berta_multiazter", _network(spark, sf_dir, "multiazter", None, 20, None)[1])


N_EPOCHS = 40


def q_early_stop_epoch(spark, sf_dir):
    """O3 over histories made from the documents: run = language, epoch = doc_id mod 40, loss = mean length."""
    d = spark.read.parquet(table_path(sf_dir, "documents"))
    h = d.groupBy(C("lang").alias("run"), (C("doc_id") % N_EPOCHS).cast("int").alias("epoch")).agg(F.avg("n_chars").alias("loss"))
    return E.early_stop_epoch(h, patience=5)


def _labelled_docs(spark, sf_dir):
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    return docs.join(CO.labels(spark, sf_dir), "doc_id")


def q_embed_documents(spark, sf_dir):
    """L19 with the built-in encoder, every document."""
    docs = CO.read_documents(spark, sf_dir)
    v = ML.embed_documents(docs)
    return v.select("doc_id", F.size(ML.vector_to_array("vec")).alias("dim"),
                    F.aggregate(ML.vector_to_array("vec"), F.lit(0.0), lambda a, x: a + x * x).alias("norm2"))


def q_train_text_classifier(spark, sf_dir):
    """TF-IDF + logistic regression trained on the training split; macro-F1 per split."""
    lab = _labelled_docs(spark, sf_dir)
    model = ML.train_text_classifier(lab.where(C("split") == "train"))
    return ML.score_classifier(model, lab)


def q_score_classifier(spark, sf_dir):
    """Vectors of L19 + logistic regression, argmax of raw scores, macro-F1 per split."""
    from pyspark.ml.classification import LogisticRegression
    lab = _labelled_docs(spark, sf_dir)
    v = ML.embed_documents(lab.select("doc_id", "text")).join(lab.select("doc_id", "label", "split"), "doc_id")
    v = v.withColumn("label", C("label").cast("double"))
    lr = LogisticRegression(featuresCol="vec", labelCol="label", regParam=0.01, maxIter=200)
    model = lr.fit(v.where(C("split") == "train"))
    s = model.transform(v).select("split", C("label").cast("int").alias("label"),
                                  E.argmax_label(ML.vector_to_array("rawPrediction")).alias("prediction"))
    return E.macro_f1(s, by=["split"])


def q_train_svm_l1(spark, sf_dir):
    """Squared-hinge SVM with L1 and with L2 penalty (C = 1) on family C descriptive."""
    t = _features(spark, sf_dir)
    cols = G.metrics_of("coh_metrix", "DESCRIPTIVE")
    d = t.select("doc_id", "label", "split", F.array(*[C(c).cast("double") for c in cols]).alias("x")).cache()
    rows = []
    for pen in ("l1", "l2"):
        p = ML.train_svm_l1(d.where(C("split") == "train"), "x", C_=1.0, penalty=pen).transform(d)
        f = {r["split"]: float(r["macro_f1"]) for r in E.macro_f1(p, by=["split"]).collect()}
        rows.append(("coh_metrix_descriptive", f"svm_{pen}", f.get("train"), f.get("test")))
    d.unpersist()
    return _rows(spark, rows)


QUERIES = {
    "train_svm_l1": q_train_svm_l1,
    "train_gbt": q_train_gbt, "train_gbt_small": q_train_gbt_small, "train_lr": q_train_lr, "train_svm": q_train_svm, "train_rf": q_train_rf,
    "train_svm_random": q_train_svm_random, "grid_search": q_grid_search, "random_search": q_random_search,
    "train_models": q_train_models, "train_families": q_train_families, "train_groups": q_train_groups,
    "model_store": q_model_store, "predict": q_predict, "predict_trees": q_predict_trees, "sink_results": q_sink_results,
    "train_embedding_metrics": q_train_embedding_metrics, "train_mlp": q_train_mlp,
    "train_embedding_extra": q_train_embedding_extra, "train_mlp_fixed": q_train_mlp_fixed,
    "train_embedding_metrics_mlp": q_train_embedding_metrics_mlp, "early_stop_epoch": q_early_stop_epoch,
    "embed_documents": q_embed_documents, "train_text_classifier": q_train_text_classifier,
    "score_classifier": q_score_classifier,
}

#: the best split of each group of vectors ("node"): cuts in order of feature and bin, sums of gradients and Hessians left of them
_BEST = """SELECT node, arg_max({{'f': f, 'c': c, 'gl': gl, 'hl': hl}}, (gain, -f, -c)) AS s, any_value(gt) AS gt, any_value(ht) AS ht FROM (
  SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM (
    SELECT node, f, c, sum(CASE WHEN b <= c THEN g ELSE 0 END) AS gl, sum(CASE WHEN b <= c THEN 0.25 ELSE 0 END) AS hl, sum(g) AS gt, sum(0.25) AS ht
    FROM {rows}, (SELECT unnest(range(0, 63)) AS c) GROUP BY node, f, c))
  WHERE hl >= 1 AND ht - hl >= 1 AND gain > 1e-6 GROUP BY node"""

ORACLE = {
    "predict_trees": f"""
WITH e AS (SELECT vec_id, 0.5 - (label >= 5)::INT::DOUBLE AS g, generate_subscripts(embedding, 1) - 1 AS f, unnest(embedding)::DOUBLE AS v FROM embeddings),
r AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS n FROM e),
edge AS (SELECT DISTINCT r.f, r.v AS x FROM r, (SELECT unnest(range(1, 64)) AS k) WHERE rn = ceil(k * n / 64.0)),
b AS (SELECT e.vec_id, e.g, e.f, 0 AS node, count(edge.x) AS b FROM e LEFT JOIN edge ON edge.f = e.f AND edge.x <= e.v GROUP BY ALL),
one AS ({_BEST.format(rows="b")}),
side AS (SELECT b.vec_id, CASE WHEN one.node IS NULL THEN 0 WHEN b.b <= one.s.c THEN 1 ELSE 2 END AS node
         FROM b LEFT JOIN one ON b.node = one.node WHERE b.f = coalesce(one.s.f, 0)),
b2 AS (SELECT b.vec_id, b.g, b.f, side.node, b.b FROM b JOIN side USING (vec_id) WHERE side.node > 0),
two AS ({_BEST.format(rows="b2")}),
leaf AS (SELECT side.vec_id, side.node, CASE WHEN two.node IS NULL THEN 0 WHEN (SELECT b.b FROM b WHERE b.vec_id = side.vec_id AND b.f = two.s.f) <= two.s.c THEN 1 ELSE 2 END AS part
         FROM side LEFT JOIN two ON side.node = two.node),
total AS (SELECT node, part, -0.3 * sum(0.5 - (label >= 5)::INT::DOUBLE) / (count(*) * 0.25 + 1) AS score FROM leaf JOIN embeddings USING (vec_id) GROUP BY node, part)
SELECT vec_id, round(score, 6) AS score, (score > 0)::INT AS prediction FROM leaf JOIN total USING (node, part)""",
    "early_stop_epoch": f"""
WITH h AS (SELECT lang AS run, (doc_id % {N_EPOCHS})::INT AS epoch, avg(n_chars) AS loss FROM documents GROUP BY 1, 2),
b AS (SELECT *, min(loss) OVER w AS best FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)),
l AS (SELECT *, max(CASE WHEN loss <= best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last_best FROM b),
s AS (SELECT run, min(epoch) AS stop FROM l WHERE epoch - last_best >= 5 GROUP BY run),
k AS (SELECT l.* FROM l LEFT JOIN s USING (run) WHERE s.stop IS NULL OR epoch <= s.stop)
SELECT run, arg_min(epoch, (loss, epoch)) AS best_epoch, round(min(loss)::DOUBLE, 6) AS best_loss, max(epoch) AS last_epoch
FROM k GROUP BY run""",
}
