"""Learning operators.

A run takes a feature table ``doc_id, label, split, <feature columns>`` (or an
``array<double>`` column) and trains scaler + classifier pipelines under a
cross-validated search whose selection metric is the F1 of class 1; reported
scores are macro-F1 on the train and test rows (A6).

Linear models (logistic regression, squared-hinge SVM with L1 or L2 penalty) are
solved by ``operators.linear``: all candidates and folds of a run together, on the
min-max features of each fold (A3), with sklearn's ``C`` as it is.  Boosted trees and forests are grown by
``operators.boosting`` and ``operators.forest``, all candidates and folds together (trees do not
depend on the scaler).  Stored models are tables (S8): weights, tree nodes or network units; ``predict`` scores
them by column expressions.
"""

from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import binned as BN
from . import boosting as BO
from . import evaluate as E
from . import forest as FR
from . import linear as LN
from . import network as NW
from . import nodes as NT

C = F.col
K_FOLDS = 5
SEED = 42

# FIXED VALUES: the reference's search spaces.
GBT_GRID = {"maxDepth": list(range(2, 10)), "maxIter": list(range(50, 250, 50)), "stepSize": [0.1, 0.01, 0.05]}
SVM_GRID = {"C": list(range(1, 15, 2)), "penalty": ["l1", "l2"]}
LR_GRID = {"C": list(range(1, 15, 2))}
RF_SPACE = {"numTrees": list(range(20, 250, 10)), "impurity": ["gini", "entropy", "log_loss"],
            "featureSubsetStrategy": ["sqrt", "log2"], "maxDepth": [1, 2]}
GBT_SMALL_SPACE = {"maxDepth": [1, 2], "maxIter": list(range(20, 250, 10)), "stepSize": [0.1, 0.01, 0.05]}
RANDOM_ITER = 10
ROWS_A_TASK = 2048


def with_vector(df: DataFrame, cols: list[str] | None, array_col: str | None = None, out: str = "raw") -> DataFrame:
    """Feature columns -> one vector column (P7); NaN is an error, as in the reference."""
    if array_col is not None:
        return df.withColumn(out, array_to_vector(C(array_col)))
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def lr_candidates(grid: dict = LR_GRID) -> list[dict]:
    """L3: logistic regression, L2 penalty, grid over C."""
    return [{"loss": "logistic", "penalty": "l2", "C": c} for c in grid["C"]]


def svm_candidates(grid: dict = SVM_GRID) -> list[dict]:
    """L2 (with L9): squared-hinge SVM, grid over C and both penalties."""
    return [{"loss": "squared_hinge", "penalty": p, "C": c} for c in grid["C"] for p in grid["penalty"]]


def svm_random_candidates(n_iter: int = RANDOM_ITER, seed: int = SEED) -> list[dict]:
    """The SVM space sampled; all drawn candidates are fitted."""
    return [{"loss": "squared_hinge", "penalty": c["penalty"], "C": c["C"]} for c in random_candidates(SVM_GRID, n_iter, seed)]


def gbt_candidates(grid: dict = GBT_GRID) -> list[dict]:
    """L1: boosted trees over the full reference grid (96 candidates)."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def gbt_small_candidates(space: dict = GBT_SMALL_SPACE, n_iter: int = RANDOM_ITER, seed: int = SEED) -> list[dict]:
    """``n_iter`` candidates of the small space."""
    return random_candidates(space, n_iter, seed)


def random_candidates(space: dict, n_iter: int = RANDOM_ITER, seed: int = SEED) -> list[dict]:
    """``min(n_iter, |space|)`` candidates drawn without replacement, seeded."""
    keys = list(space)
    allc = [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]
    rnd = random.Random(seed)
    return rnd.sample(allc, min(n_iter, len(allc)))


def rf_candidates(space: dict = RF_SPACE, n_iter: int = RANDOM_ITER, seed: int = SEED) -> list[dict]:
    """Random forests under random search; ``log_loss`` impurity is entropy."""
    return random_candidates(space, n_iter, seed)


LINEAR = {"svm": svm_candidates, "lr": lr_candidates, "svm_random": svm_random_candidates}
BOOSTED = {"gbt": gbt_candidates, "gbt_small": gbt_small_candidates}
FORESTS = {"rf": rf_candidates}


@dataclass
class LinearModel:
    """A fitted linear pipeline: min-max scaler and weights (intercept last), with its search's record."""

    w: list
    lo: list
    width: list
    params: dict
    cv: float
    cv_train: float
    means: list

    def transform(self, df: DataFrame, array_col: str = "x") -> DataFrame:
        return df.withColumn("prediction", (linear_decision(C(array_col), self.lo, self.width, self.w) > 0).cast("int"))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.w, self.lo, self.width, {k: str(v) for k, v in self.params.items()}, self.cv)], LINEAR_SCHEMA) \
            .coalesce(1).write.mode("overwrite").parquet(path)


LINEAR_SCHEMA = "w array<double>, lo array<double>, width array<double>, params map<string,string>, cv double"


def linear_decision(x, lo, width, w):
    return LN.decision(x, (np.asarray(lo), np.asarray(width)), np.asarray(w))


def linear_searches(train: DataFrame, searches: dict[str, list[dict]], array_col: str = "x") -> dict[str, LinearModel]:
    """L4 for linear models: every candidate of every search on every fold in one batch, then the refits.

    ``train`` has ``label, fold`` and the features as an array.  The first candidate wins ties (O2).
    """
    search = LN.LinearSearch(train.select(array_col, "label", "fold"), array_col)
    try:
        drawn = {c: None for cands in searches.values() for c in map(_frozen, cands)}  # shared candidates once
        problems = [LN.Problem(**dict(c), fold=f) for c in drawn for f in search.folds]
        counts = search.confusion(problems, search.solve(problems))
        scores = LN.f1(counts).reshape(len(drawn), len(search.folds), 2).mean(1)
        mean = dict(zip(drawn, scores))
        best = {}
        for name, cands in searches.items():
            values = [mean[_frozen(c)][0] for c in cands]
            best[name] = (cands[int(np.argmax(values))], values)
        refits = [LN.Problem(**c) for c, _ in best.values()]
        lo, width = search.scale[LN.ALL_ROWS]
        return {name: LinearModel(w.tolist(), lo.tolist(), width.tolist(), c, float(mean[_frozen(c)][0]), float(mean[_frozen(c)][1]),
                                  [(float(mean[_frozen(x)][0]), float(mean[_frozen(x)][1])) for x in searches[name]])
                for (name, (c, _)), w in zip(best.items(), search.solve(refits))}
    finally:
        search.close()


@dataclass
class TreeModel:
    """Fitted trees as a node table, with their search's record.

    ``boosted`` trees add up to the log-odds of class 1, those of a ``forest`` vote with their shares of class 1.
    """

    kind: str  # boosted, forest
    nodes: list  # (tree, node, feature, cut, left, value)
    params: dict
    cv: float
    means: list
    trees: list

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.nodes, NT.NODE_SCHEMA)

    def transform(self, df: DataFrame, array_col: str = "x") -> DataFrame:
        return df.withColumn("prediction", NT.prediction(NT.score(self.nodes, C(array_col), self.params["maxDepth"]), self.kind, len(self.trees)))

    def save(self, spark, path: str) -> None:
        about = [F.lit(self.kind).alias("kind"), F.lit(len(self.trees)).alias("n_trees"), F.lit(self.params["maxDepth"]).alias("depth"),
                 F.create_map(*[F.lit(str(v)) for kv in self.params.items() for v in kv]).alias("params"), F.lit(self.cv).alias("cv")]
        self.table(spark).select("*", *about).coalesce(1).write.mode("overwrite").parquet(path)


def _boosted_runs(candidates: list[dict], folds: list[int], columns) -> tuple[list, list]:
    rounds: dict[tuple, set] = {}
    for c in candidates:
        rounds.setdefault((c["maxDepth"], c["stepSize"]), set()).add(c["maxIter"])
    keys = [(k, f) for k in rounds for f in folds]
    return keys, [(BO.Run(d, rate, max(rounds[d, rate]), f, columns), rounds[d, rate]) for (d, rate), f in keys]


def boosted_searches(rows: BN.BinnedRows, folds: list[int], searches: dict[str, tuple[list[dict], tuple | None]]) -> dict[str, TreeModel]:
    """L4/L5 for boosted trees: all candidates of all searches (candidates, columns or None) in one go, then the refits.

    One run for each (columns, depth, rate, fold); candidates of fewer rounds are read off at their rounds.
    """
    search = BO.BoostSearch(None, rows=rows)
    runs, marks, place = [], {}, {}
    for name, (cands, columns) in searches.items():
        for key, (run, at) in zip(*_boosted_runs(cands, folds, columns)):
            place[name, key], marks[len(runs)] = len(runs), at
            runs.append(run)
    _, counts = search.grow(runs, marks, keep=False)
    best, refits = {}, []
    for name, (cands, columns) in searches.items():
        means = []
        for c in cands:
            own = [LN.f1(counts[place[name, ((c["maxDepth"], c["stepSize"]), f)], c["maxIter"]]) for f in folds]
            means.append(tuple(float(v) for v in np.mean(own, axis=0)))
        c = cands[int(np.argmax([m[0] for m in means]))]
        best[name] = (c, means)
        refits.append(BO.Run(c["maxDepth"], c["stepSize"], c["maxIter"], columns=columns))
    out = {}
    for (name, (c, means)), run, trees in zip(best.items(), refits, search.grow(refits)[0]):
        nodes = NT.node_rows(trees, rows.edges, run.columns)
        out[name] = TreeModel("boosted", nodes, c, max(m[0] for m in means), means, trees)
    return out


def boosted_search(train: DataFrame, candidates: list[dict], array_col: str = "x") -> TreeModel:
    """One search over all features of ``train`` (``label, fold`` and the features as an array)."""
    rows = BN.BinnedRows(train.select(array_col, "label", "fold"), array_col)
    try:
        return boosted_searches(rows, _folds(train), {"": (candidates, None)})[""]
    finally:
        rows.close()


def forest_search(train: DataFrame, candidates: list[dict], array_col: str = "x", key: str = "doc_id") -> TreeModel:
    """L5/L6 for forests: one run for each (impurity, features a node, depth, fold), then the refit."""
    rows, folds = BN.BinnedRows(train.select(array_col, "label", "fold", key), array_col, key=key), _folds(train)
    try:
        def run(c, trees, fold=BN.ALL_ROWS):
            k = {"sqrt": np.sqrt, "log2": np.log2}[c["featureSubsetStrategy"]](rows.width)
            return FR.Run(trees, c["maxDepth"], "gini" if c["impurity"] == "gini" else "entropy", max(1, int(k)), fold, SEED)
        sizes: dict[FR.Run, set] = {}
        for c in candidates:
            for f in folds:
                sizes.setdefault(run(c, 0, f), set()).add(c["numTrees"])
        runs = list(sizes)
        search = FR.ForestSearch(rows)
        _, counts = search.grow([replace(r, trees=max(sizes[r])) for r in runs], {k: sizes[r] for k, r in enumerate(runs)}, keep=False)
        means = []
        for c in candidates:
            own = [LN.f1(counts[runs.index(run(c, 0, f)), c["numTrees"]]) for f in folds]
            means.append(tuple(float(v) for v in np.mean(own, axis=0)))
        best = candidates[int(np.argmax([m[0] for m in means]))]
        trees = search.grow([run(best, best["numTrees"])])[0][0]
        return TreeModel("forest", NT.node_rows(trees, rows.edges, None), best, max(m[0] for m in means), means, trees)
    finally:
        rows.close()


def _folds(train: DataFrame) -> list[int]:
    return sorted(r[0] for r in train.select("fold").distinct().collect())


def _frozen(candidate: dict) -> tuple:
    return tuple(sorted(candidate.items()))


def evaluator() -> MulticlassClassificationEvaluator:
    """A7 as the selection metric: F1 of class 1."""
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                             metricName="fMeasureByLabel", metricLabel=1.0)


def grid_search(pipeline: Pipeline, maps, train: DataFrame, parallelism: int = 4):
    """L4: k-fold search on the hash folds (W2), refit on all training rows."""
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=evaluator(),
                        foldCol="fold", numFolds=K_FOLDS, parallelism=parallelism, seed=SEED)
    return cv.fit(train)


def macro_f1_of(model, df: DataFrame) -> float | None:
    """A6 of a model on labelled rows; null without rows."""
    pred = model.transform(df).select(C("label").cast("int").alias("label"), C("prediction").cast("int").alias("prediction"))
    r = E.macro_f1(pred).first()
    return None if r is None or r["macro_f1"] is None else float(r["macro_f1"])


def prepare(table: DataFrame, cols: list[str] | None = None, array_col: str | None = None) -> DataFrame:
    """Feature table -> ``doc_id, label, split, fold, x``; exact stratified folds (W2) over the training rows."""
    x = C(array_col).cast("array<double>") if array_col else F.array(*[C(c).cast("double") for c in cols])
    t = table.select("doc_id", C("label").cast("int").alias("label"), "split", x.alias("x"))
    folds = E.stratified_fold(t.where(C("split") == "train").select("doc_id", "label"), K_FOLDS).select("doc_id", "fold")
    return t.join(folds, "doc_id", "left")


def compact(df: DataFrame) -> DataFrame:
    """Stored, cached rows in tasks of about ROWS_A_TASK: searches run many short passes over them."""
    kept = stored(df)
    parts = -(-kept.count() // ROWS_A_TASK)
    return kept.repartition(max(1, parts)).persist(StorageLevel.MEMORY_AND_DISK)


def train_models(run: str, table: DataFrame, cols: list[str] | None = None, array_col: str | None = None,
                 models: tuple = ("gbt", "svm", "lr"), parallelism: int = 4, store: str | None = None,
                 with_best: bool = False, ready: dict | None = None, prepared: DataFrame | None = None) -> list[tuple]:
    """Fit each search, optionally store it (S8), score both splits; result rows.

    ``ready`` holds models that were fitted elsewhere, on the same rows; ``prepared`` those rows, if they are kept already.
    A split without rows has a null score.
    ``parallelism`` has no effect any more: every search's candidates and folds run together.
    """
    spark = table.sparkSession
    unknown = [m for m in models if m not in LINEAR and m not in FORESTS and m not in BOOSTED]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    data = compact(prepare(table, cols, array_col)) if prepared is None else prepared
    train, test = data.where(C("split") == "train"), data.where(C("split") == "test")
    linear = [m for m in models if m in LINEAR]
    fitted = dict(ready or {}) | (linear_searches(train, {m: LINEAR[m]() for m in linear}) if linear else {})
    boosted = [m for m in models if m in BOOSTED and m not in fitted]
    if boosted:
        rows = BN.BinnedRows(train.select("x", "label", "fold"))
        try:
            fitted |= boosted_searches(rows, _folds(train), {m: (BOOSTED[m](), None) for m in boosted})
        finally:
            rows.close()
    for name in models:
        if name in FORESTS and name not in fitted:
            fitted[name] = forest_search(train, FORESTS[name]())
    out = []
    for name in models:
        best = fitted[name]
        if store:
            best.save(spark, f"{store}/{run}_{name}")
        row = (run, name, macro_f1_of(best, train), macro_f1_of(best, test))
        out.append(row + ({k: str(v) for k, v in best.params.items()}, best.cv) if with_best else row)
    if prepared is None:
        data.unpersist()
    return out


class _Vectors:
    """A ``pyspark.ml`` model on rows that hold the features as an array."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df.withColumn("raw", array_to_vector("x")))


def train_runs(runs: list[tuple[str, list[str]]], table: DataFrame, models: tuple, threads: int = 6) -> list[tuple]:
    """Runs over column subsets of one table.

    The rows are prepared and kept once, with the columns of all runs.  The boosted trees of all runs grow together over one
    binned matrix; the linear models of several runs are solved at a time (each is bound by job latency).
    """
    names = list(dict.fromkeys(c for _, cols in runs for c in cols))
    own = {name: tuple(names.index(c) for c in cols) for name, cols in runs}
    boosted = [m for m in models if m in BOOSTED]
    ready: dict[str, dict] = {name: {} for name, _ in runs}
    data = compact(prepare(table, names))
    try:
        if boosted:
            train = data.where(C("split") == "train")
            rows = BN.BinnedRows(train.select("x", "label", "fold"))
            try:
                found = boosted_searches(rows, _folds(train), {f"{name}/{m}": (BOOSTED[m](), own[name]) for name, _ in runs for m in boosted})
                ready = {name: {m: found[f"{name}/{m}"] for m in boosted} for name, _ in runs}
            finally:
                rows.close()

        def part(name):
            return data.withColumn("x", F.array(*[C("x")[i] for i in own[name]]))
        with ThreadPoolExecutor(threads) as pool:
            jobs = [pool.submit(inheritable_thread_target(table.sparkSession)(train_models), name, table, cols, models=models, ready=ready[name],
                                prepared=part(name)) for name, cols in runs]
            return [row for j in jobs for row in j.result()]
    finally:
        data.unpersist()


RESULT_SCHEMA = "run string, model string, train_score double, test_score double"
RESULT_SCHEMA_BEST = RESULT_SCHEMA + ", best_params map<string,string>, best_cv double"


def predict(model_path: str, table: DataFrame, cols: list[str] | None = None, array_col: str | None = None) -> DataFrame:
    """L12 + S8: load a stored model (linear weights, a node table, a network or a pipeline) and score a feature table."""
    spark = table.sparkSession
    x = C(array_col).cast("array<double>") if array_col else F.array(*[C(c).cast("double") for c in cols])
    t = table.select("doc_id", x.alias("x"))
    try:
        held = spark.read.parquet(model_path)
    except AnalysisException:  # a pipeline's folder holds no table of its own
        return _Vectors(PipelineModel.load(model_path)).transform(t).select("doc_id", C("prediction").cast("int").alias("prediction"))
    if "left" in held.columns:
        about = held.select("kind", "n_trees", "depth").first()
        p = NT.prediction(NT.score(NT.read_nodes(held), C("x"), about["depth"]), about["kind"], about["n_trees"])
    elif "bias" in held.columns:
        p = NW.prediction(NW.score_table(held, C("x")))
    else:
        r = held.first()
        p = (linear_decision(C("x"), r["lo"], r["width"], r["w"]) > 0).cast("int")
    return t.select("doc_id", p.alias("prediction"))


# --------------------------------------------------------------------------- L10, L11: small network

def train_mlp(table: DataFrame, array_col: str, epochs: int = 100, patience: int | None = 5, seed: int = SEED):
    """Z-score (A4, fitted on training rows) + dense 100-50 network with validation early stopping.

    Returns (network with its history, scored frame ``doc_id, split, label, p, prediction``).
    """
    mean, var = E.fit_zscore(table, array_col, C("split") == "train")
    z = E.zscore_scale(table, array_col, C("split") == "train", "z").select("doc_id", C("label").cast("int").alias("label"), "split", "z")
    z = compact(z)
    network = NW.train_network(z.where(C("split") == "train"), "z", epochs=epochs, patience=patience, seed=seed)
    network.scale = (mean, [max(v ** 0.5, E.EPS_KERAS) for v in var])
    return network, NW.score_network(z, network, "z")


# --------------------------------------------------------------------------- L19-L21: text and vectors

def embed_documents(docs: DataFrame, num_features: int = 1 << 12, encoder=None, batch: int = 1024) -> DataFrame:
    """Text -> vector per document.

    Built-in encoder: lower-cased letter runs -> ``HashingTF`` -> L2 ``Normalizer``
    (JVM side).  A user encoder ``list[str] -> 2-D array`` runs in ``mapInPandas``
    on Arrow batches, built once per task.
    """
    if encoder is None:
        tok = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\p{L}+", gaps=False, toLowercase=True)
        tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features)
        nm = Normalizer(inputCol="tf", outputCol="vec", p=2.0)
        return nm.transform(tf.transform(tok.transform(docs))).select("doc_id", "vec")

    def run(batches):
        import pandas as pd
        enc = encoder()
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i:i + batch]
                vecs = enc(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "embedding": [list(map(float, v)) for v in vecs]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, embedding array<double>")


def train_text_classifier(train: DataFrame, num_features: int = 1 << 12, reg: float = 0.01) -> PipelineModel:
    """L21 (re-aim of fine-tuning): tokens -> TF-IDF -> logistic regression."""
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\p{L}+", gaps=False),
              HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features),
              IDF(inputCol="tf", outputCol="features"),
              LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=200)]
    return Pipeline(stages=stages).fit(train.withColumn("label", C("label").cast("double")))


def score_classifier(model: PipelineModel, labelled: DataFrame) -> DataFrame:
    """Batch inference, argmax of the raw scores (P11), macro-F1 per split."""
    s = model.transform(labelled)
    s = s.select("split", C("label").cast("int").alias("label"),
                 E.argmax_label(vector_to_array("rawPrediction")).alias("prediction"))
    return E.macro_f1(s, by=["split"])


# --------------------------------------------------------------------------- L9: exact squared-hinge SVM

def train_svm_l1(train: DataFrame, array_col: str, C_: float = 1.0, penalty: str = "l1"):
    """``min_w,b  penalty(w, b) + C * sum_i max(0, 1 - y_i (w.x_i + b))^2`` on min-max features (A3).

    ``penalty`` is the L1 norm or half the squared L2 norm; the intercept is penalised too, as an extra
    constant feature.  Returns the fitted ``LinearModel``.
    """
    search = LN.LinearSearch(train.select(array_col, "label", F.lit(0).alias("fold")), array_col)
    try:
        p = {"loss": "squared_hinge", "penalty": penalty, "C": C_}
        w = search.solve([LN.Problem(**p)])[0]
        lo, width = search.scale[LN.ALL_ROWS]
        return LinearModel(w.tolist(), lo.tolist(), width.tolist(), p, float("nan"), float("nan"), [])
    finally:
        search.close()
