"""Scaling, scoring, folds and candidate selection.

All are DataFrame aggregates.  Fitted statistics (per-feature min/max, mean/std)
are bounded by the number of features; they are collected once, like the state
of any fitted ``pyspark.ml`` model, and applied as literal arrays, so the data
itself never meets a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked

C = F.col
EPS_KERAS = 1e-7
CLIP = 1e-7


# --------------------------------------------------------------------------- A3, A4: scalers on array features

def _dim_stats(df: DataFrame, col: str, train: Column | None) -> DataFrame:
    src = df if train is None else df.where(train)
    return (src.select(F.posexplode(F.col(col).cast("array<double>")).alias("i", "x"))
            .groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mu"),
                              F.var_pop("x").alias("var")))


def fit_minmax(df: DataFrame, col: str, train: Column | None = None) -> tuple[list[float], list[float]]:
    rows = sorted(_dim_stats(df, col, train).select("i", "lo", "hi").collect())
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def minmax_scale(df: DataFrame, col: str, train: Column | None = None, out: str | None = None) -> DataFrame:
    """A3: ``(x - min) / (max - min)`` fitted on ``train`` rows; a constant column gives ``x - min``.

    Rows outside the training range are not clipped.
    """
    lo, hi = fit_minmax(df, col, train)
    lo_a = F.array(*[F.lit(v) for v in lo])
    rng_a = F.array(*[F.lit(h - lo_ if h != lo_ else 1.0) for lo_, h in zip(lo, hi)])
    x = F.col(col).cast("array<double>")
    scaled = F.zip_with(F.zip_with(x, lo_a, lambda a, b: a - b), rng_a, lambda a, r: a / r)
    return df.withColumn(out or col, scaled)


def fit_zscore(df: DataFrame, col: str, train: Column | None = None) -> tuple[list[float], list[float]]:
    rows = sorted(_dim_stats(df, col, train).select("i", "mu", "var").collect())
    return [r["mu"] for r in rows], [r["var"] for r in rows]


def zscore_scale(df: DataFrame, col: str, train: Column | None = None, out: str | None = None) -> DataFrame:
    """A4: ``(x - mean) / max(sqrt(var_pop), 1e-7)`` fitted on ``train`` rows."""
    mu, var = fit_zscore(df, col, train)
    mu_a = F.array(*[F.lit(v) for v in mu])
    sd_a = F.array(*[F.lit(max(v ** 0.5, EPS_KERAS)) for v in var])
    x = F.col(col).cast("array<double>")
    return df.withColumn(out or col, F.zip_with(F.zip_with(x, mu_a, lambda a, b: a - b), sd_a, lambda a, s: a / s))


# --------------------------------------------------------------------------- P9-P11

def cls_vector(hidden: Column) -> Column:
    """First-token vector of ``array<array<float>>`` hidden states."""
    return F.element_at(hidden, 1)


def threshold_label(p: Column, threshold: float = 0.5) -> Column:
    """P10: strict ``p > threshold`` as int."""
    return (p > F.lit(threshold)).cast("int")


def argmax_label(logits: Column) -> Column:
    """Index of the largest value, first wins, 0-based."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


# --------------------------------------------------------------------------- A5-A7, A10, A11

def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: list[str] | None = None) -> DataFrame:
    """A5: rows per (label, prediction); map-side combine keeps the exchange tiny."""
    by = by or []
    return pred.groupBy(*by, C(label).alias("label"), C(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def per_class_f1(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F1 per class from confusion counts: ``2 tp / (true count + predicted count)``."""
    by = by or []
    roles = F.explode(F.array(F.struct(C("label").alias("c"), F.lit(True).alias("is_true")),
                              F.struct(C("prediction").alias("c"), F.lit(False).alias("is_true"))))
    r = conf.select(*by, "label", "prediction", "n", roles.alias("r"))
    g = r.groupBy(*by, C("r.c").alias("cls")).agg(
        F.sum(F.when(C("r.is_true") & (C("label") == C("prediction")), C("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support_plus_pred"))
    return g.select(*by, "cls", F.when(C("support_plus_pred") > 0,
                                       2.0 * C("tp") / C("support_plus_pred")).otherwise(0.0).alias("f1"))


def macro_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction",
             by: list[str] | None = None) -> DataFrame:
    """Unweighted mean of per-class F1 over the union of true and predicted classes."""
    by = by or []
    f = per_class_f1(confusion_counts(pred, label, prediction, by), by)
    return f.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def binary_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction",
              by: list[str] | None = None, positive: int = 1) -> DataFrame:
    """F1 of the positive class (0 when it is neither true nor predicted)."""
    by = by or []
    y, p = C(label) == positive, C(prediction) == positive
    g = pred.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(y).alias("nt"), F.count_if(p).alias("np"))
    return g.select(*by, F.when(C("nt") + C("np") > 0, 2.0 * C("tp") / (C("nt") + C("np"))).otherwise(0.0).alias("f1"))


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A10."""
    return pred.agg(F.avg((C(label) == C(prediction)).cast("double")).alias("accuracy"))


def log_loss(pred: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Mean binary cross-entropy, probabilities clipped to [1e-7, 1 - 1e-7]."""
    q = F.least(F.greatest(C(p).cast("double"), F.lit(CLIP)), F.lit(1.0 - CLIP))
    y = C(label).cast("double")
    return pred.agg(F.avg(-(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))).alias("log_loss"))


# --------------------------------------------------------------------------- W2, O1: folds and shuffles

def hash_key(key: str, seed: int) -> Column:
    """MD5 of ``seed:key``: the same in SQL engines, without visible order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), C(key).cast("string")).cast("binary"))


def stratified_fold(df: DataFrame, k: int = 5, key: str = "doc_id", label: str = "label", seed: int = 0) -> DataFrame:
    """Exact stratified folds: position within the class in hash order, modulo ``k``.

    The sizes of a class's folds differ by at most 1.
    """
    placed = ranked(df.withColumn("_hash", hash_key(key, seed)), [C("_hash"), C(key)], "_rank", by=label)
    return placed.withColumn("fold", (C("_rank") % k).cast("int")).drop("_hash", "_rank")


def seeded_shuffle(df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """O1: ``position``, each row's place (from 0) in a seeded permutation; ties by key."""
    return ranked(df.withColumn("_hash", hash_key(key, seed)), [C("_hash"), C(key)], "position").drop("_hash")


# --------------------------------------------------------------------------- A8, A9, O2: candidates x folds

def cv_scores(scored: DataFrame, k: int) -> DataFrame:
    """Per (candidate, fold): validation and training F1 of class 1.

    ``scored`` rows: ``candidate, fold, label, prediction``.  Each row belongs to
    the validation part of its fold and to the training part of the k-1 others,
    so it is emitted k times (a parameter bound, not a data bound).
    """
    e = scored.select("candidate", "label", "prediction", "fold",
                      F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"))
    e = e.withColumn("part", F.when(C("fold") == C("f"), "val").otherwise("train"))
    f1 = binary_f1(e, by=["candidate", "f", "part"])
    return (f1.groupBy("candidate", C("f").alias("fold"))
            .agg(F.max(F.when(C("part") == "val", C("f1"))).alias("score"),
                 F.max(F.when(C("part") == "train", C("f1"))).alias("train_score")))


def cv_mean_score(cv: DataFrame) -> DataFrame:
    """Mean validation and training score per candidate."""
    return cv.groupBy("candidate").agg(F.avg("score").alias("mean_score"), F.avg("train_score").alias("mean_train_score"))


def best_candidate(means: DataFrame) -> DataFrame:
    """O2: highest mean score, the first candidate (lowest id) on ties."""
    return means.orderBy(F.desc("mean_score"), F.asc("candidate")).limit(1)


# --------------------------------------------------------------------------- O3

def early_stop_epoch(history: DataFrame, patience: int = 5, run: str = "run", epoch: str = "epoch",
                     loss: str = "loss") -> DataFrame:
    """O3: per run, the epoch whose weights are kept with early stopping on ``loss``.

    Training stops after ``patience`` epochs without a new minimum; the best epoch
    up to that point is restored.  Windows are per run (bounded by epochs).
    """
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = history.withColumn("best_so_far", F.min(loss).over(w))
    h = h.withColumn("is_best", C(loss) <= C("best_so_far"))
    h = h.withColumn("last_best", F.max(F.when(C("is_best"), C(epoch))).over(w))
    h = h.withColumn("stop", (C(epoch) - C("last_best")) >= patience)
    first_stop = h.groupBy(run).agg(F.min(F.when(C("stop"), C(epoch))).alias("stop_epoch"))
    kept = h.join(first_stop, run).where(C("stop_epoch").isNull() | (C(epoch) <= C("stop_epoch")))
    return kept.groupBy(run).agg(F.min_by(C(epoch), F.struct(C(loss), C(epoch))).alias("best_epoch"),
                                 F.min(loss).alias("best_loss"), F.max(epoch).alias("last_epoch"))
