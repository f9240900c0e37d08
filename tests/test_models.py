import random

import numpy as np

from pyspark.sql import functions as F

from proselens.operators import boosting as BO
from proselens.operators import evaluate as E
from proselens.operators import linear as LN
from proselens.operators import models as ML


def separable(spark, n=200, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 2
        x = [rnd.uniform(0.6, 1.0) if y else rnd.uniform(0.0, 0.4), rnd.uniform(0, 1)]
        rows.append((i, x, y, "test" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, "doc_id long, x array<double>, label int, split string")


def test_lr_and_forest_reach_perfect_f1_on_separable_data(spark):
    t = separable(spark)
    rows = ML.train_models("toy", t, array_col="x", models=("lr", "rf"), parallelism=2)
    for run, model, tr, te in rows:
        assert te == 1.0, (model, tr, te)


def test_boosted_search(spark):
    x, y, t = noisy(spark, n=200)
    t = t.withColumn("split", F.lit("train"))
    cands = ML.gbt_candidates({"maxDepth": [1, 3], "maxIter": [3, 10], "stepSize": [0.1, 0.5]})
    best = ML.boosted_search(t, cands)
    assert len(best.trees) == best.params["maxIter"] and len(best.means) == 8
    assert best.cv == max(m[0] for m in best.means)
    assert E.macro_f1(best.transform(t)).first()["macro_f1"] > 0.75
    # a run of more rounds begins with the run of fewer rounds; scores at a mark are those of the shorter run
    search = BO.BoostSearch(t)
    runs = [BO.Run(3, 0.1, 10, 2), BO.Run(3, 0.1, 4, 2)]
    forest, counts = search.grow(runs, {0: {4, 10}, 1: {4}})
    for a, b in zip(forest[0], forest[1]):
        assert all((u == v).all() for u, v in zip(a, b))
    assert (counts[0, 4] == counts[1, 4]).all() and (counts[0, 10] != counts[0, 4]).any()
    # the first tree against a direct search over all bins
    bins, use = BO.binned(x, search.edges), np.arange(200) % 5 != 2
    g, h = 0.5 - y[use], np.full(use.sum(), 0.25)
    gains = {}
    for f in range(bins.shape[1]):
        for b in range(BO.BINS - 1):
            left = bins[use][:, f] <= b
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gains[f, b] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    root = forest[0][0][0][0], forest[0][0][1][0]
    assert abs(gains[root] - max(gains.values())) < 1e-9
    search.close()


def test_random_candidates_seeded_without_replacement():
    a = ML.random_candidates(ML.RF_SPACE, 10, 1)
    b = ML.random_candidates(ML.RF_SPACE, 10, 1)
    assert a == b and len({tuple(sorted(c.items())) for c in a}) == 10
    assert len(ML.random_candidates({"x": [1, 2]}, 10, 1)) == 2


def test_svm_l1_separable(spark):
    t = separable(spark)
    for pen in ("l1", "l2"):
        m = ML.train_svm_l1(t.where("split = 'train'"), "x", C_=10.0, penalty=pen)
        assert E.macro_f1(m.transform(t.where("split = 'test'"))).first()["macro_f1"] == 1.0
    # the L1 penalty shrinks the uninformative second feature
    m = ML.train_svm_l1(t.where("split = 'train'"), "x", C_=1.0, penalty="l1")
    assert abs(m.w[1]) < abs(m.w[0])


def noisy(spark, n=150, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.gamma(1, 4, size=d)
    x[:, -1] = 3.0  # a constant column
    y = (x[:, 0] / x[:, 0].std() + 0.5 * x[:, 1] / x[:, 1].std() + rng.normal(size=n) > 0).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]), i % 5) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "doc_id long, x array<double>, label int, fold int").repartition(3)


def test_linear_search_reaches_the_optimum(spark):
    x, y, t = noisy(spark)
    search = LN.LinearSearch(t)
    problems = [LN.Problem(loss, pen, c, f) for loss, pen in (("logistic", "l2"), ("squared_hinge", "l1"), ("squared_hinge", "l2"))
                for c in (1, 13) for f in (0, 3, LN.ALL_ROWS)]
    w = search.solve(problems, tol=1e-8)
    rng = np.random.default_rng(0)
    for p, own in zip(problems, w):
        use = np.arange(len(y)) % 5 != p.fold
        lo, hi = x[use].min(0), x[use].max(0)
        z = np.c_[(x - lo) / np.where(hi > lo, hi - lo, 1), np.ones(len(y))][use]
        s = np.where(y > 0, 1, -1)[use]

        def objective(v):
            m = s * (z @ v)
            loss = np.logaddexp(0, -m).sum() if p.loss == "logistic" else (np.maximum(0, 1 - m) ** 2).sum()
            size = np.abs(v).sum() if p.penalty == "l1" else 0.5 * (v[:-1] @ v[:-1]) + (0 if p.loss == "logistic" else 0.5 * v[-1] ** 2)
            return size + p.C * loss
        best = objective(own)
        for scale in (1e-5, 1e-3, 1e-1):
            for _ in range(60):
                assert objective(own + scale * rng.normal(size=len(own)) * (rng.random(len(own)) < 0.4)) >= best * (1 - 1e-9)
    counts = search.confusion(problems, w)
    guess = np.c_[(x - x.min(0)) / np.where(x.max(0) > x.min(0), x.max(0) - x.min(0), 1), np.ones(len(y))] @ w[2] > 0
    assert counts[2, 1].tolist() == [(guess & (y > 0)).sum(), (y > 0).sum(), guess.sum()]
    search.close()


def test_stored_model_predicts_the_same(spark, tmp_path):
    _, y, t = noisy(spark)
    t = t.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")).drop("fold")
    rows = ML.train_models("toy", t, array_col="x", models=("svm", "svm_random", "lr"), store=str(tmp_path), with_best=True)
    assert [r[1] for r in rows] == ["svm", "svm_random", "lr"] and all(0 < r[2] <= 1 and 0 < r[3] <= 1 for r in rows)
    for r in rows:
        p = ML.predict(f"{tmp_path}/toy_{r[1]}", t, array_col="x").join(t, "doc_id")
        assert abs(E.macro_f1(p.where("split = 'test'")).first()["macro_f1"] - r[3]) < 1e-12


def test_folds_are_stratified(spark):
    t = spark.createDataFrame([(i * 37 % 1009, int(i % 7 == 0)) for i in range(403)], "doc_id long, label int")
    n = {}
    for r in E.stratified_fold(t, 5).collect():
        n[r.label, r.fold] = n.get((r.label, r.fold), 0) + 1
    for label in (0, 1):
        own = [v for (k, _), v in n.items() if k == label]
        assert len(own) == 5 and max(own) - min(own) <= 1


def test_shuffle_is_a_permutation(spark):
    t = spark.range(500).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.position for r in E.seeded_shuffle(t, seed=1).collect()}
    b = {r.doc_id: r.position for r in E.seeded_shuffle(t, seed=2).collect()}
    assert sorted(a.values()) == sorted(b.values()) == list(range(500)) and a != b


def test_network_learns_and_stops_early(spark):
    from proselens.operators import network as NW
    rng = np.random.default_rng(1)
    params = NW.started(4, (5, 3), 2)
    x, y = rng.normal(size=(7, 4)), (rng.random(7) > 0.5).astype(float)
    for k, g in enumerate(NW.gradients(params, x, y)):  # backpropagation against differences
        at = tuple(0 for _ in g.shape)
        old = params[k][at]
        loss = []
        for d in (1e-6, -1e-6):
            params[k][at] = old + d
            loss.append(NW._loss(NW.probability(params, x), y) / len(y))
        params[k][at] = old
        assert abs((loss[0] - loss[1]) / 2e-6 - g[at]) < 1e-5
    t = separable(spark)
    network, scored = ML.train_mlp(t, "x", epochs=60, patience=5)
    assert E.macro_f1(scored.where("split = 'test'")).first()["macro_f1"] == 1.0
    assert scored.count() == t.count()
    values = [v for _, _, v in network.history]
    assert network.best_epoch == int(np.argmin(values)) and len(values) <= min(60, network.best_epoch + 6)
    fixed, _ = ML.train_mlp(t, "x", epochs=4, patience=None)
    assert len(fixed.history) == 4 and fixed.best_epoch == 3


def test_line_search_losses_and_slopes_are_those_of_every_trial_vector():
    """Losses at all step lengths from two products, and Hessians of the rows that have a loss, against the formulas."""
    rng = np.random.default_rng(5)
    z = np.c_[rng.uniform(size=(200, 4)), np.ones(200)]
    y, f = np.where(rng.uniform(size=200) > 0.4, 1.0, -1.0), np.arange(200) % 5
    hinge, w, step = np.array([True, False, True]), rng.normal(size=(3, 5)), rng.normal(size=(3, 5))
    found = LN._objectives(z, y, f, 2, (hinge, w, step))
    slope, second = LN._derivatives(z, y, f, 2, (hinge, w))
    a, b = z[f != 2], y[f != 2]
    for m in range(3):
        for k, length in enumerate([0.0, *LN.STEPS]):
            margin = b * (a @ (w[m] + length * step[m]))
            loss = np.maximum(0, 1 - margin) ** 2 if hinge[m] else np.log1p(np.exp(-margin))
            assert np.isclose(found[m, k], loss.sum(), rtol=1e-12)
        margin = b * (a @ w[m])
        sig = 1 / (1 + np.exp(margin))
        one = -2 * np.maximum(0, 1 - margin) if hinge[m] else -sig
        curve = 2.0 * (margin < 1) if hinge[m] else sig * (1 - sig)
        assert np.allclose(slope[m], (one * b) @ a, rtol=1e-12)
        assert np.allclose(second[m], a.T @ (a * curve[:, None]), rtol=1e-12)
