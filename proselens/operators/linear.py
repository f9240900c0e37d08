"""Linear models under cross-validated search: all candidates and folds solved together.

Every problem is ``min_w  penalty(w) + C * sum_i loss(y_i, w . x_i)`` with y in {-1, 1},
the training rows of one fold, min-max features of that fold, and

* ``logistic`` loss with the L2 penalty (intercept not penalised), or
* ``squared_hinge`` loss with the L1 or the L2 penalty (intercept penalised, as an extra
  constant feature).

All problems take one proximal Newton step at a time.  A step needs two passes over the
cached rows: one ``treeAggregate`` of gradients and Hessians of all open problems, one of
their objectives at all step sizes of the line search.  What travels is problems x features^2
numbers; the quadratic model with the L1 term is solved on the driver, exactly, by an active set
of signs.  There is no iteration cap: a problem closes when its optimality
violation is under ``tol`` of the initial one (or no step improves it any further), and a
solver that stalls far from that raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL_ROWS = -1
#: rows of a block in the cache
BLOCK = 4096
#: optimality violation against that of zero weights at which a problem is solved
TOL = 1e-5
STEPS = 0.5 ** np.arange(12)


@dataclass(frozen=True)
class Problem:
    loss: str  # logistic, squared_hinge
    penalty: str  # l1, l2
    C: float
    fold: int = ALL_ROWS  # rows of this fold are left out

    def __post_init__(self):
        if self.loss not in ("logistic", "squared_hinge") or self.penalty not in ("l1", "l2") \
                or (self.loss, self.penalty) == ("logistic", "l1"):
            raise ValueError(f"no solver for {self.loss} with {self.penalty}")


def _blocks(rows):
    """Rows (features, label, fold) as numpy blocks of bounded size."""
    part = []
    for r in rows:
        part.append(r)
        if len(part) == BLOCK:
            yield _block(part)
            part = []
    if part:
        yield _block(part)


def _block(part):
    return (np.array([r[0] for r in part], float), np.where(np.array([r[1] for r in part]) > 0, 1.0, -1.0),
            np.array([r[2] for r in part]))


def _add(a, b):
    return [x + y for x, y in zip(a, b)] if isinstance(a, list) else a + b


class LinearSearch:
    """Cached training rows ``x array<double>, label, fold`` and the scaler of every fold (A3)."""

    def __init__(self, train: DataFrame, array_col: str = "x", label: str = "label", fold: str = "fold"):
        bad = train.where(F.col(array_col).isNull() | F.exists(array_col, lambda v: v.isNull() | F.isnan(v.cast("double")))).limit(1).count()
        if bad:
            raise ValueError("features must not be null or NaN")
        self.sc = train.sparkSession.sparkContext
        self.rows = train.select(F.col(array_col).cast("array<double>"), F.col(label).cast("int"), F.col(fold).cast("int")) \
            .rdd.mapPartitions(_blocks).cache()
        folds = sorted(r[0] for r in train.select(fold).distinct().collect())

        def extremes(b):
            x, _, f = b
            return {k: (x[f != k].min(0), x[f != k].max(0)) for k in [*folds, ALL_ROWS] if (f != k).any()}

        def join(a, b):
            return {k: (np.minimum(a[k][0], b[k][0]), np.maximum(a[k][1], b[k][1])) if k in a and k in b else a.get(k, b.get(k))
                    for k in a | b}
        spread = self.rows.map(extremes).treeReduce(join)
        self.scale = {}
        for k, (lo, hi) in spread.items():
            width = np.where(hi > lo, hi - lo, 1.0)
            self.scale[k] = (lo, width)
        self.folds = [k for k in folds if k in spread]
        self.width = len(spread[ALL_ROWS][0]) + 1

    def close(self) -> None:
        self.rows.unpersist()

    def _aggregate(self, function, sent):
        """Sum of ``function(x of a fold, y, rows used, values of the fold's problems)`` over all blocks, by fold."""
        scale, held = self.scale, self.sc.broadcast(sent)

        def one(b):
            x, y, f = b
            out = {}
            for k, value in held.value.items():
                lo, width = scale[k]
                z = np.c_[(x - lo) / width, np.ones(len(x))]
                out[k] = function(z, y, f, k, value)
            return out

        def join(a, b):
            return {k: _add(a[k], b[k]) for k in a}
        result = self.rows.map(one).treeReduce(join)
        held.unpersist()
        return result

    def solve(self, problems: list[Problem], tol: float = TOL) -> np.ndarray:
        """Weights of all problems (problems x features + 1, the intercept last)."""
        m, d = len(problems), self.width
        w = np.zeros((m, d))
        hinge = np.array([p.loss == "squared_hinge" for p in problems])
        l1 = np.array([p.penalty == "l1" for p in problems])
        c = np.array([p.C for p in problems])
        ridge = np.where(l1[:, None], 0.0, np.ones((m, d)))
        ridge[~hinge, -1] = 0.0  # the intercept of the logistic model
        first, open_, rounds = np.full(m, np.nan), np.arange(m), 0

        def by_fold(index, *values):
            out = {}
            for k in sorted({problems[i].fold for i in index}):
                at = [n for n, i in enumerate(index) if problems[i].fold == k]
                out[k] = (hinge[index[at]], *(v[at] for v in values))
            return out

        def gather(index, result, shape):
            out = np.empty((len(index), *shape))
            for k, v in result.items():
                out[[n for n, i in enumerate(index) if problems[i].fold == k]] = v
            return out

        def penalty(v, index):
            return np.where(l1[index][(...,) + (None,) * (v.ndim - 2)], np.abs(v).sum(-1),
                            0.5 * (ridge[index].reshape(len(index), *(1,) * (v.ndim - 2), d) * v * v).sum(-1))

        while len(open_):
            rounds += 1
            if rounds > 2000:
                raise RuntimeError(f"no convergence of {[problems[i] for i in open_]}")
            found = self._aggregate(_derivatives, by_fold(open_, w[open_]))
            g = gather(open_, {k: v[0] for k, v in found.items()}, (d,)) * c[open_, None] + ridge[open_] * w[open_]
            h = gather(open_, {k: v[1] for k, v in found.items()}, (d, d)) * c[open_, None, None]
            h[:, np.arange(d), np.arange(d)] += ridge[open_] + 1e-9
            sub = np.where(w[open_] != 0, g + np.sign(w[open_]), np.sign(g) * np.maximum(np.abs(g) - 1, 0))
            wrong = np.abs(np.where(l1[open_][:, None], sub, g)).max(1)
            first[open_] = np.where(np.isnan(first[open_]), np.maximum(wrong, 1e-12), first[open_])
            left = wrong > tol * np.maximum(1.0, first[open_])
            open_, g, h, sub = open_[left], g[left], h[left], sub[left]
            if not len(open_):
                break
            step = _newton(w[open_], g, h, l1[open_])
            trial = w[open_][:, None] + STEPS[None, :, None] * step[:, None]
            trial = np.concatenate((w[open_][:, None], trial), axis=1)
            value = gather(open_, self._aggregate(_objectives, by_fold(open_, w[open_], step)), (len(STEPS) + 1,)) * c[open_, None]
            value += penalty(trial, open_)
            best = value[:, 1:].argmin(1)
            better = value[np.arange(len(open_)), best + 1] < value[:, 0]
            w[open_[better]] = trial[better, best[better] + 1]
            stuck = ~better  # no step improves the objective in floating point
            scale = np.maximum(1.0, first[open_])
            if (stuck & (np.abs(np.where(l1[open_][:, None], sub, g)).max(1) > 1e-3 * scale)).any():
                raise RuntimeError("the line search failed far from the optimum")
            open_ = open_[better]
        return w

    def confusion(self, problems: list[Problem], w: np.ndarray) -> np.ndarray:
        """problems x (left-out fold, training rows) x (true positive, label 1, predicted 1) counts."""
        index = {k: [i for i, p in enumerate(problems) if p.fold == k] for k in {p.fold for p in problems}}
        found = self._aggregate(_confusion, {k: (None, w[i]) for k, i in index.items()})
        out = np.zeros((len(problems), 2, 3))
        for k, v in found.items():
            out[index[k]] = v
        return out


def _used(f, k):
    return np.ones(len(f), bool) if k == ALL_ROWS else f != k


def _derivatives(z, y, f, k, value):
    hinge, w = value
    use = _used(f, k)
    z, y = z[use], y[use]
    slope, second = [], []
    for h, margin in zip(hinge, (y[:, None] * (z @ w.T)).T):  # a problem at a time
        if h:
            at = np.flatnonzero(margin < 1)  # the other rows have no loss
            own = z[at]
            slope.append((-2 * (1 - margin[at]) * y[at]) @ own)
            second.append(2.0 * (own.T @ own))
        else:
            sig = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
            own = z * np.sqrt(sig * (1 - sig))[:, None]
            slope.append((-sig * y) @ z)
            second.append(own.T @ own)
    return [np.stack(slope), np.stack(second)]


def _objectives(z, y, f, k, value):
    """Losses of every problem at its weights and at each step length: a margin is linear in the length."""
    hinge, w, step = value
    use = _used(f, k)
    z, y = z[use], y[use]
    lengths, out = np.r_[0.0, STEPS], np.empty((len(w), len(STEPS) + 1))
    for m, (a, b) in enumerate(zip((y[:, None] * (z @ w.T)).T, (y[:, None] * (z @ step.T)).T)):
        margin = a + lengths[:, None] * b
        out[m] = (np.maximum(0, 1 - margin) ** 2 if hinge[m] else np.logaddexp(0, -margin)).sum(1)
    return out


def _confusion(z, y, f, k, value):
    _, w = value
    guess, real, use = z @ w.T > 0, (y > 0)[:, None], _used(f, k)
    return np.stack([np.stack([(guess & real)[rows].sum(0), np.repeat(real[rows].sum(), len(w)), guess[rows].sum(0)], axis=1)
                     for rows in (~use, use)], axis=1).astype(float)


def _newton(w, g, h, l1):
    """The step that minimises each problem's quadratic model plus its L1 term."""
    step = np.linalg.solve(h, -g[:, :, None])[:, :, 0]
    for m in np.flatnonzero(l1):
        step[m] = _l1_step(w[m], g[m], h[m])
    return step


def _l1_step(w, g, h):
    """The step to the exact minimum of ``g s + s h s / 2 + |w + s|`` (``h`` with a small proximal term, as features may be dependent).

    An active set by signs: the model is solved on the weights that are not zero, their signs held, and the best point on the
    way there, at a change of signs or at its end, is taken.  Once these weights are at their minimum, the zero weight with
    the steepest slope joins them.  Every move lessens the model as it is computed, so the search ends.
    """
    h = h + 1e-10 * h.diagonal().max() * np.eye(len(h))
    v, slope, sign = w.copy(), g.copy(), np.sign(w)
    eps = 1e-11 * max(1.0, np.abs(g).max())  # what rounding leaves of a slope
    if sign.any():
        v, slope, sign = _on_face(w, g, h, v, slope, sign)
    while True:
        rest = np.where(sign == 0, np.abs(slope) - 1, 0.0)
        j = int(rest.argmax())
        if rest[j] <= eps:
            return v - w
        sign[j] = -np.sign(slope[j])
        last = v
        v, slope, sign = _on_face(w, g, h, v, slope, sign)
        if (v == last).all():  # nothing is gained in floating point
            return v - w


def _on_face(w, g, h, v, slope, sign):
    """Moves ``v`` to a minimum among the weights whose signs are held, zeroing those that change them."""
    def model(u):
        return g @ (u - w) + 0.5 * (u - w) @ h @ (u - w) + np.abs(u).sum()

    value = model(v)
    while True:
        at = np.flatnonzero(sign)
        own, old = h[np.ix_(at, at)], v[at]
        move = np.linalg.solve(own, -(slope[at] + sign[at]))
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(move * sign[at] < 0, -old / move, np.inf)
        stops = np.append(np.unique(reach[(reach > 0) & (reach < 1)]), 1.0)
        # the model at every stop, less that at v
        points = old + stops[:, None] * move
        points[np.abs(reach - stops[:, None]) <= 1e-15 * stops[:, None]] = 0.0
        by = points - old
        change = by @ slope[at] + 0.5 * np.einsum("si,ij,sj->s", by, own, by, optimize=True) + (np.abs(points) - np.abs(old)).sum(1)
        k = int(change.argmin())
        new = v.copy()
        new[at] = points[k]
        if not model(new) < value:
            return v, slope, np.sign(v)
        v, value = new, model(new)
        slope, sign = g + h @ (v - w), np.sign(v)
        if k == len(stops) - 1 and not (reach < 1).any() or not sign.any():
            return v, slope, sign


def f1(counts: np.ndarray) -> np.ndarray:
    """F1 of class 1 from (true positive, label 1, predicted 1) counts; 0 where the class is absent."""
    total = counts[..., 1] + counts[..., 2]
    return np.where(total > 0, 2 * counts[..., 0] / np.maximum(total, 1), 0.0)


def decision(x, scale: tuple[np.ndarray, np.ndarray], w: np.ndarray):
    """Column: the decision value of an array column under a scaler and weights."""
    lo, width = scale
    slope = w[:-1] / width
    bias = float(w[-1] - slope @ lo)
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in slope]), lambda a, b: a * b),
                       F.lit(bias), lambda s, v: s + v)
