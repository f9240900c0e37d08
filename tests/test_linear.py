"""The L1 step of the linear solver is the exact minimum of its quadratic model, also of features that nearly depend on each other."""

import numpy as np
import pytest

from proselens.operators import linear as LN


def _problem(seed, n=400, d=24):
    rng = np.random.default_rng(seed)
    base = rng.random((n, 4))
    x = np.c_[base @ rng.random((4, d - 1)) + 1e-3 * rng.random((n, d - 1)), np.ones(n)]
    y = np.where(base[:, 0] + 0.3 * rng.standard_normal(n) > 0.5, 1.0, -1.0)
    return x, y


def _model(w, x, y, c):
    margin = y * (x @ w)
    at = margin < 1
    g = c * (-2 * (1 - margin[at]) * y[at]) @ x[at]
    return g, 2 * c * x[at].T @ x[at] + 1e-9 * np.eye(x.shape[1])


@pytest.mark.parametrize("seed", range(4))
def test_l1_step_is_the_exact_minimum_of_its_model(seed):
    x, y = _problem(seed)
    w = np.where(np.random.default_rng(seed).random(x.shape[1]) < 0.5, 0.0, 0.1)
    g, h = _model(w, x, y, 3.0)
    s = LN._newton(w[None], g[None], h[None], np.array([True]))[0]
    v, slope = w + s, g + h @ s
    wrong = np.where(v != 0, np.abs(slope + np.sign(v)), np.maximum(np.abs(slope) - 1, 0))
    assert wrong.max() < 1e-6 * np.abs(g).max()


def test_few_steps_on_dependent_features():
    """Newton steps of exact models: a handful, not a step for every sweep of a slow inner solver."""
    x, y = _problem(7, n=600)
    w = np.zeros(x.shape[1])

    def value(v):
        return 5.0 * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum() + np.abs(v).sum()
    for _ in range(20):
        g, h = _model(w, x, y, 5.0)
        sub = np.where(w != 0, g + np.sign(w), np.sign(g) * np.maximum(np.abs(g) - 1, 0))
        if np.abs(sub).max() < 1e-4:
            break
        s = LN._newton(w[None], g[None], h[None], np.array([True]))[0]
        w = w + min(LN.STEPS, key=lambda t: value(w + t * s)) * s
    assert np.abs(sub).max() < 1e-4
