"""What the learned operators share: the labelled sample and the held-out rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of


def remainder(id_col: str, folds: int) -> Column:
    """CRC-32 of the identifier as text, modulo ``folds``; null counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str, text_col: str,
                    folds: int = 5) -> DataFrame:
    """``_id, _y, _text`` of at most ``limit`` training rows (remainder not 0) with a 0/1 label, least hash first.

    The choice depends on identifiers only.  An identifier labelled twice counts once, with its
    greater label.  The sample's identifiers are bounded by ``limit`` and so may be broadcast.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (remainder(id_col, folds) != 0)) \
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_y")) \
        .orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return stored(rows.join(F.broadcast(chosen), "_id"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Gradient steps on a dictionary of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9 ** self.t), self.v[k] / (1 - 0.99 ** self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)
