"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are learned tables over hashed character n-grams (3 to 6 bytes, with
the word's borders) and over hashed whole words: the shrunk log-odds of label 1 given
the entry, counted over the labelled sample.  While the network is trained, a document's
own label is taken out of the counts, so that entries seen in one document only do not
look better than they are.

The network reads windows of ``WINDOW`` words that overlap by half; all windows of a
text are scored and the highest is the text's score.  It is trained on the window that
is highest for each document, by backpropagation through time.

Scoring is one pass over the documents: a task holds the tables and a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import text_of
from .learn import Adam, labelled_sample, remainder, sigmoid

WINDOW, STRIDE = 64, 32
GRAMS = (3, 4, 5, 6)
BITS = 20
HIDDEN, INPUTS = 8, 6
#: labelled rows that are counted, and those of each label that the network is trained on
SAMPLE, TRAIN_EACH = 20_000, 800
EPOCHS, RATE, SEED = 20, 0.02, 7
#: weight of the prior in the log-odds, in documents
PRIOR = 1.0
F32 = np.float32


def gram_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Word spans' first word of each text, the words' slots, and for each n the (word, slot) of all n-grams.

    A gram may reach one byte over the word at each side; that byte counts as a border.
    """
    starts, ends = K.spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    word_slot = (K.word_hashes(data, starts, ends, 1) >> np.uint64(64 - BITS)).astype(np.int32)
    if not len(starts):
        return first, word_slot, []
    # the words with one border byte before and after each, packed
    length = ends - starts + 2
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), length)
    place = np.arange(int(length.sum())) - np.repeat(begin - starts + 1, length)
    packed = data[np.clip(place, 0, len(data) - 1)].astype(np.uint32) + np.uint32(1)
    packed[begin] = packed[begin + length - 1] = 0
    grams, h = [], np.zeros(len(packed), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(packed) < n:
            break
        h = h[:len(packed) - n + 1] * np.uint32(0x01000193) + packed[n - 1:]
        if n in GRAMS:
            inside = owner[:len(h)] == owner[n - 1:]
            x = h[inside]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
            grams.append((owner[:len(h)][inside], (x >> np.uint32(32 - BITS)).astype(np.int32)))
    return first, word_slot, grams


def log_odds(pos: np.ndarray, neg: np.ndarray, rate: float) -> np.ndarray:
    return np.log((pos + PRIOR * rate) / (neg + PRIOR * (1 - rate)) * ((1 - rate) / rate)).astype(F32)


def inputs(words: int, word_slot: np.ndarray, grams: list, table: np.ndarray, word_table: np.ndarray) -> np.ndarray:
    """INPUTS numbers for each word: highest, mean and lowest n-gram value, the word's value, the highest value of
    long n-grams, and 1."""
    out = np.zeros((words, INPUTS), F32)
    out[:, 5] = 1
    if not words:
        return out
    out[:, 3] = word_table[word_slot]
    high, low = np.full(words, -9, F32), np.full(words, 9, F32)
    total, count = np.zeros(words), np.zeros(words)
    for (owner, slot), n in zip(grams, GRAMS):
        if not len(owner):
            continue
        v = table[slot]
        at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        who = owner[at]
        top = np.maximum.reduceat(v, at)
        high[who] = np.maximum(high[who], top)
        low[who] = np.minimum(low[who], np.minimum.reduceat(v, at))
        total[who] += np.add.reduceat(v, at)
        count[who] += np.diff(np.concatenate((at, [len(owner)])))
        if n >= 5:
            out[who, 4] = np.maximum(out[who, 4], top)
    some = count > 0
    out[some, 0], out[some, 2] = high[some], low[some]
    out[some, 1] = total[some] / count[some]
    return out


def windows(n: int) -> np.ndarray:
    """First words of the overlapping windows over n words; every word is in a window."""
    return np.arange(0, max(1, n - STRIDE), STRIDE)


class Network:
    """Two GRUs of HIDDEN units, attention over their states, one output."""

    def __init__(self, params: dict[str, np.ndarray] | None = None):
        if params is None:
            r = np.random.default_rng(SEED)
            params = {"v": r.normal(0, 0.3, 2 * HIDDEN), "w": r.normal(0, 0.3, 2 * HIDDEN), "b": np.array([-2.0])}
            for d in "fb":
                params |= {f"x{d}": r.normal(0, 0.3, (INPUTS, 3 * HIDDEN)), f"h{d}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))}
            params = {k: x.astype(F32) for k, x in params.items()}
        self.p = params

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: steps x windows x INPUTS; the state stands still where mask is 0."""
        steps, many, _ = x.shape
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        z_in = x.reshape(-1, INPUTS) @ self.p["x" + d]
        z_in = z_in.reshape(steps, many, 3 * HIDDEN)
        u, h = self.p["h" + d], np.zeros((many, HIDDEN), F32)
        states, saved = np.empty((steps, many, HIDDEN), F32), {}
        for t in order:
            a = h @ u
            g = z_in[t, :, :2 * HIDDEN] + a[:, :2 * HIDDEN]
            np.negative(g, out=g)
            np.clip(g, -30, 30, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            r, z = g[:, :HIDDEN], g[:, HIDDEN:]
            c = np.tanh(z_in[t, :, 2 * HIDDEN:] + r * a[:, 2 * HIDDEN:])
            new = c + z * (h - c)
            m = mask[t][:, None]
            if keep:
                saved[t] = (h, r, z, c, a[:, 2 * HIDDEN:])
            h = h + m * (new - h)
            states[t] = h
        return states, saved

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        sf, kf = self._direction(x, mask, "f", keep)
        sb, kb = self._direction(x, mask, "b", keep)
        s = np.concatenate((sf, sb), axis=2)
        e = np.tanh(s) @ self.p["v"] - (1 - mask) * 1e4
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * s).sum(axis=0)
        out = pooled @ self.p["w"] + self.p["b"][0]
        return (out, s, a, pooled, kf, kb) if keep else out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        out, s, a, pooled, kf, kb = self.forward(x, mask, True)
        d_out = (sigmoid(out) - y) * weight
        g = {"w": pooled.T @ d_out, "b": np.array([d_out.sum()], F32)}
        d_pool = d_out[:, None] * self.p["w"]
        d_a = (d_pool[None] * s).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        t = np.tanh(s)
        g["v"] = (d_e[:, :, None] * t).sum(axis=(0, 1))
        d_s = a[:, :, None] * d_pool[None] + d_e[:, :, None] * self.p["v"] * (1 - t * t)
        for d, saved, part in (("f", kf, d_s[:, :, :HIDDEN]), ("b", kb, d_s[:, :, HIDDEN:])):
            u = self.p["h" + d]
            gx, gu, dh = np.zeros_like(self.p["x" + d]), np.zeros_like(u), np.zeros((x.shape[1], HIDDEN), F32)
            steps = range(x.shape[0] - 1, -1, -1) if d == "f" else range(x.shape[0])
            for k in steps:
                h, r, z, c, ac = saved[k]
                dh = dh + part[k]
                m = mask[k][:, None]
                dn = dh * m
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * ac * r * (1 - r)
                da = np.concatenate((dr, dz, dc * r), axis=1)
                gx += x[k].T @ np.concatenate((dr, dz, dc), axis=1)
                gu += h.T @ da
                dh = dh * (1 - m) + dn * z + da @ u.T
            g["x" + d], g["h" + d] = gx, gu
        return g

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The highest window output of each text; ``x`` has the inputs of all words, ``first`` each text's first word."""
        count = np.diff(first)
        starts = [first[i] + windows(int(n)) for i, n in enumerate(count)]
        owner = np.repeat(np.arange(len(count)), [len(s) for s in starts])
        at = np.concatenate(starts) if len(starts) else np.zeros(0, np.int64)
        size = np.minimum(WINDOW, first[owner + 1] - at)
        best = np.full(len(count), -np.inf, F32)
        by = np.argsort(size, kind="stable")
        for lo in range(0, len(by), 4096):
            w = by[lo:lo + 4096]
            steps = max(1, int(size[w].max()))
            out = self.forward(*batch(x, at[w], size[w], steps))
            np.maximum.at(best, owner[w], out)
        return best


def batch(x: np.ndarray, at: np.ndarray, size: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (steps x windows x INPUTS) and mask of windows; a window without words sees zeros."""
    t = np.arange(steps)[:, None]
    mask = (t < size[None]).astype(F32)
    if not len(x):
        return np.zeros((steps, len(at), INPUTS), F32), mask
    return x[np.minimum(at[None] + t, len(x) - 1)] * mask[:, :, None], mask


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts of each label with each slot, of one task: rows (kind, label, counts)."""
    sums = np.zeros((2, 2, 1 << BITS), np.int32)
    for b in batches:
        column, ys = b.column("_text"), np.asarray(b.column("_y"))
        for lo, hi in K.slices(column):
            first, word_slot, grams = gram_slots(*K.text_buffer(column.slice(lo, hi - lo)))
            y, doc = ys[lo:hi], np.repeat(np.arange(hi - lo), np.diff(first))
            for kind, o, s in [(0, doc[o], s) for o, s in grams] + [(1, doc, word_slot)]:
                pair = np.unique(o << BITS | s)
                o, s = pair >> BITS, pair & ((1 << BITS) - 1)
                for label in (0, 1):
                    np.add.at(sums[kind, label], s[y[o] == label], 1)
    kinds, labels, slots = np.nonzero(sums)
    for at in range(0, len(slots), 1 << 16):
        k, l, s = (a[at:at + (1 << 16)] for a in (kinds, labels, slots))
        yield pa.RecordBatch.from_arrays(
            [pa.array(k * 2 + l, pa.int32()), pa.array(s, pa.int32()), pa.array(sums[k, l, s], pa.int64())],
            names=["_what", "_slot", "_n"])


class Model:
    """Tables of log-odds and the network's arrays."""

    def __init__(self, table: np.ndarray, word_table: np.ndarray, params: dict[str, np.ndarray]):
        self.table, self.word_table, self.network = table, word_table, Network(params)

    def arrays(self) -> tuple:
        return self.table, self.word_table, self.network.p

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for lo, hi in K.slices(column):
            first, word_slot, grams = gram_slots(*K.text_buffer(column.slice(lo, hi - lo)))
            x = inputs(len(word_slot), word_slot, grams, self.table, self.word_table)
            out[lo:hi] = sigmoid(self.network.scores(x, first))
        return out


def fit(sample: DataFrame) -> Model:
    """The tables and the network from ``_id, _y, _text`` rows, whose number the caller bounds."""
    found = sample.repartition(8).mapInArrow(_count, "_what int, _slot int, _n long") \
        .groupBy("_what", "_slot").agg(F.sum("_n").alias("_n")).toArrow()  # bounded by 4 * 2**BITS numbers
    sums = np.zeros((4, 1 << BITS))
    sums[np.asarray(found["_what"]), np.asarray(found["_slot"])] = np.asarray(found["_n"])
    neg, pos, word_neg, word_pos = sums
    seen = dict(sample.groupBy("_y").count().collect())
    rate = (seen.get(1, 0) + 0.5) / (seen.get(0, 0) + seen.get(1, 0) + 1)

    chosen = None
    for y in (0, 1):
        part = sample.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_EACH)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = chosen.select("_y", "_text").toArrow()  # at most 2 * TRAIN_EACH texts
    network = Network()
    if rows.num_rows:
        _train(network, rows, pos, neg, word_pos, word_neg, rate, seen)
    return Model(log_odds(pos, neg, rate), log_odds(word_pos, word_neg, rate), network.p)


def _train(network: Network, rows: pa.Table, pos, neg, word_pos, word_neg, rate: float, seen: dict) -> None:
    texts, labels = [], []
    for b in rows.to_batches(max_chunksize=64):
        column, ys = b.column("_text"), np.asarray(b.column("_y"))
        for i, y in enumerate(ys):
            first, word_slot, grams = gram_slots(*K.text_buffer(column.slice(i, 1)))
            # without this document's own label
            slots = np.unique(np.concatenate([s for _, s in grams])) if grams else np.zeros(0, np.int64)
            own = np.unique(word_slot)
            table, word_table = _Without(pos, neg, slots, y, rate), _Without(word_pos, word_neg, own, y, rate)
            texts.append(inputs(len(word_slot), word_slot, grams, table, word_table))
            labels.append(y)
    y = np.array(labels, F32)
    share = np.array([seen.get(0, 0), seen.get(1, 0)]) / max(1, sum(seen.values()))
    drawn = np.array([(y == 0).sum(), (y == 1).sum()]) / len(y)
    weight = (np.sqrt(share / np.maximum(drawn, 1e-9)))[y.astype(int)].astype(F32)
    x = np.concatenate(texts)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    spots = [first[i] + windows(len(t)) for i, t in enumerate(texts)]
    at, owner = np.concatenate(spots), np.repeat(np.arange(len(texts)), [len(s) for s in spots])
    size = np.minimum(WINDOW, first[owner + 1] - at)
    strong = np.array([x[a:a + s, 0].max() if s else 0 for a, s in zip(at, size)])
    rng, steps = np.random.default_rng(SEED), Adam(network.p, RATE)
    best = strong
    for epoch in range(EPOCHS):
        if epoch in (3, 6, 10):  # the windows that the network itself finds highest
            best = np.concatenate([network.forward(*batch(x, at[lo:lo + 4096], size[lo:lo + 4096], WINDOW))
                                   for lo in range(0, len(at), 4096)])
        steps.rate = RATE * (1 - epoch / EPOCHS)
        order = np.lexsort((best, owner))
        pick = order[np.concatenate((owner[order][1:] != owner[order][:-1], [True]))]
        turn = rng.permutation(len(pick))
        for lo in range(0, len(turn), 64):
            w = pick[turn[lo:lo + 64]]
            xs, mask = batch(x, at[w], size[w], WINDOW)
            g = network.gradients(xs, mask, y[owner[w]], weight[owner[w]] / len(w))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            steps.step({k: v * min(1, 1 / max(norm, 1e-9)) for k, v in g.items()})


class _Without:
    """Log-odds of slots, less one document of label y that holds all of them."""

    def __init__(self, pos, neg, slots, y, rate: float):
        self.slots = slots
        self.value = log_odds(np.maximum(pos[slots] - y, 0), np.maximum(neg[slots] - (1 - y), 0), rate)

    def __getitem__(self, slot: np.ndarray) -> np.ndarray:
        return self.value[np.searchsorted(self.slots, slot)]


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Labels are learned from at most ``sample`` labelled rows whose crc32(doc_id as text) mod 5 is not 0;
    the network itself from at most TRAIN_EACH of each label.  Scores use the text only.  A null or empty
    text is scored like a window without words; without labelled rows all texts get the untrained
    network's score.  Repeated rows get equal scores; a null id stays null; other columns are ignored.
    """
    spark = docs.sparkSession
    lower = docs.select(F.col(id_col), F.lower(text_of(text_col)).alias(text_col))
    model = fit(labelled_sample(lower, labels, label, sample, id_col, text_col))
    sent = spark.sparkContext.broadcast(model.arrays())  # 8 MB of tables, fixed by BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(own.score(b.column("_text")), pa.float64())],
                names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, 5) == 0).alias("held_out"),
                       F.lower(text_of(text_col)).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
