"""LM scoring: a hashed maximum-entropy model with a class-factored softmax over the whole vocabulary.

Counts: every batch of documents sends its distinct word hashes with their training
counts; buckets add them up over the corpus and answer with the totals, which give the
base score exactly, and with the word's rank by hash among the words of its class.

Model: p(word) = p(class | context) * p(word | class, context).  Every counted word belongs to the
class of its count's octave; the class is a softmax.  Inside a class of n words the softmax is
factored further: its words are halved until one is left, and each of the log2(n) halvings is a
softmax of two.  Both are maximum-entropy models over hashed context features: the previous word,
the words two and three places back (skips), the previous two words together, and a bias (inside a
class: bias, previous word and the word before it).  Any counted word can be context or target.  Words
that no training document holds share the add-one mass that the base score gives them.

Training: the texts are written once as word numbers and dealt to rounds and, by their tokens, to units; a
unit takes gradient steps from the shared parameters, and a round adds up its units' steps, each
parameter weighted by the squared gradients it has seen.  All training documents take part, once.
Nothing depends on how the input or the shuffles are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import stored, text_of
from .exchange import ask, batched, pack, unpack
from .learn import remainder

CLASSES, SIZE = 24, 24
WORDS = (CLASSES - 1) * SIZE
#: words of each class where no counts are given
SIZES = (SIZE,) * (CLASSES - 1) + (1,)
#: powers of two between which the hashed tables grow with the vocabulary: rows of the class model, slots of the word model
CLASS_BITS, WORD_BITS = (12, 14), (16, 20)
ROUNDS, RATE, MINIBATCH = 4, 0.15, 8192
#: a minibatch is so small a part of a unit's tokens, MINIBATCH at least and twice that at most; the step follows its square root
STEPS_A_UNIT = 64
#: training tokens of a unit, tokens whose features are made at a time
UNIT, CHUNK = 3_000_000, 65_536
SLICE, PIECE = 16_384, 32_768
END = np.uint64(0x5851F42D4C957F2D)
F32 = np.float32
PARAMS = (CLASSES << CLASS_BITS[0]) + (1 << WORD_BITS[0])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words with A-Z in lower case, then END for each text) and tokens of each text."""
    parts = [_tokens(column.slice(lo, hi - lo)) for lo, hi in K.slices(column)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([t for t, _ in parts]), np.concatenate([n for _, n in parts])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.text_buffer(column)
    upper = (data - np.uint8(65)) < 26
    if upper.any():
        data = data + upper.astype(np.uint8) * np.uint8(32)
    words, first = K.words_of(data, offsets, 3)
    return np.insert(words, first[1:], END), np.diff(first) + 1


def _send(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        t, n = tokens(table["_text"].combine_chunks())
        keys, where = numbered(t)
        train = np.repeat(np.asarray(table["_train"]), n)
        counts = np.bincount(where[train], minlength=len(keys)).astype(np.uint32)  # of one batch
        return pack(table["_batch"][0].as_py(), 0, keys, {"_keys": keys, "_values": counts}, buckets)

    return run


SENT = "_bucket int, _batch int, _kind int, _n int, _keys binary, _values binary"
ANSWER = "_bucket int, _batch int, _kind int, _values binary, _ranks binary"


def class_of(counts: np.ndarray) -> np.ndarray:
    """The octave of each count (1 at least), the greatest first; the first class is open above."""
    return CLASSES - np.clip(np.frexp(counts.astype(float))[1], 1, CLASSES)


def _total(table: pa.Table) -> pa.Table:
    """Answers (kind 0) to each batch, and one row (kind 1) with words and tokens of each class."""
    keys, counts = unpack(table["_keys"], np.uint64), unpack(table["_values"], np.uint32)
    distinct, where = numbered(keys)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, counts.astype(np.int64))
    klass, rank = class_of(total), np.zeros(len(distinct), np.uint32)
    words, mass = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for c in range(CLASSES):
        own = np.flatnonzero((klass == c) & (total > 0))
        rank[own] = np.arange(len(own))
        words[c], mass[c] = len(own), total[own].sum()
    at = np.concatenate(([0], np.cumsum(np.asarray(table["_n"]))))
    answer, ranks = total[where], rank[where]
    n = table.num_rows
    return pa.table({
        "_bucket": pa.concat_arrays([table["_bucket"].combine_chunks(), table["_bucket"].combine_chunks()[:1]]),
        "_batch": pa.array([*table["_batch"].to_pylist(), -1], pa.int32()),
        "_kind": pa.array([0] * n + [1], pa.int32()),
        "_values": pa.array([answer[at[i]:at[i + 1]].tobytes() for i in range(n)] + [words.tobytes()], pa.binary()),
        "_ranks": pa.array([ranks[at[i]:at[i + 1]].tobytes() for i in range(n)] + [mass.tobytes()], pa.binary())})


def features(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of each token's context features (tokens x 5): three words back, the previous two together, bias."""
    start = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(ids)) - start
    back = []
    for k in (1, 2, 3):
        prev = np.full(len(ids), -2, np.int64)  # nothing; -1 is a word without count
        prev[k:] = ids[:-k] if k < len(ids) else prev[k:]
        prev[place < k] = -2
        back.append(K.mix(prev.view(np.uint64) * np.uint64(8) + np.uint64(k)))
    pair = K.mix(back[0] * np.uint64(3) + back[1])
    return np.stack([*back, pair, np.full(len(ids), END)]).T  # a feature's hashes lie side by side


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def added(table: np.ndarray, rows: np.ndarray, last: np.ndarray) -> np.ndarray:
    """columns x tokens: sums of the table's rows of each token's features; ``last`` is what the feature of all tokens adds."""
    out = np.take(table, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1] - 1):
        out += np.take(table, rows[:, k], axis=0)
    return np.ascontiguousarray(out.T) + last[:, None]


def scattered(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that the tokens' features touch (distinct), and the sums of the gradients g (columns x tokens) in each."""
    varying = rows[:, :-1].T.ravel().astype(np.uint16)  # CLASS_BITS is under 16: sorted by counting
    order = np.argsort(varying, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = varying[order][1:] != varying[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    at = varying[order][new].astype(np.int64)
    own = int(rows[0, -1])
    place = int(np.searchsorted(at, own))
    alone = place == len(at) or at[place] != own
    out, wide = np.zeros((len(g), len(at) + alone), F32), g.astype(np.float64)
    for c in range(len(g)):
        out[c, :len(at)] = np.bincount(which, np.tile(wide[c], rows.shape[1] - 1), len(at))
    out[:, -1 if alone else place] += wide.sum(axis=1).astype(F32)
    return np.append(at, own) if alone else at, np.ascontiguousarray(out.T)


def _bits(n: int, least: int, most: int) -> int:
    return min(most, max(least, int(n).bit_length()))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and which of them each key is (by hashing, not by sorting all keys)."""
    codes, distinct = pd.factorize(keys)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], np.take(place, codes)


class MaxEnt:
    """The model of words numbered class by class: ``sizes`` words and ``mass`` (share of the start) of each class."""

    def __init__(self, params: np.ndarray | None = None, sizes=SIZES, mass=None):
        self.sizes = np.asarray(sizes, np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        words = int(self.sizes.sum())
        self.class_bits, self.word_bits = _bits(words // 16, *CLASS_BITS), _bits(4 * words, *WORD_BITS)
        edge = CLASSES << self.class_bits
        self.params = np.zeros(edge + (1 << self.word_bits), F32) if params is None else params
        self.klass, self.word = self.params[:edge].reshape(-1, CLASSES), self.params[edge:]
        mass = self.sizes if mass is None else np.asarray(mass)
        self.prior = np.where(self.sizes > 0, np.log(np.maximum(mass, 1e-9)), -1e30).astype(F32)

    def class_rows(self, f: np.ndarray) -> np.ndarray:
        return (f >> np.uint64(64 - self.class_bits)).astype(np.int64)

    def of_class(self, rows: np.ndarray) -> np.ndarray:
        return softmax(added(self.klass, rows, self.klass[rows[0, -1]] + self.prior))

    def halvings(self, ids: np.ndarray, f: np.ndarray):
        """For each depth: tokens that are not alone yet, their words, slots of their two context features; and
        for each of these words the slot of its bias, whether it is right, and the log odds at the start.

        Where a word lies at each depth is worked out once for each distinct word of ``ids``.
        """
        w, words = pd.factorize(ids)
        k = np.searchsorted(self.start + self.sizes, words, "right")
        lo, hi = self.start[k], self.start[k] + self.sizes[k]
        at, previous, before = np.arange(len(ids)), f[:, 0], f[:, 1]
        shift, base = np.uint64(64 - self.word_bits), np.uint64(K.BASE)

        def slot(h):
            h *= base
            h >>= shift
            return h.view(np.int64)

        while True:
            open_ = hi - lo > 1
            if not open_.all():
                more = np.flatnonzero(open_[w])
                w = (np.cumsum(open_) - 1)[w[more]]
                at, previous, before = at[more], previous[more], before[more]
                words, lo, hi = words[open_], lo[open_], hi[open_]
            if not len(at):
                return
            mid = (lo + hi) >> 1
            right = words >= mid
            node = K.mix((lo.view(np.uint64) << np.uint64(20)) ^ hi.view(np.uint64))
            own = np.take(node, w)
            yield at, w, slot(previous ^ own), slot(before ^ own), slot(END ^ node), right, np.log((hi - mid) / (mid - lo)).astype(F32)
            lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)

    def log10(self, ids: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Of each token's class, and of the word in it."""
        ids = ids.astype(np.int64)
        out = np.zeros(len(ids))
        for a in range(0, len(ids), MINIBATCH):  # small temporaries stay in the cache
            b = a + MINIBATCH
            k = np.searchsorted(self.start + self.sizes, ids[a:b], "right")
            p = self.of_class(self.class_rows(f[a:b]))[k, np.arange(len(k))]
            out[a:b] = np.log(np.maximum(p, 1e-30))
        for at, w, previous, before, bias, right, odds in self.halvings(ids, f):
            odds += np.take(self.word, bias)
            x = np.take(odds, w)
            x += np.take(self.word, previous)
            x += np.take(self.word, before)
            np.negative(x, out=x, where=np.take(right, w))
            out[at] -= np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))
        return out / np.log(10)

    def train(self, ids: np.ndarray, f: np.ndarray, seen: np.ndarray, work: np.ndarray, rate: float = RATE) -> None:
        """One step on the mean gradient of a minibatch, scaled for each parameter by its past gradients (``seen``)."""
        k = np.searchsorted(self.start + self.sizes, ids, "right")
        rows = self.class_rows(f)
        g = self.of_class(rows)
        g[k, np.arange(len(ids))] -= 1
        at, grad = scattered(rows, g)
        grad /= F32(len(ids))
        past = seen[:self.klass.size].reshape(self.klass.shape)
        now = np.take(past, at, axis=0)
        now += grad * grad
        past[at] = now
        np.sqrt(now, out=now)
        now += F32(1e-6)
        grad *= F32(rate)
        grad /= now
        self.klass[at] = np.take(self.klass, at, axis=0) - grad
        share = F32(1 / len(ids))
        for _, w, previous, before, bias, right, odds in self.halvings(ids, f):
            odds += np.take(self.word, bias)
            x = np.take(odds, w)
            x += np.take(self.word, previous)
            x += np.take(self.word, before)
            d = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            d -= np.take(right, w)
            d *= share
            np.add.at(work, previous, d)
            np.add.at(work, before, d)
            np.add.at(work, bias, np.bincount(w, d, len(bias)).astype(F32))
        past, rate = seen[self.klass.size:], F32(rate)
        for lo in range(0, len(work), PIECE):  # all steps on a piece while it is in the cache
            grad, old, word = work[lo:lo + PIECE], past[lo:lo + PIECE], self.word[lo:lo + PIECE]
            change = grad * grad
            old += change
            np.sqrt(old, out=change)
            change += F32(1e-6)
            np.divide(grad, change, out=change)
            change *= rate
            word -= change
            grad.fill(0)


def chunks(n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Texts lo to hi and their tokens a to b, about CHUNK tokens at a time."""
    edges, lo = np.concatenate(([0], np.cumsum(n))), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + CHUNK, "right")) - 1)
        yield lo, hi, int(edges[lo]), int(edges[hi])
        lo = hi


def _encode(sent):
    """Each text's word numbers (-1: not counted), and all that its base score needs."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first, total, distinct, kind = sent.value
        t, n = tokens(left["_text"].combine_chunks())
        _, where = numbered(t)
        right = right.sort_by("_bucket")
        counts = unpack(right["_values"], np.int64)
        held = np.array([v.as_buffer().size // 8 for v in right["_values"]], np.int64)
        bucket = np.repeat(np.asarray(right["_bucket"]), held)
        number = first[bucket, class_of(counts)] + unpack(right["_ranks"], np.uint32)
        ids = np.where(counts > 0, number, -1)[where].astype(kind)
        base = np.log10((counts + 1) / (total + distinct + 1))[where]
        edges = np.concatenate(([0], np.cumsum(n)))
        add = lambda x: np.add.reduceat(x, edges[:-1]) if len(n) else np.zeros(0)
        return pa.table({
            "_id": left["_id"], "_held": left["_held"], "_key": left["_key"], "_n": pa.array(n, pa.int64()),
            "_known": pa.array(add((ids >= 0).astype(np.int64)), pa.int64()), "_base": pa.array(add(base), pa.float64()),
            "_ids": pa.array([ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})

    return run


ENCODED = "_id long, _held boolean, _key long, _n long, _known long, _base double, _ids binary"


def _train(sent, slices: int):
    def run(table: pa.Table) -> pa.Table:
        params, past, sizes, mass, kind = sent.value
        model, seen = MaxEnt(params.copy(), sizes, mass), past.copy()
        table = table.sort_by([("_key", "ascending"), ("_id", "ascending")])
        work = np.zeros(len(model.word), F32)
        ids, n = unpack(table["_ids"], kind), np.asarray(table["_n"])
        size = min(2 * MINIBATCH, max(MINIBATCH, len(ids) // STEPS_A_UNIT))
        rate = RATE * math.sqrt(size / MINIBATCH)
        for lo, hi, a, b in chunks(n):
            own = ids[a:b].astype(np.int64)
            f = features(own, n[lo:hi])
            for at in range(0, len(own), size):
                model.train(own[at:at + size], f[at:at + size], seen, work, rate)
        step, seen = model.params - params, seen - past
        part = lambda x: pa.array([x[i * SLICE:(i + 1) * SLICE].tobytes() for i in range(slices)], pa.binary())
        return pa.table({"_slice": pa.array(range(slices), pa.int32()),
                         "_unit": pa.array([table["_turn"][0].as_py()] * slices, pa.int32()), "_summed": pa.array([False] * slices),
                         "_step": part(step), "_seen": part(seen)})

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sums over units: of steps, each weighted by the squared gradients that its unit has seen, and of these weights."""
    table = table.sort_by("_unit")
    total, weight = 0.0, 0.0
    for s, w, whole in zip(table["_step"], table["_seen"], table["_summed"]):
        kind = np.float64 if whole.as_py() else F32
        s, w = np.frombuffer(s.as_buffer(), kind).astype(float), np.frombuffer(w.as_buffer(), kind).astype(float)
        total, weight = total + (s if whole.as_py() else s * w), weight + w
    return pa.table({"_slice": table["_slice"][:1].combine_chunks(), "_unit": table["_group"][:1].combine_chunks(),
                     "_summed": pa.array([True]), "_step": pa.array([total.tobytes()], pa.binary()),
                     "_seen": pa.array([weight.tobytes()], pa.binary())})


STEPS = "_slice int, _unit int, _summed boolean, _step binary, _seen binary"
#: units whose steps one task adds up
FAN_IN = 16


def summed(steps: DataFrame, units: int) -> DataFrame:
    """One row a slice: steps added up as a tree over the units."""
    while True:
        steps = steps.withColumn("_group", F.floor(F.col("_unit") / FAN_IN).cast("int")).groupBy("_slice", "_group").applyInArrow(_added, STEPS)
        units = -(-units // FAN_IN)
        if units <= 1:
            return steps


def fit(train: DataFrame, sizes: np.ndarray, mass: np.ndarray, kind, total: int, rounds: int | None = None) -> np.ndarray:
    """The parameters, from all rows ``_key, _id, _n, _ids``."""
    rounds = ROUNDS if rounds is None else rounds
    spark = train.sparkSession
    params = MaxEnt(None, sizes, mass).params
    seen = np.full(len(params), 1e-7, F32)
    slices = -(-len(params) // SLICE)
    units = max(1, -(-total // (UNIT * rounds)))
    spread = F.xxhash64("_key", F.lit("unit"))
    rows = train.withColumn("_unit", F.pmod(spread, F.lit(units * rounds)).cast("int"))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((params, seen, sizes, mass, kind))  # bounded by CLASS_BITS and WORD_BITS
        steps = rows.where(F.col("_unit") % rounds == k).select(F.floor(F.col("_unit") / rounds).cast("int").alias("_turn"), "_key", "_id", "_n", "_ids") \
            .groupBy("_turn").applyInArrow(_train(sent, slices), STEPS)
        found = summed(steps, units).toArrow().sort_by("_slice")
        if found.num_rows:
            weight = unpack(found["_seen"], np.float64)
            params = params + (unpack(found["_step"], np.float64) / np.maximum(weight, 1e-300)).astype(F32)
            seen = seen + weight.astype(F32)
    return params


def _score(sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, sizes, mass, kind, total, distinct = sent.value
        model = MaxEnt(params, sizes, mass)
        new = 1 / (total + distinct + 1)  # the base score's mass of words that were not counted
        for batch in batches:
            n, score = batch.column("_n").to_numpy(), np.zeros(batch.num_rows)
            texts = batch.column("_ids")
            for lo, hi, _, _ in chunks(n):
                ids = unpack(texts.slice(lo, hi - lo), kind).astype(np.int64)
                p, known = np.full(len(ids), np.log10(new)), np.flatnonzero(ids >= 0)
                if len(known):
                    p[known] = np.log10(1 - new) + model.log10(ids[known], features(ids, n[lo:hi])[known])
                score[lo:hi] = np.add.reduceat(p, np.cumsum(n[lo:hi]) - n[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held"), batch.column("_n"), batch.column("_known"),
                 pa.array(np.full(len(n), total), pa.int64()), batch.column("_base"), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7,
             held: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A row is held out when crc32(doc_id as text) mod ``folds`` is ``held``; counts and parameters come
    from all other rows.  A null or empty text is one END token.  Without training rows all counts are
    0 and both scores are 0.  Repeated rows count as often as they occur; a null id
    counts as the empty string and stays null; other columns are ignored.
    """
    spark = docs.sparkSession
    held_out = remainder(id_col, folds) == held
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), held_out.alias("_held"), text_of(text_col).alias("_text"))
    dealt, buckets = batched(rows, "_id", "_text")
    sent = dealt.withColumn("_train", ~F.col("_held")).select("_batch", "_train", "_text") \
        .groupBy("_batch").applyInArrow(_send(buckets), SENT)
    answers = stored(ask(sent, _total, ANSWER))

    # words and tokens of each class in each bucket; a class numbers its words by hash, so by bucket first
    top = answers.where("_kind = 1").select("_bucket", "_values", "_ranks").collect()
    words, mass = np.zeros((buckets, CLASSES), np.int64), np.zeros(CLASSES, np.int64)
    for r in top:
        words[r["_bucket"]] = np.frombuffer(r["_values"], np.int64)
        mass += np.frombuffer(r["_ranks"], np.int64)
    sizes = words.sum(axis=0)
    first = np.cumsum(sizes) - sizes + np.cumsum(words, axis=0) - words
    total, distinct = int(mass.sum()), int(sizes.sum())
    kind = np.int32 if distinct < 2 ** 31 else np.int64
    numbers = spark.sparkContext.broadcast((first, total, distinct, kind))
    asked = answers.where("_kind = 0").select("_batch", "_bucket", "_values", "_ranks")
    encoded = stored(dealt.withColumn("_key", F.xxhash64("_text")).groupBy("_batch").cogroup(asked.groupBy("_batch"))
                     .applyInArrow(_encode(numbers), ENCODED))
    params = fit(encoded.where(~F.col("_held")), sizes, mass + sizes, kind, total)
    model = spark.sparkContext.broadcast((params, sizes, mass + sizes, kind, total, distinct))
    return encoded.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                             "base_score double, score double")
