"""Quality: a compression classifier.

Two zstandard dictionaries are built, one from texts labelled 0 and one from texts
labelled 1.  A text is compressed with each, in chunks of CHUNK bytes so that the
dictionary counts to the end of a long text.  The sizes, divided by the text's length,
and their difference (over the whole text, and in the chunks where it is least and
greatest) go through a logistic calibration that is fitted on labelled texts which the
dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .learn import labelled_sample, remainder, sigmoid

#: bytes compressed at a time, bytes of a dictionary, zstandard level
CHUNK, DICTIONARY, LEVEL = 2048, 65_536, 3
#: labelled rows of the sample; texts and chunks of each label that a dictionary is built from
SAMPLE, DICTIONARY_TEXTS, DICTIONARY_CHUNKS = 20_000, 1500, 4000
FEATURES = 6


def chunks(text: bytes) -> list[bytes]:
    return [text[i:i + CHUNK] for i in range(0, max(1, len(text)), CHUNK)]


def dictionary(texts: list[bytes], most: int = DICTIONARY_CHUNKS) -> bytes:
    """A dictionary trained on at most ``most`` chunks; where there is too little text to train one, the text itself."""
    import zstandard

    parts = [c for t in texts for c in chunks(t) if c]
    order = np.random.default_rng(0).permutation(len(parts))[:most]
    parts = [parts[i] for i in order]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(parts) or b" " * 64)[:DICTIONARY].ljust(64)


class Compressors:
    """Compressed sizes under the dictionaries of label 0 and label 1."""

    def __init__(self, dictionaries: list[bytes]):
        import zstandard

        self.each = []
        for d in dictionaries:
            d = zstandard.ZstdCompressionDict(d)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                                      write_content_size=False, write_dict_id=False))

    def features(self, text: str) -> list[float]:
        parts = chunks(text.encode("utf-8"))
        bad, good = (np.array([len(c.compress(p)) for p in parts], float) for c in self.each)
        n = np.array([len(p) for p in parts], float)
        total, each = max(64.0, n.sum()), (bad - good) / np.maximum(n, 64)
        return [(bad - good).sum() / total, each.min(), each.max(), bad.sum() / total, good.sum() / total,
                np.log1p(n.sum())]


def _features(dictionaries: list[bytes], columns: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(dictionaries)
        for b in batches:
            x = [own.features(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(x, pa.list_(pa.float64()))],
                                             names=[*columns, "_x"])

    return run


class Calibration:
    """Logistic regression on standardised features, by Newton's method with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a, self.w = self.design(x), np.zeros(x.shape[1] + 1)
        for _ in range(100):
            p = sigmoid(a @ self.w)
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(self.w)),
                                   a.T @ (y - p) - 0.1 * self.w)
            self.w += step
            if np.abs(step).max() < 1e-9:
                break

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]


def fit(sample: DataFrame, texts: int = DICTIONARY_TEXTS, parts: int = DICTIONARY_CHUNKS) -> tuple[list[bytes], Calibration]:
    """Dictionaries from one half of ``_id, _y, _text`` rows, the calibration from the other half."""
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2))
    built = []
    for y in (0, 1):
        rows = sample.where((half == 0) & (F.col("_y") == y)).orderBy(F.xxhash64("_id"), "_id") \
            .limit(texts).select("_text").toArrow()  # bounded by `texts`
        built.append(dictionary([t.encode("utf-8") for t in rows["_text"].to_pylist()], parts))
    found = sample.where(half == 1).select("_y", "_text").repartition(8) \
        .mapInArrow(_features(built, ["_y"]), "_y int, _x array<double>").toArrow()  # bounded by the sample
    if not found.num_rows:
        return built, Calibration(np.zeros((2, FEATURES)), np.array([0.0, 1.0]))
    return built, Calibration(np.array(found["_x"].to_pylist(), float), np.asarray(found["_y"], float))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE,
            id_col: str = "doc_id", text_col: str = "text", dictionary_texts: int = DICTIONARY_TEXTS,
            dictionary_chunks: int = DICTIONARY_CHUNKS) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Labels are learned from at most ``sample`` labelled rows whose crc32(doc_id as text) mod 5 is not 0;
    each label's dictionary from at most ``dictionary_texts`` texts and ``dictionary_chunks`` chunks of one half of them.
    Scores use the text only.  A null text counts as empty, and an empty text is scored like any other
    (its sizes are those of an empty frame); without labelled rows every score is one half.  Repeated rows
    get equal scores; a null id stays null; other columns are ignored.
    """
    built, line = fit(labelled_sample(docs, labels, label, sample, id_col, text_col), dictionary_texts, dictionary_chunks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, 5) == 0).alias("held_out"),
                       text_of(text_col).alias("_text"))
    scored = rows.mapInArrow(_features(built, ["doc_id", "held_out"]), "doc_id long, held_out boolean, _x array<double>")
    w = (line.w[:-1] / line.scale).tolist()
    bias = float(line.w[-1] - (line.w[:-1] / line.scale) @ line.mean)
    logit = F.lit(bias)
    for i, v in enumerate(w):
        logit = logit + F.col("_x")[i] * F.lit(v)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    return scored.select("doc_id", "held_out", score.alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
