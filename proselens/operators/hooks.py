"""User metrics (U2): built-in expressions over the per-document frames, or an external analyzer in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M

ANALYZER_BATCH = 256


@dataclass(frozen=True)
class UserMetric:
    name: str
    group: str
    column: Callable[[], Column]  # over the columns of the frames in ``need``
    need: tuple[str, ...]


REGISTERED: dict[str, UserMetric] = {}


def register_metric(name: str, group: str, column: Callable[[], Column], need: tuple[str, ...] = ("doc",)) -> UserMetric:
    """Adds a metric computed by a built-in expression; ``need`` names frames of ``metrics.FRAMES``, ``doc`` first."""
    unknown = [k for k in need if k not in M.FRAMES]
    if unknown or need[:1] != ("doc",):
        raise ValueError(f"frames must start with doc and be known: {need}")
    REGISTERED[name] = UserMetric(name, group, column, need)
    return REGISTERED[name]


def user_metrics(documents: DataFrame, names: list[str] | None = None, tok: DataFrame | None = None, preprocess=None) -> DataFrame:
    """``doc_id`` and the registered metrics (null rule P5), each needed frame once."""
    chosen = [REGISTERED[n] for n in (names if names is not None else REGISTERED)]
    need = tuple(dict.fromkeys(["doc", *(k for m in chosen for k in m.need)]))
    d = M.base(M.cleaned(documents, preprocess), tok, need)
    return M.finish(d.select("doc_id", *[m.column().alias(m.name) for m in chosen]), [m.name for m in chosen])


def analyzed(part: pa.RecordBatch, call: Callable[[list[str]], list[dict]], names: list[str], batch: int) -> Iterator[pa.RecordBatch]:
    """``doc_id`` and the analyzer's results for the rows of ``part``, ``batch`` texts at a time; the null rule (P5)."""
    ids, texts = part.column("doc_id"), part.column("text")
    for lo in range(0, part.num_rows, batch):
        own = [t or "" for t in texts.slice(lo, batch).to_pylist()]
        found = call(own)
        if len(found) != len(own):
            raise ValueError(f"the analyzer returned {len(found)} results for {len(own)} texts")
        values = [pa.array([0.0 if r.get(n) is None else float(r[n]) for r in found], pa.float64()) for n in names]
        yield pa.RecordBatch.from_arrays([ids.slice(lo, batch), *values], names=["doc_id", *names])


def register_analyzer(spark: SparkSession, name: str, analyzer: Callable[[], Callable[[list[str]], list[dict]]], names: list[str],
                      batch: int = ANALYZER_BATCH):
    """A SQL table function ``name(TABLE(...))`` over rows with ``doc_id long, text string``: the same rows as ``external_metrics``.

    Each partition of the table argument is analyzed where it lies, in Arrow batches; with ``PARTITION BY`` the rows of a key come
    together.  The function is also returned, for use with ``df.asTable()``.
    """
    class Analyze:
        def __init__(self):
            self.call = analyzer()

        def eval(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield from analyzed(part, self.call, names, batch)

    schema = ", ".join(["doc_id long", *(f"`{n}` double" for n in names)])
    function = F.arrow_udtf(Analyze, returnType=schema)
    spark.udtf.register(name, function)
    return function


def external_metrics(documents: DataFrame, analyzer: Callable[[], Callable[[list[str]], list[dict]]], names: list[str],
                     batch: int = ANALYZER_BATCH, preprocess=None) -> DataFrame:
    """``doc_id`` and metrics from a user's batch function ``list[str] -> list[dict]``, in Arrow batches.

    ``analyzer()`` is called once a task.  A missing key or None becomes 0 (P5), NaN stays; a null text is passed as "".
    An analyzer that returns another number of results than texts is an error.
    """
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = analyzer()
        for part in parts:
            yield from analyzed(part, call, names, batch)

    schema = ", ".join(["doc_id long", *(f"`{n}` double" for n in names)])
    rows = M.cleaned(documents, preprocess).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)
