"""End-to-end jobs: the full metric matrix (both families) and the labelled feature table.

The matrix job writes the tokens of the documents once into the shared folder, derives
every metric key from it, joins the per-key results on ``doc_id`` and writes one parquet table into the shared folder.  Training runs
read that table, as the reference's trainers read its written matrices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import groups as G
from ..operators import annotate as A
from ..operators import frequency as FQ
from ..operators import metrics as M
from ..operators import pairs as PR
from ..session import stored
from ..sources import corpus as CO

C = F.col

C_KEYS = [M.c_descriptive, M.c_word_information, M.c_pattern_density, M.c_syntactic_complexity,
          M.c_connectives, M.c_lexical_diversity, M.c_readability]
M_KEYS = [M.m_connectives, M.m_descriptive, M.m_lexical_diversity, M.m_readability, M.m_morphology]


def full_matrix(documents: DataFrame, corpus: DataFrame | None = None, tok: DataFrame | None = None) -> DataFrame:
    """All 146 metrics per document.  ``corpus`` (default: ``documents``) defines word frequencies.

    Every per-document frame is computed once and joined on ``doc_id``; all keys are columns over that join.
    """
    words = tok if corpus is None else None  # tokens at hand need no second cutting of the texts
    tok = tok if tok is not None else A.tokens(documents)
    vocab = stored(FQ.vocabulary(words if words is not None else A.forms(documents if corpus is None else corpus)))
    order = [m for _, _, m, _ in G.group_rows()]
    wide = M.base(documents, tok, ("doc", "sent", "form", "lemma", "conn", "punct"))
    for part in (M.mtld_level(documents), FQ.frequency_level(tok, vocab), FQ.semantic_level(tok), PR.cohesion(documents, tok)):
        wide = wide.join(part, "doc_id", "left")
    columns = [c for key in C_KEYS + M_KEYS for c in key.columns()]
    columns += M.m_syntax_columns() + FQ.m_word_frequency_columns() + [C(m) for m in FQ.M_SEMANTICS + PR.C_REFERENTIAL_COHESION]
    columns += [C(c).alias(m) for m, c in PR.M_FROM_C.items()]
    return M.finish(wide.select("doc_id", *columns), order)


def compute_and_save_metrics(spark: SparkSession, sf_dir: str, subset: str = "labelled") -> DataFrame:
    """The matrix of ``subset`` (``labelled`` or ``all`` documents), written under a path of this run and read back."""
    docs = CO.read_documents(spark, sf_dir)
    target = docs
    if subset == "labelled":
        lab = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
        target = docs.join(lab, "doc_id", "left_semi")
    # the tokens as columns: a cached row of theirs takes far more disk than it does there
    return stored(full_matrix(target, corpus=docs, tok=stored(A.tokens(target))))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: ``doc_id, label, split`` + 146 metric columns."""
    m = compute_and_save_metrics(spark, sf_dir, "labelled")
    return m.join(CO.labels(spark, sf_dir), "doc_id")
