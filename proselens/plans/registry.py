"""Registered queries (one per SURVEY section 2 key) and their oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the given parquet tables and returns
a DataFrame.  Doubles are rounded to 6 decimals in the registered form only, so
that two engines summing in different orders compare equal; the library
functions return full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..operators import metrics as M
from ..operators import pairs as PR
from ..operators import frequency as FQ
from ..session import table_path
from ..sources.corpus import read_documents
from . import eval_queries as EQ
from . import hook_queries as HQ
from . import matrix_queries as MQ
from . import ml_queries as MLQ
from . import oracle as O


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, sf_dir)


def round6(df: DataFrame) -> DataFrame:
    def r(f):
        if isinstance(f.dataType, (DoubleType, FloatType)):
            return F.round(F.col(f.name), 6).alias(f.name)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (DoubleType, FloatType)):
            return F.transform(F.col(f.name), lambda x: F.round(x.cast("double"), 6)).alias(f.name)
        return F.col(f.name)
    return df.select(*[r(f) for f in df.schema.fields])


def _metric(fn) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: round6(fn(documents(spark, sf_dir)))


METRIC_KEYS = {
    "c_descriptive": (M.c_descriptive, O.q_c_descriptive),
    "c_word_information": (M.c_word_information, O.q_c_word_information),
    "c_pattern_density": (M.c_pattern_density, O.q_c_pattern_density),
    "c_syntactic_complexity": (M.c_syntactic_complexity, O.q_c_syntactic_complexity),
    "c_connectives": (M.c_connectives, O.q_c_connectives),
    "c_lexical_diversity": (M.c_lexical_diversity, O.q_c_lexical_diversity),
    "c_readability": (M.c_readability, O.q_c_readability),
    "m_connectives": (M.m_connectives, O.q_m_connectives),
    "m_descriptive": (M.m_descriptive, O.q_m_descriptive),
    "m_lexical_diversity": (M.m_lexical_diversity, O.q_m_lexical_diversity),
    "m_readability": (M.m_readability, O.q_m_readability),
    "m_syntax": (M.m_syntax, O.q_m_syntax),
    "m_morphology": (M.m_morphology, O.q_m_morphology),
    "c_referential_cohesion": (PR.c_referential_cohesion, O.q_c_referential_cohesion),
    "m_referential_cohesion": (PR.m_referential_cohesion, O.q_m_referential_cohesion),
    "m_word_frequency": (FQ.m_word_frequency, O.q_m_word_frequency),
    "m_semantics": (FQ.m_semantics, O.q_m_semantics),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _metric(fn) for k, (fn, _) in METRIC_KEYS.items()}
    out.update({k: (lambda spark, sf_dir, fn=fn: round6(fn(spark, sf_dir))) for k, fn in EQ.QUERIES.items()})
    out.update({k: (lambda spark, sf_dir, fn=fn: round6(fn(spark, sf_dir))) for k, fn in MQ.QUERIES.items()})
    out.update({k: (lambda spark, sf_dir, fn=fn: round6(fn(spark, sf_dir))) for k, fn in (MLQ.QUERIES | HQ.QUERIES).items()})
    return out


def oracle_sql() -> dict[str, str]:
    out = {k: sql() for k, (_, sql) in METRIC_KEYS.items() if sql is not None}
    out.update(EQ.ORACLE)
    out.update(MQ.ORACLE)
    out.update(MLQ.ORACLE)
    out.update(HQ.ORACLE)
    return out
