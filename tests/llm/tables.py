import pytest

#: columns whose names clash with names that operators use inside
CLASH = "doc_id long, text string, _id string, _text int, _run int, _hash long, kept boolean, n_words long, score double, _batch int"


@pytest.fixture(scope="session")
def table(spark):
    """(doc_id, text) rows as a table with clashing extra columns."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, 2, 3, None, 4, 0.5, None) for i, t in rows], CLASH).repartition(3)
    return make
