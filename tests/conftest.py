import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from proselens.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    yield s
    s.stop()


def docs_df(spark, rows):
    """rows: (doc_id, lang, text)."""
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")
