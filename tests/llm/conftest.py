import pytest

from tests.llm.rows import EDGE_ROWS


@pytest.fixture
def table(spark):
    """docs(rows) -> DataFrame of documents with extra, clashing columns."""
    def make(rows, extra="fingerprint string, score double"):
        full = [(*r, "x", 1.5) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    return make


@pytest.fixture
def edge_docs(table):
    return table(EDGE_ROWS)


@pytest.fixture
def no_docs(table):
    return table(EDGE_ROWS[:1]).where("false")
