import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make a documents table of ``(id, text)`` pairs, with extra columns whose names clash with those of results."""

    def make(*rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", -1, "y") for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", fingerprint string, ids int, spans string")

    return make
