import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, n_tokens string, label string, hash long"):
        full = [(i, t, "en", "src0", len(t) if t else 0, "x", None, 7) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make
