import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text) pairs, with columns whose names could clash."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1, 2, "x") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, h long, key long, fp string"
        )

    return make
