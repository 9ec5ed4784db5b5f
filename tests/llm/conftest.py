import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (or (id, text) pairs), with columns whose names might clash."""

    def build(texts, start=0):
        rows = [x if isinstance(x, tuple) else (i + start, x) for i, x in enumerate(texts)]
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as _id", "'y' as _text", "1 as h", "2 as id")

    return build
