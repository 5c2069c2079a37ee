import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Builds a documents table of (doc_id, text) or (doc_id, text, lang), with a further column of a clashing name."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        return frame.selectExpr("*", "'x' AS label", "1 AS slice", "'y' AS `_id`") if extra else frame

    return make
