import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or (doc_id, text) or (doc_id, text, source) rows, with two more columns whose names clash."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            source = r[2] if len(r) > 2 else "s"
            full.append((r[0], r[1], None, source, len(r[1] or ""), "clash", None))
        return spark.createDataFrame(full, SCHEMA)

    return make
