import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts or (id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, clashes=False):
        pairs = [row if isinstance(row, tuple) else (at, row) for at, row in enumerate(rows)]
        full = [(i, text, "en", f"s{at % 3}", None if text is None else len(text)) for at, (i, text) in enumerate(pairs)]
        schema = DOCS
        if clashes:
            full = [(*row, "x", "y", 7, "z") for row in full]
            schema += ", content string, row string, id int, key string"
        return spark.createDataFrame(full, schema)

    return make
