import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from rows (doc_id, text[, source[, lang]])."""

    def make(*rows):
        full = [(*row, *[None] * (4 - len(row))) for row in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string")

    return make
