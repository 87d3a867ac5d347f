from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A frame with the columns of documents, from (doc_id, text) or longer rows."""
    def make(rows):
        full = [(*r, *("en", "s", 0)[len(r) - 2:]) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


@pytest.fixture
def by_id():
    """Collected rows by their first column."""
    return lambda df, key="doc_id": {r[key]: r.asDict() for r in df.collect()}
