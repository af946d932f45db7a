from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_from(spark):
    """Documents from (id, text) or (id, text, lang, source) rows."""

    def make(rows, schema: str = DOC):
        full = [(r + (None, "s"))[:4] if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(i, t, a, s, None if t is None else len(t)) for i, t, a, s in full], schema)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sf():
    return SF
