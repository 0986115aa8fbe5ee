from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Rows of ``documents``, with a column whose name operators use inside."""

    def make(rows):
        rows = [(*r, *[None] * (5 - len(r))) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as size")

    return make
