from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows."""

    def build(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) + tuple(extra.values()) for r in rows]
        schema = COLUMNS + "".join(f", {name} string" for name in extra)
        return spark.createDataFrame(full, schema)

    return build
