from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table of (doc_id, text[, lang[, source]]) rows, with a clashing extra column."""

    def make(rows):
        filled = [(*row, *([None] * (4 - len(row))), len(row[1] or "")) for row in rows]
        return spark.createDataFrame(filled, DOCS)

    return make


@pytest.fixture
def written(tmp_path):
    """Writes tables as <name>.parquet into a fresh folder and returns it."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
