import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text, lang, source) to a documents table with n_chars."""
    def of(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if len(r) > 1 and r[1] else None) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return of
