import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, token long, size int, __x string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names the operators use themselves."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "w", 7, 3, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make
