import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n int, row int"


@pytest.fixture
def documents(spark):
    """Documents from (id, text) pairs, with extra columns whose names the operators use inside."""

    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in rows], SCHEMA).repartition(parts)

    return make
