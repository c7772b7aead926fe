import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of texts; ids count up, a clashing extra column comes along."""

    def make(texts, first=0, **more):
        rows = [(first + i, t, more.get("lang", "en"), "s", len(t) if t else None, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC + ", score string")

    return make
