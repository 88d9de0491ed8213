import pytest

EXTRA = "doc_id long, text string, lang string, h1 int, component_id string"


@pytest.fixture
def make(spark):
    """A documents-like table with columns whose names clash with results."""

    def build(rows):
        return spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in rows], EXTRA)

    return build
