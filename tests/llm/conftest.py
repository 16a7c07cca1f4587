import pytest


@pytest.fixture(scope="session")
def table(spark):
    """table(rows, schema): a DataFrame; table(texts): documents (doc_id, text, lang, source, n_chars) of texts."""

    def make(rows, schema=None):
        if schema is None:
            rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
            schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
