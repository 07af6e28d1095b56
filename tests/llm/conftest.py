import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from rows (doc_id, text, lang, source) with any columns more."""

    def made(rows, extra=""):
        schema = "doc_id long, text string, lang string, source string" + extra
        return spark.createDataFrame(rows, schema)

    return made
