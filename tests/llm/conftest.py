import pytest

from siteglass.llm.common import importable_by_workers


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable_by_workers(spark)


@pytest.fixture(scope="session")
def corpus():
    """Query functions of a folder with the driver's tables."""
    return "/root/testdata/sf0.01"


DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def table(spark, rows, schema=DOCS):
    """Documents from (doc_id, text) pairs, with the other columns and one that the real table lacks."""
    return spark.createDataFrame([(i, t, "en", "src", None, "n") for i, t in rows], schema)
