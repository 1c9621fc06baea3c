"""Every registered query against its SQL, and the registry's own rules."""

import os

import pytest

from siteglass.plans.catalog import registered
from tests.compare import connect, difference

QUERIES, SQL = registered()
# The whole registry runs by default at the smallest scale; narrow it with TEST_QUERIES=name,name.
CHOSEN = os.environ.get("TEST_QUERIES")


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_statements_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and (not CHOSEN or n in CHOSEN.split(","))])
def test_query_matches_sql(spark, con, folder, name):
    message, _ = difference(spark, con, QUERIES[name], SQL[name], folder)
    assert message is None, message
