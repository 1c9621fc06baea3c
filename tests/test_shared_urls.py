"""Pages that share a URL against the statements, which know a URL and not a page."""

import shutil

import pytest

from siteglass.plans.catalog import registered
from tests.compare import connect, difference

QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def shared(spark, folder, tmp_path_factory):
    """The given tables, and pages of which some share a URL with others and some also their links."""
    out = tmp_path_factory.mktemp("shared") / "sf"
    shutil.copytree(folder, out)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    copies = pages.where("page_id % 3 = 0").selectExpr("page_id + 1000000 AS page_id", "url", "html")
    others = pages.where("page_id % 3 = 1").selectExpr("page_id + 2000000 AS page_id", "url", "replace(replace(html, '<title>', '<title>x'), '<h1>', '<h2>') AS html")
    (out / "pages.parquet").chmod(0o644)
    out.chmod(0o755)
    (out / "pages.parquet").unlink()
    pages.union(copies).union(others).toPandas().to_parquet(out / "pages.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["link_edges", "page_links", "regression_gate", "seo_score", "site_link_shortlist"])
def test_pages_that_share_a_url(spark, shared, name):
    message, rows = difference(spark, connect(shared), QUERIES[name], SQL[name], shared)
    assert message is None and rows > 0, message
