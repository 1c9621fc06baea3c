"""Clusters of queries hold every pair that meets the thresholds, those of two shared URLs too."""

import pyarrow as pa
import pyarrow.parquet as pq

from siteglass.plans.catalog import registered

QUERIES, SQL = registered()


def test_two_shared_urls_make_a_cluster(spark, tmp_path):
    # Queries 1 and 2 share URLs 1 and 2 of nine each (Jaccard 2/16), query 3 shares one URL with query 1.
    urls = {1: [1, 2, *range(10, 17)], 2: [1, 2, *range(20, 27)], 3: [10, *range(30, 38)]}
    links = [(query, url) for query, held in urls.items() for url in held]
    queries, held = zip(*links)
    pq.write_table(pa.table({"l_partkey": queries, "l_orderkey": held}), tmp_path / "lineitem.parquet")
    found = [tuple(r) for r in QUERIES["query_clusters"](spark, str(tmp_path)).select("cluster", "queries", "overlap").collect()]
    assert found == [("1", 2, 0.125)]
