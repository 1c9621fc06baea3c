"""Rounds of components: no file and no task gets more edges than a bounded number, whatever the graph's size."""

import pyarrow.parquet as pq

from siteglass.operators import components


def test_files_and_shuffles_of_rounds_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST_EDGES", 100, raising=False)
    files, partitions = [], []

    def spy(*args, stored=components.stored):
        partitions.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        out = stored(*args)
        files.extend(pq.read_metadata(f.removeprefix("file:")).num_rows for f in out.inputFiles())
        return out

    monkeypatch.setattr(components, "stored", spy)
    settings = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(s) for s in settings]
    edges = spark.range(2000).selectExpr("id AS a", "id + 1 + 499 * (id % 2) AS b")
    edges = edges.union(edges)  # repeated edges
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    root = {n: n for n in range(2500)}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(2000):
        a, b = sorted((top(i), top(i + 1 + 499 * (i % 2))))
        root[b] = a
    assert found == {n: top(n) for n in found} and set(range(2000)) <= set(found)
    assert max(files) <= 100 and len(files) > 20
    assert min(partitions[1:]) >= 20  # 2 * 1000 edges or more, of at most 100
    assert [spark.conf.get(s) for s in settings] == before
