"""Overlap of queries against brute force, with URLs counted straight away and looked up, and without a row for every URL of a candidate."""

import itertools
import random

import pytest

from siteglass.operators import query_intelligence as M


@pytest.mark.parametrize("light", [1, 3, 200])
@pytest.mark.parametrize("min_shared", [2, 3])
def test_overlap_equals_brute_force(spark, light, min_shared):
    draw = random.Random(7)
    sets = {f"q{i}": {f"u{int(draw.random() ** 3 * 60)}" for _ in range(draw.randint(1, 12))} for i in range(60)}
    rows = [(q, u) for q, us in sets.items() for u in us for _ in range(draw.randint(1, 2))]
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and (shared >= min_shared or shared / len(sets[a] | sets[b]) >= 0.3):
            want[a, b] = (shared, len(sets[a]), len(sets[b]))
    found = M.query_overlap(spark.createDataFrame(rows, "query string, url string"), min_shared=min_shared, light=light).collect()
    assert {(r.a, r.b): (r.shared, r.n_a, r.n_b) for r in found} == want and len(found) == len(want)


def test_no_candidate_looks_up_all_its_urls(spark):
    rows = spark.range(40_000).selectExpr("cast(id % 400 AS string) AS query", "concat('u', id DIV 4) AS url")
    plan = M.query_overlap(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
