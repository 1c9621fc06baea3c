"""Nearest neighbours against brute force."""

import numpy as np
import pyarrow.parquet as pq

from siteglass.llm.queries import QUERIES
from siteglass.llm.rp_forest import fit_forest, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(ids, vectors, query, k):
    i = ids.index(query)
    scores = vectors @ vectors[i]
    order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-scores[j], ids[j]))[:k]
    return [(ids[j], scores[j]) for j in order]


def by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
        assert r.rank == len(found[r.query_id])
    return found


def test_op9_recall_over_its_table(spark):
    folder = "/root/testdata/sf0.1"
    table = pq.read_table(f"{folder}/embeddings.parquet").to_pydict()
    ids, vectors = table["vec_id"], np.array(table["embedding"], np.float64)
    found = by_query(QUERIES["op9_rp_forest"](spark, folder).collect())
    assert sorted(found) == sorted(i for i in ids if i % 20 == 0)
    hits = 0
    for query, rows in found.items():
        assert len(rows) == 20
        hits += len({i for i, _ in exact(ids, vectors, query, 20)} & {r.vec_id for r in rows})
        for r in rows:
            assert abs(r.score - vectors[ids.index(query)] @ vectors[ids.index(r.vec_id)]) < 1e-12
    assert hits / (20 * len(found)) >= 0.9


def test_op9_defined_cases(spark):
    draw = np.random.default_rng(6)
    good = [(i, draw.normal(size=4).astype(np.float32).tolist(), 0) for i in range(60)]
    copies = [(100 + i, [1.0, 0.0, 0.0, 0.5], 1) for i in range(80)]
    odd = [
        (200, None, 0), (220, [], 0), (240, [0.0] * 4, 0), (260, [1.0, None, 0.0, 1.0], 0), (280, [float("nan"), 1.0, 1.0, 1.0], 0),
        (300, [float("inf"), 1.0, 1.0, 1.0], 0), (320, [1.0, 2.0], 0), (None, [1.0] * 4, 0), (0, good[0][1], 0),
    ]
    rows = spark.createDataFrame(good + copies + odd, SCHEMA)
    found = by_query(nearest(rows).collect())
    ids = [i for i, *_ in good + copies]
    vectors = np.array([v for _, v, _ in good + copies], np.float64)
    assert sorted(found) == [i for i in ids if i % 20 == 0]
    for query, got in found.items():  # so few rows are searched whole
        assert [r.vec_id for r in got] == [i for i, _ in exact(ids, vectors, query, 20)]
    few = by_query(nearest(spark.createDataFrame(good[:5], SCHEMA)).collect())
    assert [len(rows) for rows in few.values()] == [4]
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op9_repeated_rows_take_no_place_among_equal_vectors(spark):
    draw = np.random.default_rng(7)
    others = [(100 + i, (draw.normal(size=4) / 9).astype(np.float32).tolist(), 0) for i in range(60)]
    copies = [(i, [1.0, 0.0, 0.0, 0.5], 1) for i in range(5, 31)]
    twice = [(i, [0.0, 1.0, -0.5, 0.0], 1) for i in range(40, 70)]
    rows = spark.createDataFrame(others + copies + 24 * copies[:1] + 2 * twice, SCHEMA)
    found = by_query(nearest(rows).collect())
    kept = others + copies + twice
    ids, vectors = [i for i, *_ in kept], np.array([v for _, v, _ in kept], np.float64)
    assert sorted(found) == sorted(i for i in ids if i % 20 == 0)
    wanted = {q: [i for i, _ in exact(ids, vectors, q, 20)] for q in found}
    missed = sum(len(set(wanted[q]) - {r.vec_id for r in found[q]}) for q in found)
    assert missed == 0, f"{missed} of {20 * len(found)} neighbours missed"
    assert all([r.vec_id for r in found[q]] == wanted[q] for q in found)


def test_forest_visits_follow_the_recall_on_the_sample():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 16)) * 6
    clustered = centres[draw.integers(0, 40, 3000)] + draw.normal(size=(3000, 16))
    even = draw.normal(size=(3000, 16))
    share = lambda x: (lambda f: f.visits / f.leaves)(fit_forest(x, 60_000, float(np.linalg.norm(x, axis=1).max()), 20))
    assert share(clustered) < share(even) < 1
