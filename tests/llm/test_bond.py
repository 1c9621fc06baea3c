"""Hard negatives by the vertical scan: against brute force with any block size, defined cases, and what the scan leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteglass.llm import bond as B
from siteglass.llm.queries import QUERIES, SQL
from tests.compare import connect, difference

SCHEMA = "vec_id long, embedding array<float>, label int, score string, chunk string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, n, "s", "c") for i, v, n in rows], SCHEMA)


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    whole = {i: (n, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, n in rows}
    out = set()
    for a, (label, x) in whole.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i, n) for i, (n, y) in whole.items() if i != a)
        for ps, p, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [s for s in scores if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out |= {(a, p, rank, i, -ps, -ns) for rank, (ns, i, _) in enumerate(fits, 1)}
    return out


def random_rows(n, width=12, labels=4, seed=5):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels + 2, width))
    return [(i, (centres[draw.integers(labels + 2)] + 0.5 * draw.normal(size=width)).tolist(), int(draw.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("block_rows, chunk_anchors", [(4096, 256), (37, 3)])
def test_equals_brute_force(spark, block_rows, chunk_anchors):
    rows = random_rows(400)
    # Copies of one vector in all labels, repeated rows, a label of its own, the zero vector, opposite vectors.
    rows += [(1000 + i, rows[7][1], i % 4) for i in range(60)] + rows[:20]
    rows += [(2000, rows[3][1], 9), (2050, [0.0] * 12, 1), (2100, [-c for c in rows[3][1]], 2)]
    got = B.hard_negatives(frame(spark, rows), F.col("label"), every=10, block_rows=block_rows, chunk_anchors=chunk_anchors)
    assert got.dtypes == [tuple(c.split()[:2]) if c.split()[1] != "long" else (c.split()[0], "bigint") for c in B.RESULT.split(", ")]
    want = brute(rows, every=10)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 300


def test_large_components_stay_exact(spark):
    rows = [(i, [c * 100_000 for c in v], n) for i, v, n in random_rows(80)]
    assert {tuple(r) for r in B.hard_negatives(frame(spark, rows), F.col("label"), every=10).collect()} == brute(rows, every=10)
    huge = [(i, [c * 1e12 for c in v], n) for i, v, n in random_rows(20)]
    with pytest.raises(ValueError):
        B.hard_negatives(frame(spark, huge), F.col("label"), every=10)


def test_defined_cases(spark):
    rows = random_rows(100)
    bad = [(None, rows[0][1], 1), (500, None, 1), (501, [], 1), (502, [None] + [0.1] * 11, 1), (503, [float("nan")] * 12, 1),
           (504, [float("inf")] * 12, 1), (505, rows[1][1], None), (550, [1.0, 2.0], 1)]
    got = B.hard_negatives(frame(spark, rows + bad), F.col("label"), every=10)
    assert {tuple(r) for r in got.collect()} == brute(rows, every=10)
    assert B.hard_negatives(frame(spark, []), F.col("label")).count() == 0
    alone = B.hard_negatives(frame(spark, [(0, [1.0], 0), (1, [1.0], 1)]), F.col("label"))
    assert alone.count() == 0
    two = [(0, [1.0], 3), (0, [2.0], 2), (1, [1.0], 2), (2, [0.9], 5)]  # of two rows of vec_id 0 the smaller label counts
    assert {r.anchor_id for r in B.hard_negatives(frame(spark, two), F.col("label")).collect()} == {0}


def test_the_scan_leaves_rows_out_before_all_dimensions_are_read():
    draw = np.random.default_rng(1)
    matrix = np.floor(256 * draw.normal(size=(64, 4000)) * np.geomspace(1, 0.01, 64)[:, None]).astype(np.int64)
    block = B.Block(np.arange(4000).tobytes(), np.zeros(4000, np.int64).tobytes(), matrix.tobytes(), np.float64)
    seen = []

    def left(low, high):
        stay = B.among_largest(5)(low, high)
        seen.append(int(stay.sum()))
        return stay

    vector = matrix[:, 17].astype(np.float64)
    rows, scores = block.scan(vector, np.arange(4000), left)
    want = vector @ matrix
    assert set(np.argsort(-want, kind="stable")[:5]) <= set(rows.tolist()) and np.array_equal(scores, want[rows])
    assert seen == sorted(seen, reverse=True) and seen[2] < 500 and seen[-1] == 5


def test_query_equals_sql(spark, corpus):
    message, rows = difference(spark, connect(corpus), QUERIES["op12_bond_hard_negatives"], SQL["op12_bond_hard_negatives"], corpus)
    assert message is None and rows > 0
