"""Links of the trees against all pairs, and component rounds over few edges."""

import numpy as np

from siteglass.llm.trie_join import Threshold, tree_links
from siteglass.operators.components import connected_components, joined_nodes


def test_tree_links_connect_what_all_pairs_connect():
    draw = np.random.default_rng(4)
    sets = []
    for _ in range(25):
        sets.append(np.unique(draw.integers(0, 1 << 63, 300, dtype=np.uint64)))
        for _ in range(draw.integers(0, 6)):
            sets.append(np.unique(np.append(np.delete(sets[-1], draw.integers(0, len(sets[-1]), 9)), draw.integers(0, 1 << 63, 9, dtype=np.uint64))))
    keys = draw.permutation(len(sets)).tolist()
    labels = [k if draw.random() < 0.8 else keys[max(0, i - 1)] for i, k in enumerate(keys)]
    threshold = Threshold(85)

    def roots(pairs):
        leader = {k: k for k in keys} | {label: label for label in labels}

        def find(x):
            while leader[x] != x:
                x = leader[x]
            return x

        for a, b in [*zip(keys, labels), *pairs]:
            leader[find(a)] = find(b)
        return [[find(a) == find(b) for a in keys] for b in keys]

    every = [(keys[i], keys[j]) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and threshold.similar(len(np.intersect1d(a, b)), len(a), len(b))]
    links = tree_links(sets, keys, labels, threshold)
    assert roots(links) == roots(every) and len(links) < len(every)
    # Stars: no set is linked twice.
    assert len({a for a, _ in links}) == len(links) and all(b < a for a, b in links)


def test_rounds_over_few_edges_write_few_files(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a long, b long")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("40", "false")):
            spark.conf.set(name, value)
        found = connected_components(edges)
        assert 0 < len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, found.collect())) == [(i, i - i % 20) for i in range(60)]
        labels = joined_nodes(edges, rounds=1).collect()
        assert len(labels) == 60 and all(r.label // 20 == r.node // 20 and r.label <= r.node for r in labels)
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
