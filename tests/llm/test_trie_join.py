"""The trie join against a comparison of all pairs."""

import random
import re

import pyarrow.parquet as pq
import pytest

from siteglass.llm import trie_join
from siteglass.llm.queries import QUERIES
from siteglass.llm.trie_join import one_of_each_component, similarity_components
from tests.llm.conftest import table


def shingles(text, words):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words, percent):
    sets = [shingles(text, words) for _, text in rows]
    leader = list(range(len(rows)))

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                leader[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_query_over_its_table(spark, corpus):
    rows = pq.read_table(f"{corpus}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = brute([(r["doc_id"], r["text"]) for r in rows], 4, 85)
    assert sorted(map(tuple, QUERIES["op3_trie_jaccard"](spark, corpus).collect())) == expected
    assert sum(a != c for a, _, c in expected) > 50


@pytest.mark.parametrize("seed,percent,cluster", [(1, 85, 2048), (3, 60, 4)])
def test_random_families(spark, monkeypatch, seed, percent, cluster):
    """Small blocks, chains of near copies, passages that all share, and copies; also where components are too large."""
    monkeypatch.setattr(trie_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(trie_join, "CLUSTER_SETS", cluster)
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + draw.choice("klmnop")
    passage = [word() for _ in range(12)]
    rows = []
    for family in range(12):
        text = [word() for _ in range(draw.choice([2, 6, 25, 60]))] + (passage if family % 2 else [])
        for _ in range(draw.choice([1, 3, 9])):
            rows.append((len(rows), " ".join(text)))
            if draw.random() < 0.8:
                text = list(text)
                text[draw.randrange(len(text))] = word()
    rows += [(len(rows) + i, " ".join(passage * n)) for i, n in enumerate([1, 1, 2, 3])]
    draw.shuffle(rows)
    found = similarity_components(table(spark, rows).repartition(4), 4, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, 4, percent)


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one  TWO"), (3, "one two"), (3, "one two"), (None, "x y z"), (None, "q"), (20, long), (21, long + " end"), (22, "Ä b c d e"), (23, "ä b c d e")]
    found = sorted(similarity_components(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in found}
    assert got == {(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (9, 1, 3), (3, 1, 3), (None, 1, None), (20, 29996, 20), (21, 29997, 20), (22, 1, 22), (23, 1, 23)}
    assert len(found) == len(rows)
    kept = one_of_each_component(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [20, 22, 23, 3, 5, 6, 7, None, None]


def test_empty_table(spark):
    assert similarity_components(table(spark, [])).count() == 0
    assert one_of_each_component(table(spark, [])).count() == 0
