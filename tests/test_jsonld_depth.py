"""Structured data is followed to its end, in document order, and a depth is a filter of who asks for it."""

import json

from siteglass.operators import jsonld as J


def page(spark, *documents):
    html = "".join(f'<script type="application/ld+json">{json.dumps(d)}</script>' for d in documents)
    return spark.createDataFrame([("u", html), ("none", "<p>x</p>"), ("bad", '<script type="application/ld+json">{[}</script>')], "url string, html string")


def nested(depth):
    node = {"@type": f"T{depth}", "sameAs": "https://x"}
    for level in range(depth - 1, -1, -1):
        node = {"@type": f"T{level}", ("author" if level == 3 else "mainEntity"): node}
    return node


def test_nodes_at_level_thirty_are_found(spark):
    found = J.jsonld_nodes(page(spark, nested(30), {"@type": "After"})).orderBy("node_ordinal").collect()
    assert [r.types for r in found] == [[f"T{i}"] for i in range(31)] + [["After"]]
    signals = {r.url: r for r in J.jsonld_signals(page(spark, nested(30))).collect()}
    assert len(signals["u"].types) == 31 and signals["u"].has_same_as and signals["u"].has_author_same_as
    assert signals["none"].types == signals["bad"].types == []


def test_depth_is_a_filter(spark):
    pages = J.with_blocks(page(spark, nested(30)))
    rows = {r.url: r for r in J.with_nodes(pages, depth=10).collect()}
    assert [n.types[0] for n in rows["u"].nodes] == [f"T{i}" for i in range(11)] and [n.depth for n in rows["u"].nodes] == list(range(11))
    assert rows["none"].nodes == rows["bad"].nodes == []
    assert len(J.with_signals(pages, depth=8).where("url = 'u'").first().ld.types) == 9


def test_arrays_and_graphs_keep_document_order(spark):
    document = [{"@graph": [{"@type": ["A", "B"], "offers": [{"@type": "O1"}, {"@type": "O2"}]}, {"@type": "C"}]}, {"@type": "D", "author": {"@type": "P"}}]
    found = J.jsonld_nodes(page(spark, document)).orderBy("node_ordinal").collect()
    assert [r.types for r in found] == [["A", "B"], ["O1"], ["O2"], ["C"], ["D"], ["P"]]
