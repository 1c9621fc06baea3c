"""Merged opportunities hold all different evidence and actions of their target."""

from siteglass.operators import opportunities as P
from siteglass.plans.catalog import registered

SCHEMA = "id string, type string, target string, impact string, effort string, evidence array<struct<signal:string,value:string>>, actions array<string>, signal_key string, direction string, affected_scope long"


def test_merged_rows_hold_their_evidence_and_actions(spark):
    rows = [
        ("1", "missing-entity", "t", "low", "low", [("b", "2"), ("a", None)], ["x", "y"], "k1", "appear", 9),
        ("2", "weak-citeability", "t", "high", "medium", [("a", "1"), ("b", "2")], ["y", "z"], "k2", "increase", 1),
        ("2", "weak-citeability", "t", "high", "medium", [("a", "1"), ("b", "2")], ["y", "z"], "k0", "increase", 1),
        ("3", "citation-gap", "u", "low", "low", [("c", "3")], ["x"], "k", "appear", 1),
    ]
    merged = {r.target: r for r in P.merge_by_target(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(e) for e in merged["t"].evidence] == [("a", None), ("a", "1"), ("b", "2")]
    assert merged["t"].actions == ["x", "y", "z"] and merged["t"].signal_key == "k0"
    assert [tuple(e) for e in merged["u"].evidence] == [("c", "3")] and merged["u"].actions == ["x"]


def test_the_query_says_what_its_long_forms_say(spark, folder):
    queries = registered()[0]
    said, done = {}, {}
    for r in queries["merged_evidence"](spark, folder).collect():
        said.setdefault(r.target, []).append(f"{r.signal}={r.value}")
    for r in queries["merged_actions"](spark, folder).collect():
        done.setdefault(r.target, []).append(r.action)
    rows = queries["merge_by_target"](spark, folder).collect()
    assert {r.target: r.evidence for r in rows} == {t: " | ".join(sorted(e)) for t, e in said.items()}
    assert {r.target: r.actions for r in rows} == {t: " | ".join(sorted(a)) for t, a in done.items()}
