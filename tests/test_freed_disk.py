"""Long jobs free the shuffle files of a step before the next one, so that they do not add up on disk."""

import os
import random

from siteglass.operators import crawl_graph as G
from siteglass.operators import similarity as S
from siteglass.session import ensure_checkpoint_dir, stored


def shuffle_bytes(spark) -> int:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = (os.path.join(root, f) for folder in folders for root, _, names in os.walk(folder.getPath()) for f in names if f.startswith("shuffle_"))
    return sum(os.path.getsize(f) for f in files if os.path.exists(f))


def test_click_depth_leaves_no_links_behind(spark):
    links = spark.range(0, 120_000, 1, 8).selectExpr("concat('https://s.test/', id DIV 3) AS source", "concat('https://s.test/', id) AS target")
    start = spark.createDataFrame([("https://s.test/0",)], "url string")
    before = shuffle_bytes(spark)
    found = G.click_depth(links, start)
    left = shuffle_bytes(spark) - before
    assert found.count() == 120_000 and found.agg({"depth": "max"}).first()[0] == 11
    assert left < 1_000_000


def sets_of(spark, sizes, keep):
    """Sets of the given sizes, each with a copy that keeps so many of its members and has as many others."""
    draw = random.Random(5)
    rows = []
    for i, size in enumerate(sizes):
        own = [f"{draw.getrandbits(48):012x}" for _ in range(size)]
        rows += [(f"a{i}", own), (f"b{i}", own[: int(size * keep)] + [f"{draw.getrandbits(48):012x}" for _ in range(size - int(size * keep))])]
    return rows, spark.createDataFrame(rows, "id string, shingles array<string>")


def test_sketches_never_claim_too_many_differences(spark):
    sizes = [1, 5, 60, 127, 128, 129, 1000, 5000]
    rows, sets = sets_of(spark, sizes, 0.9)
    held = {i: set(s) for i, s in rows}
    keyed = S.numbered_sets(sets).select("id", "sketch")
    pairs = keyed.selectExpr("id AS a", "sketch AS _a").crossJoin(keyed.selectExpr("id AS b", "sketch AS _b"))
    told = {(r.a, r.b): r.d for r in pairs.selectExpr("a", "b", f"{S._differing('_a', '_b')} AS d").collect()}
    assert len(told) == len(rows) ** 2
    assert all(d <= len(held[a] ^ held[b]) for (a, b), d in told.items())
    assert told["a7", "b7"] > 0 and told["a6", "b5"] > 0.111 * 1128  # unlike sets are seen to be unlike


def test_unlike_candidates_are_not_moved(spark, monkeypatch):
    _, like = sets_of(spark, [400] * 30, 0.93)
    _, unlike = sets_of(spark, [400] * 30, 0.5)
    keyed = S.numbered_sets(like.union(unlike.selectExpr("concat('u', id) AS id", "shingles")))
    side = lambda name, letter: keyed.where(f"id rlike '^u?{letter}'").selectExpr(f"no AS {name}", f"replace(id, '{letter}', '') AS at")
    pairs = side("a", "a").join(side("b", "b"), "at").select("a", "b")
    moved = {}

    def counted(df, name="step", *rest):
        table = stored(df, name, *rest)
        moved[name] = table.count()
        return table

    monkeypatch.setattr(S, "stored", counted)
    assert S.verified(pairs, keyed, 0.8).count() == 30
    assert moved["pairs"] == 60 and moved["near"] == 30


def test_near_copies_keep_only_their_groups(spark):
    _, sets = sets_of(spark, [100] * 200, 0.93)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = S.duplicate_groups(sets)
    names = [f.split("-")[0] for f in set(os.listdir(folder)) - before]
    assert not {"sets", "index", "labels"} & set(names) and names.count("groups") == 1
    assert {tuple(sorted(g)) for g in by_group(found)} == {(f"a{i}", f"b{i}") for i in range(200)}


def by_group(found) -> list[list[str]]:
    groups = {}
    for r in found.collect():
        groups.setdefault(r.group_id, []).append(r.id)
    return list(groups.values())
