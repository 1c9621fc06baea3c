"""Joins of texts by rare pieces and of paths by their longest rule, against brute force and at sizes where all pairs would not end."""

import random

import pytest
from pyspark.sql import functions as F

from siteglass.operators import protocol_files as R
from siteglass.operators.substring_join import candidates, contained_in


def texts(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_contained_in_equals_brute_force(spark):
    draw = random.Random(4)
    word = lambda low, high: "".join(draw.choices("ab", k=draw.randint(low, high)))
    needles = sorted({word(1, 14) for _ in range(200)} | {"", "äöü-äöü-äöü", "b" * 40})
    hays = sorted({word(0, 60) for _ in range(120)} | {"x äöü-äöü-äöü y", "b" * 50, "ab" * 30})
    want = {(n, h) for n in needles for h in hays if n and h and n in h}
    assert {tuple(r) for r in contained_in(texts(spark, needles, "needle"), texts(spark, hays, "hay")).collect()} == want
    numbered = [texts(spark, [v for v in values if v], name).withColumn(f"{name}_no", F.monotonically_increasing_id()) for values, name in ((needles, "needle"), (hays, "hay"))]
    pairs = candidates(*numbered, block=3).join(numbered[0], "needle_no").join(numbered[1], "hay_no").where("contains(hay, needle)")
    assert {(r.needle, r.hay) for r in pairs.collect()} == want  # heavy pieces in many blocks
    assert contained_in(texts(spark, [], "needle"), texts(spark, hays, "hay")).count() == 0
    assert contained_in(texts(spark, needles, "needle"), texts(spark, [], "hay")).count() == 0


@pytest.mark.parametrize("form", ["https://shop.example/items/{}/description-and-details.html", "{}-the-same-long-ending-of-every-address", "the-same-long-beginning-of-every-address-{}"])
def test_a_common_ending_or_beginning_makes_no_candidates(spark, form):
    needles = spark.range(20_000).select(F.col("id").alias("needle_no"), F.format_string(form.replace("{}", "%06d"), "id").alias("needle"))
    hays = spark.range(3_000).select(F.col("id").alias("hay_no"), F.concat(F.lit("see "), F.format_string(form.replace("{}", "%06d"), F.col("id") * 11), F.lit(" there")).alias("hay"))
    found = candidates(needles, hays)
    hits = needles.where("needle_no % 11 = 0 AND needle_no < 33000").count()
    assert hits <= found.count() <= 3 * hits


def longest_rule(rules, path):
    path = path or "/"
    fits = [(len(p), allow, p) for p, allow in rules if p and (p == "/" or path.startswith(p))]
    return max(fits) if fits else None


def test_admission_by_the_longest_rule(spark):
    draw = random.Random(9)
    piece = lambda: "".join(draw.choices("ab/", k=draw.randint(0, 6)))
    files, urls, want = [], [], {}
    for site in ("s1", "s2", "s3"):
        rules = [("/" + piece() if draw.random() < 0.9 else piece(), draw.random() < 0.5) for _ in range(60)]
        rules += [("/", False)] if site == "s2" else []
        files.append((site, "User-agent: *\n" + "\n".join(f"{'Allow' if allow else 'Disallow'}: {path}" for path, allow in rules)))
        for _ in range(200):
            path = draw.choice(["", "x" + piece(), "/" + piece() + piece()])
            urls.append((site, path))
            best = longest_rule(rules, path)
            want[site, path] = (best[1] if best else True, f"{'Allow' if best[1] else 'Disallow'}: {best[2]}" if best else None)
    urls += [("unknown", "/a"), (None, "/a"), ("s1", None)] + urls[:30]
    want |= {("unknown", "/a"): (True, None), (None, "/a"): (True, None), ("s1", None): want.get(("s1", ""), None)}
    frame = spark.createDataFrame([(s, p, i) for i, (s, p) in enumerate(urls)], "site string, path string, no int")
    robots = R.site_robots(spark.createDataFrame(files + [("empty", "")], "site string, body string"))
    got = R.robots_admission(frame, robots, "anybot").collect()
    assert len(got) == len(urls) and got[0].__fields__ == ["site", "path", "no", "allowed", "rule"]
    for r in got:
        if want[r.site, r.path] is not None:
            assert (r.allowed, r.rule) == want[r.site, r.path], r


def test_admission_of_many_paths_under_many_rules(spark):
    body = "User-agent: *\n" + "\n".join(f"Disallow: /p{i}/" for i in range(0, 20_000, 2))
    robots = R.site_robots(spark.createDataFrame([("s", body)], "site string, body string"))
    urls = spark.range(200_000).select(F.lit("s").alias("site"), F.format_string("/p%d/page", F.col("id") % 20_000).alias("path"))
    counts = R.robots_admission(urls, robots, "anybot").groupBy("allowed").count().collect()
    assert {r.allowed: r["count"] for r in counts} == {True: 100_000, False: 100_000}
