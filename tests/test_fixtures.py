"""Rules the supplied tables cannot trigger, each with a hit and a no-hit row."""

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.operators import answers as A
from siteglass.operators import crawl_graph as G
from siteglass.operators import jsonld as J
from siteglass.operators import observations as O
from siteglass.operators import opportunities as P
from siteglass.operators import page_extract
from siteglass.operators import protocol_files as R
from siteglass.operators import query_intelligence as M
from siteglass.operators import scoring
from siteglass.operators import search_performance as I
from siteglass.operators import similarity as S
from siteglass.operators import site_issues as SI
from siteglass.operators import structured_data as Q
from siteglass.operators import vitals as V
from siteglass.operators.components import connected_components
from siteglass.operators.substring_join import contained_in
from siteglass.sources import evidence_log as E

AS_OF = dt.datetime(2026, 9, 21)


def one(spark, sql, **values):
    return spark.range(1).selectExpr(f"{sql} AS x").first().x


def scored(spark, html, status=200, version="1.0.0", url="https://a.test/p"):
    df = spark.createDataFrame([(url, html, status)], "url string, html string, http_status int")
    return scoring.with_scores(page_extract.with_page_facts(df, AS_OF), version)


FULL = (
    '<html lang="en"><head><title>A title of fitting length</title><meta name="description" content="' + "d" * 60 + '">'
    '<link rel="canonical" href="https://a.test/p"><meta name="viewport" content="w"><meta property="og:title" content="t">'
    '<meta property="og:image" content="i"><script type="application/ld+json">{"@type":"Article"}</script></head>'
    "<body><h1>One</h1><p>text</p></body></html>"
)


def levels(spark, html, status=200):
    return {c.check_id: c.level for c in scored(spark, html, status).first().checks}


def test_full_head_passes_every_check(spark):
    assert set(levels(spark, FULL).values()) == {"pass"}
    assert scored(spark, FULL).first().seo_score == 100


def test_bare_page(spark):
    got = levels(spark, "<html><body>x</body></html>")
    assert got["title"] == got["desc"] == "fail"
    assert got["canonical"] == got["h1"] == got["lang"] == "warn"


@pytest.mark.parametrize("status,level", [(200, "pass"), (301, "warn"), (404, "fail")])
def test_http_level(spark, status, level):
    assert levels(spark, FULL, status)["http"] == level


@pytest.mark.parametrize("missing,level", [(0, "pass"), (1, "warn"), (2, "fail")])
def test_alt_share(spark, missing, level):
    images = "<img>" * missing + '<img alt="x">' * (5 - missing)
    assert levels(spark, f"<body>{images}</body>")["alt"] == level


def test_unreachable_page(spark):
    row = scored(spark, "", 0).first()
    assert [c.check_id for c in row.checks] == ["fetch"] and row.seo_score == row.geo_score == 0


def test_noindex_closes_the_page(spark):
    row = scoring.geo_score(scored(spark, FULL.replace("</head>", '<meta name="robots" content="NoIndex"></head>'))).first()
    assert row.crawlability == 9


def test_heading_jump_and_tags_in_scripts(spark):
    df = spark.createDataFrame(
        [("u1", "<h1>a</h1><h3>b</h3>"), ("u2", "<h1>a</h1><h2>c</h2><h3>b</h3>"), ("u3", "<script>var x = '<p>';</script><p>y<p>z")],
        "url string, html string",
    ).withColumn("http_status", F.lit(200))
    rows = {r.url: r for r in page_extract.with_page_facts(df, AS_OF).collect()}
    assert not rows["u1"].heading_continuity and rows["u2"].heading_continuity
    assert rows["u3"].paragraphs == 3


def test_score_is_the_sum_of_its_parts(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").withColumn("http_status", F.lit(200))
    for version in scoring.SCORING:
        df = scoring.with_scores(page_extract.with_page_facts(pages, AS_OF), version)
        bad = df.where("geo_score <> aggregate(breakdown, 0, (a, d) -> a + d.score) OR geo_score > 100 OR geo_score < 0")
        assert bad.count() == 0


@pytest.mark.parametrize(
    "href,want",
    [
        ("/x", "https://a.test/x"), ("x", "https://a.test/d/x"), ("../y?q#f", "https://a.test/y?q#f"), ("//B.test", "https://b.test/"),
        ("?z=1", "https://a.test/d/p?z=1"), ("HTTP://C.test:80/é", "http://c.test/%C3%A9"), ("mailto:a@b.c", "mailto:a@b.c"),
    ],
)
def test_absolute_url(spark, href, want):
    assert one(spark, U.absolute_url(X.lit(href), X.lit("https://a.test/d/p?b=1#c"))) == want


@pytest.mark.parametrize(
    "raw,want",
    [("https://www.a.b.co.uk/x", "b.co.uk"), ("shop.example.com", "example.com"), ("www.example.com", "example.com"), ("localhost", "localhost")],
)
def test_registrable_domain(spark, raw, want):
    assert one(spark, U.registrable_domain(X.lit(raw))) == want


def test_crawl_url_and_canonical_url(spark):
    assert one(spark, U.crawl_url(X.lit("https://u:p@A.test/x/?b=2&a=1#f"))) == "https://a.test/x?a=1&b=2"
    assert one(spark, U.canonical_url(X.lit("https://u:p@A.test:443/x/?b=2&a=1#f"))) == "https://a.test/x?b=2&a=1"


def test_entities(spark):
    assert one(spark, X.decode_entities(X.lit("a &amp;&lt; &#39;&#20013;&#x1F600;"))) == "a &< '中😀"


def test_nodes_in_document_order_with_bad_json_ignored(spark):
    html = (
        '<script type="application/ld+json">{bad</script><script type="application/ld+json">'
        '{"@graph":[{"@type":"Article","author":{"@type":"Person","sameAs":"x"}},{"@type":["WebSite","Thing"]}]}</script>'
    )
    df = spark.createDataFrame([("u", html)], "url string, html string")
    assert [r.types for r in J.jsonld_nodes(df).orderBy("node_ordinal").collect()] == [["Article"], ["Person"], ["WebSite", "Thing"]]
    flags = J.jsonld_signals(df).first()
    assert flags.has_author and flags.has_author_same_as and not flags.has_organization


def test_node_depth_limit(spark):
    nested = '{"@type":"Deep"}'
    for _ in range(11):
        nested = '{"item":' + nested + "}"
    html = f'<script type="application/ld+json">{nested}</script><script type="application/ld+json">{nested[8:-1]}</script>'
    df = spark.createDataFrame([("u", html)], "url string, html string")
    assert J.jsonld_nodes(df, depth=10).count() == 1
    assert J.jsonld_nodes(df).count() == 2


def site(spark):
    base = dict(final_url=None, http_status=200, redirect_chain=[], title="t", description="d", h1="h", canonical=None, noindex=False,
                blocked_reason=None, word_count=10, geo_score=90, click_depth=0, jsonld_types=["X"])
    rows = [
        {"url": "/a", "title": "Guide"}, {"url": "/b", "title": "Guide "}, {"url": "/c", "title": "Guide", "noindex": True},
        {"url": "/d", "h1": None, "title": "d"}, {"url": "/e", "h1": "  ", "title": "e"},
        {"url": "/f", "canonical": "https://other.test/f", "title": "f"}, {"url": "/g", "canonical": "/gone", "title": "g"},
        {"url": "/h", "canonical": "/old", "title": "h"}, {"url": "/gone", "http_status": 404, "title": "x"},
        {"url": "/old", "redirect_chain": ["https://s.test/new"], "final_url": "https://s.test/new", "title": "o"},
        {"url": "/long", "redirect_chain": ["1", "2", "3"], "title": "l"},
        {"url": "/loop", "redirect_chain": ["https://s.test/loop"], "title": "lo"},
        {"url": "/deep2", "click_depth": 2, "title": "d2"}, {"url": "/deep3", "click_depth": 3, "title": "d3"},
    ]
    out = []
    for r in rows:
        row = {**base, **r}
        row["url"] = "https://s.test" + row["url"]
        row["final_url"] = row["final_url"] or row["url"]
        out.append(row)
    schema = (
        "url string, final_url string, http_status int, redirect_chain array<string>, title string, description string, h1 string, "
        "canonical string, noindex boolean, blocked_reason string, word_count int, geo_score int, click_depth int, jsonld_types array<string>"
    )
    return SI.with_site(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in out], schema))


def urls(df):
    return sorted(r.url.removeprefix("https://s.test") for r in df.collect())


def test_site_rules(spark):
    pages = site(spark)
    assert urls(SI.duplicates(pages).where("type = 'duplicate-title'")) == ["/a", "/b"]
    assert urls(SI.missing_fields(pages).where("type = 'missing-h1'")) == ["/d", "/e"]
    reasons = {r.url[-2:]: (r.reason, r.severity) for r in SI.canonical_anomalies(pages).collect()}
    assert reasons == {"/f": ("other-domain", "high"), "/g": ("target-error", "high"), "/h": ("target-redirects", "medium")}
    assert urls(SI.long_redirect_chains(pages)) == ["/long"]
    assert urls(SI.redirect_loops(pages)) == ["/loop"]
    assert urls(SI.deep_pages(pages)) == ["/deep3"]


def test_broken_links_count_a_source_once(spark):
    edges = spark.createDataFrame([("https://s.test/a", "https://s.test/gone")] * 2, "source string, target string")
    rows = SI.broken_internal_links(site(spark), edges).collect()
    assert [(r.url, r.group_key) for r in rows] == [("https://s.test/a", "https://s.test/gone")]


def test_issues_of_any_size_keep_all_members_and_an_order_free_id(spark):
    rows = [("s", "missing-h1", "medium", "", f"https://s/{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "site string, type string, severity string, group_key string, url string")
    small = SI.site_issues(df).first()
    dealt = SI.site_issues(df.repartition(7)).first()
    again = SI.site_issues(df.union(df).orderBy(F.desc("url"))).first()
    assert small.affected == 50 and small == dealt == again
    other = SI.site_issues(df.where("url <> 'https://s/7'").union(df.limit(1).withColumn("url", F.lit("https://s/x")))).first()
    assert other.affected == 50 and other.issue_id != small.issue_id


def test_hot_keys_are_dealt_over_tasks(spark):
    """Four fifths of the rows hold one key: no task of the join gets more than its share, and the result is the plain join's."""
    from siteglass.functions.rows import attach_by_key, held_by_key

    rows = spark.range(40_000).selectExpr("CASE WHEN id % 5 < 4 THEN 7 WHEN id % 25 = 4 THEN NULL ELSE id END AS k", "id")
    counts = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = attach_by_key(rows, counts, ["k"], "n", F.col("id"))
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / 8
        assert found.exceptAll(rows.join(counts, "k", "left")).count() == 0
        held = held_by_key(rows, "k", counts.select("k"), F.col("id"))
        assert held.exceptAll(rows.join(counts, "k", "left_semi")).count() == 0 and held.count() == rows.join(counts, "k", "left_semi").count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inlinks_and_orphans(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("b", "c"), ("a", "ghost")], "source string, target string")
    pages = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    got = {r.url: (r.inlinks, r.orphan) for r in G.graph_nodes(edges, pages, pages.where("url IN ('d', 'c')")).collect()}
    assert got == {"a": (0, False), "b": (1, False), "c": (2, False), "d": (0, True)}


def test_click_depth_ends_on_cycles_and_adds_sitemap_pages(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e")], "source string, target string")
    start, extra = spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("z",), ("c",)], "url string")
    got = {r.url: r.depth for r in G.click_depth(edges, start, extra, max_depth=3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "z": 3}
    got = {r.url: r.depth for r in G.click_depth(edges, start, extra).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "z": 4}


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[1000 + i] for i in range(30)} == {1000}


def brute_groups(sets, threshold):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in sets:
        groups.setdefault(find(k), set()).add(k)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def near_copies():
    """A template with many slightly different copies, exact copies, and unrelated texts."""
    sets = {}
    for i in range(40):
        sets[i] = {f"t{j}" for j in range(30)} - {f"t{i % 5}"} | {f"own{i}"}
    for i in range(40, 50):
        sets[i] = set(sets[3])
    for i in range(50, 70):
        sets[i] = {f"u{i}-{j % 9}" for j in range(i)} | {"t1", "t2"}
    for i in range(70, 80):
        sets[i] = {f"w{j}" for j in range(i - 70, i - 50)}
    return sets


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_duplicate_groups_against_brute_force(spark, threshold):
    sets = near_copies()
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, shingles array<string>")
    got = {}
    for r in S.duplicate_groups(df, threshold).collect():
        got.setdefault(r.group_id, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == brute_groups(sets, threshold)


def test_pairs_in_blocks_are_the_same_pairs(spark):
    rows = [(f"k{i % 3}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, id long")
    want = {tuple(sorted(p)) + (k,) for k in ("k0", "k1", "k2") for p in itertools.combinations([i for kk, i in rows if kk == k], 2)}
    for block in (3, 1000):
        got = [(min(r.a_id, r.b_id), max(r.a_id, r.b_id), r.key) for r in S.paired_by_key(df, "key", "id", block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_whole_text_shingles_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").limit(40).selectExpr("doc_id AS id", "text")
    sets = {r.id: set(r.shingles) for r in S.shingles(docs, None).collect()}
    capped = {r.id: set(r.shingles) for r in S.shingles(docs).collect()}
    assert sets.keys() == capped.keys() and all(capped[k] <= sets[k] for k in sets)
    got = {}
    for r in S.duplicate_groups(S.shingles(docs, None)).collect():
        got.setdefault(r.group_id, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == brute_groups(sets, 0.8)


@pytest.mark.parametrize("lists", [{"a": "1 2 3 4 5 6 7 8", "b": "7 8 9 10 11 12 13 14"}, {"a": "1 2 3", "b": "3 4"}, {"a": "1 2 3", "b": "3 4 5"}])
def test_query_overlap_rules(spark, lists):
    rows = [(q, u) for q, us in lists.items() for u in us.split()]
    sets = {q: set(us.split()) for q, us in lists.items()}
    shared = len(sets["a"] & sets["b"])
    hit = shared >= 2 or shared / len(sets["a"] | sets["b"]) >= 0.3
    assert M.query_overlap(spark.createDataFrame(rows, "query string, url string")).count() == int(hit)


def test_contained_in(spark):
    needles, hays = ["ab", "https://a.test/x", "zz", "q"], ["see https://a.test/x/y", "cab", "b", "q"]
    got = {(r.needle, r.hay) for r in contained_in(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hays], "hay string")).collect()}
    assert got == {(n, h) for n in needles for h in hays if n in h}


def rows_of(spark, rows):
    data = [([k], c, i, c / i if i else 0.0, float(p)) for k, c, i, p in rows]
    return spark.createDataFrame(data, "keys array<string>, clicks long, impressions long, ctr double, position double")


def test_search_thresholds(spark):
    df = rows_of(spark, [("a", 1, 99, 3.9), ("b", 1, 100, 4), ("c", 2, 100, 20), ("d", 0, 50, 20.1), ("e", 3, 49, 5), ("f", 3, 50, 5)])
    assert {r.key for r in I.high_impression_low_ctr(df).collect()} == {"b"}
    assert {r.key for r in I.ranking_opportunity(df).collect()} == {"b", "c", "f"}


def test_period_changes(spark):
    before = rows_of(spark, [("up", 0, 30, 5), ("rank", 5, 30, 9), ("tiny", 0, 19, 9), ("gone", 1, 30, 1), ("same", 5, 30, 5)])
    after = rows_of(spark, [("up", 10, 30, 5), ("rank", 5, 30, 6), ("tiny", 15, 19, 1), ("fresh", 1, 30, 1), ("same", 6, 30, 5)])
    got = {r.key: r.change for r in I.period_diff(before, after).collect()}
    assert got == {"up": "improved", "rank": "improved", "gone": "lost", "fresh": "new"}


@pytest.mark.parametrize("p75,want", [("0.1", "good"), ("0.1001", "needs-improvement"), ("0.25", "needs-improvement"), ("0.26", "poor")])
def test_vital_rating(spark, p75, want):
    df = spark.createDataFrame([("t", "cumulative_layout_shift", p75)], "target string, metric string, p75 string")
    assert V.vital_rating(df).first().category == want


@pytest.mark.parametrize(
    "text,status,want",
    [
        ("x" * 11, 200, "INDETERMINATE"), ("ACME is one of them", 200, "MENTIONED"), ("nothing of the kind", 200, "NOT_MENTIONED"),
        ("Sorry, I cannot recommend acme", 200, "INDETERMINATE"), ("acme acme acme", 401, "BLOCKED"), ("acme acme acme", 500, "ERROR"),
        (None, 200, "UNOBSERVABLE"), ("acme acme acme", 0, "ERROR"), (None, None, "UNOBSERVABLE"),
    ],
)
def test_answer_status(spark, text, status, want):
    df = spark.createDataFrame([(text, status, "Acme")], "answer string, http_status int, brand string")
    assert A.answer_status(df).first().status == want


def test_citations_are_trimmed_and_distinct(spark):
    text = "[One](https://a.test/x) then https://a.test/x) and www.b.test/y. end"
    df = A.with_citations(spark.createDataFrame([(text,)], "answer string"))
    assert [(c.url, c.title, c.position) for c in df.first().citations] == [
        ("https://a.test/x", "One", 0), ("https://www.b.test/y", None, text.index("www."))
    ]


def test_citation_diff_needs_an_earlier_record(spark):
    schema = "query string, model string, observed_at string, mentioned boolean, urls array<string>"
    shape = lambda rows: spark.createDataFrame(rows, schema).selectExpr(
        "query", "model", "cast(observed_at AS timestamp) AS observed_at", "mentioned",
        "transform(urls, u -> named_struct('url', u, 'title', '', 'position', 0)) AS citations", "'ok' AS citations_status")
    old = shape([("q", "m", "2024-01-01 10:00:00", False, ["a", "b"]), ("q", "m", "2023-12-01 10:00:00", True, ["z"]), ("q", "n", "2024-01-03 10:00:00", True, [])])
    new = shape([("q", "m", "2024-01-03 10:00:00", True, ["b", "c"]), ("q", "n", "2024-01-03 10:00:00", True, ["a"])])
    got = {r.model: r for r in A.citation_diff(old, new).collect()}
    assert (got["m"].mention, got["m"].citations_added, got["m"].citations_lost) == ("added", ["c"], ["a"])
    assert not got["n"].has_previous and got["n"].mention is None


def observation(**kw):
    base = dict(id="1", type="geo_score", subject="s", source="h", observed_at="2024-01-01 00:00:00", run_id=None, observer_version="o",
                parser_version="p", strategy_version=None, prompt_version=None, status="OBSERVED", result="{}", write_seq=1)
    return {**base, **kw}


def log_of(spark, rows):
    schema = (
        "id string, type string, subject string, source string, observed_at string, run_id string, observer_version string, parser_version string, "
        "strategy_version string, prompt_version string, status string, result string, write_seq long"
    )
    data = [tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows]
    return spark.createDataFrame(data, schema).selectExpr(
        "* EXCEPT (observed_at)", "cast(observed_at AS timestamp) AS observed_at", "array('e') AS evidence_refs",
        "cast(array() AS array<struct<signal:string,value:string>>) AS signals", "named_struct('expected', 1, 'observed', 1, 'ratio', 1D) AS coverage",
        "'medium' AS confidence", "cast(NULL AS string) AS status_reason",
    )


def changes(spark, a, b):
    log = log_of(spark, [observation(write_seq=1, **a), observation(id="2", observed_at="2024-01-02 00:00:00", write_seq=2, **b)])
    return [(r.kind, r.path, r.direction) for r in O.diff_observations(O.latest_pair(O.with_keys(log))).collect()]


@pytest.mark.parametrize("score,direction", [(54, "neutral"), (55, "improved"), (45, "degraded")])
def test_score_threshold(spark, score, direction):
    got = changes(spark, {"result": '{"seoScore": 50}'}, {"result": f'{{"seoScore": {score}}}'})
    assert got == [("VALUE", "result.seoScore", direction)]


@pytest.mark.parametrize("a,b,direction", [("null", 3, "improved"), (3, "null", "degraded"), (3, 5, "neutral"), (3, 6, "degraded"), (6, 3, "improved")])
def test_rank_threshold(spark, a, b, direction):
    got = changes(spark, {"type": "rank", "result": f'{{"targetRank": {a}}}'}, {"type": "rank", "result": f'{{"targetRank": {b}}}'})
    assert got == [("VALUE", "result.targetRank", direction)]


def test_mentions_and_unobservable_sides(spark):
    mention = lambda s: {"type": "ai_mention", "status": s}
    assert changes(spark, mention("NOT_MENTIONED"), mention("MENTIONED")) == [("STATUS", "status", "improved")]
    assert changes(spark, mention("UNOBSERVABLE"), mention("NOT_MENTIONED")) == [("STATUS", "status", "unknown")]
    assert changes(spark, {"parser_version": "p"}, {"parser_version": "q"}) == [("VERSION", "parserVersion", "unknown")]


def test_runs_versions_and_chains(spark):
    log = log_of(spark, [
        observation(id="a", run_id="r1", write_seq=1), observation(id="b", run_id="r1", write_seq=2, result='{"x": 1}'),
        observation(id="c", run_id="r2", write_seq=3, observed_at="2024-01-02 00:00:00"),
        observation(id="d", run_id="r3", write_seq=4, observed_at="2024-01-03 00:00:00", parser_version="p2"),
        observation(id="e", write_seq=5, subject="other"), observation(id="f", write_seq=6, subject="other"),
    ])
    kept = O.materialize_run(log)
    assert {r.id: r.result for r in kept.where("run_id = 'r1'").collect()} == {"a": '{"x": 1}'}
    for block in (1, 1000):
        assert {r.id: r.replaces for r in O.version_chain(kept, block).collect()} == {"a": None, "c": None, "d": "c", "e": None, "f": None}


def test_validation(spark):
    log = log_of(spark, [observation(id="ok"), observation(id="why", status="BLOCKED"), observation(id="", write_seq=3)])
    good, bad = O.split_valid(log)
    assert [r.id for r in good.collect()] == ["ok"]
    assert sorted(e for r in bad.collect() for e in r.errors) == ["id", "status_reason"]


def robots(spark, body):
    return R.site_robots(spark.createDataFrame([("s", body)], "site string, body string"))


@pytest.mark.parametrize(
    "body,path,allowed",
    [
        ("User-agent: *\nDisallow: /", "/x", False), ("User-agent: *\nDisallow: /\nUser-agent: mybot\nAllow: /", "/x", True),
        ("User-agent: *\nAllow: /x\nDisallow: /x", "/x", True), ("User-agent: *\nDisallow:", "/x", True),
        ("User-agent: other\nUser-agent: MyBot\nDisallow: /a # note", "/a/b", False), ("Sitemap: /s", "/x", True),
    ],
)
def test_robots_admission(spark, body, path, allowed):
    urls = spark.createDataFrame([("s", path)], "site string, path string")
    assert R.robots_admission(urls, robots(spark, body), "MyBot").first().allowed is allowed


def test_crawl_delay_groups_end_with_a_delay(spark):
    files = spark.createDataFrame([
        ("a", "User-agent: *\nCrawl-delay: 2\nUser-agent: mybot\nCrawl-delay: 7"), ("b", "User-agent: *\nCrawl-delay: x"), ("c", "User-agent: mybot\nCrawl-delay: -1"),
    ], "site string, body string")
    assert {r.site: r.delay for r in R.crawl_delay(files, "MyBot").collect()} == {"a": 7.0}


@pytest.mark.parametrize(
    "body,score,failed", [("# T\n> s\n## a\n## b\n" + "- [x](y)\n" * 5, 100, 0), ("plain", 30, 3), (None, 0, 1)]
)
def test_guide_score(spark, body, score, failed):
    row = R.guide_score(spark.createDataFrame([("s", body)], "site string, body string")).first()
    assert (row.score, row.failed_items) == (score, failed)


def test_redaction(spark):
    df = spark.createDataFrame([({"Authorization": "Bearer a", "X": "Basic abc", "Y": "v" * 130, "Z": "ok"},)], "h map<string,string>")
    got = df.selectExpr(f"{E.redact_headers('h')} AS h").first().h
    assert got == {"Authorization": "[REDACTED]", "X": "Basic [REDACTED]", "Y": "v" * 40 + "…[truncated 90]", "Z": "ok"}
    assert one(spark, E.redact_url(X.lit("https://a/x?mytoken=1&q=2&sig=3"))) == "https://a/x?mytoken=%5BREDACTED%5D&q=2&sig=%5BREDACTED%5D"


@pytest.mark.parametrize(
    "direction,a,b,want",
    [
        ("increase", 1, 2, "resolved"), ("increase", 2, 1, "worsened"), ("decrease", 2, 1, "resolved"), ("increase", 1, 1, "unchanged"),
        ("increase", "true", 1, "unknown"), ("appear", "false", "true", "resolved"), ("disappear", "true", "false", "resolved"),
        ("appear", "true", "false", "worsened"), ("disappear", "false", "false", "unchanged"),
    ],
)
def test_verification(spark, direction, a, b, want):
    row = spark.createDataFrame([("o", "t", "https://S.test", "result.k", direction)], "id string, type string, target string, signal_key string, direction string")
    seen = lambda v: spark.createDataFrame([("site:https://s.test", f'{{"k": {v}}}')], "subject string, result string").withColumn("observed_at", F.current_timestamp())
    assert P.verify_opportunities(row, seen(a), seen(b)).first().resolution == want


def test_opportunities_merge_by_target(spark):
    schema = "id string, type string, target string, impact string, effort string, evidence array<struct<signal:string,value:string>>, actions array<string>, signal_key string, direction string, affected_scope long"
    rows = [
        ("1", "missing-entity", "t", "low", "low", [("a", "1")], ["x"], "k1", "appear", 9),
        ("2", "weak-citeability", "t", "high", "medium", [("a", "1"), ("b", "2")], ["x", "y"], "k2", "increase", 1),
        ("3", "citation-gap", "u", "low", "low", [], ["x"], "k", "appear", 1),
    ]
    kept = P.supported([spark.createDataFrame(rows, schema)])
    row = P.merge_by_target(kept).first()
    assert (row.type, row.impact, row.effort, row.affected_scope, row.signal_key, row.merged) == ("weak-citeability", "high", "low", 9, "k2", 2)
    assert P.merged_evidence(kept).count() == 2 and P.merged_actions(kept).count() == 2


def test_text_agreement(spark):
    assert one(spark, Q.text_agrees(X.lit("Best Pumps | Shop"), X.lit("best  pumps")))
    assert not one(spark, Q.text_agrees(X.lit("Best Pumps"), X.lit("Best pumps of the year 2024 in review")))


def test_rounding_half_up(spark):
    assert one(spark, X.half_up("-2.5D")) == -2 and one(spark, X.half_up_1("2.25D")) == 2.3
    assert math.isclose(one(spark, X.half_up_1("0.05D")), 0.1)
