"""Queries over sites: links and graph, issues, near duplicates, alternates, protocol files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import spread
from siteglass.operators import crawl_graph as G
from siteglass.operators import findings as D
from siteglass.operators import hreflang as L
from siteglass.operators import page_extract as P
from siteglass.operators import protocol_files as R
from siteglass.operators import similarity as S
from siteglass.operators import site_issues as I
from siteglass.operators.components import connected_components
from siteglass.plans.catalog import Tables, query
from siteglass.plans.page_queries import LINK_CTE, facts
from siteglass.session import ensure_checkpoint_dir
from siteglass.sources import carriers as C
from siteglass.sources import tables as T

BASE = "https://shop.example.com/o/"


def pages(t: Tables):
    return I.with_site(C.site_pages(t.orders))


def edges(t: Tables):
    return C.site_links(t.lineitem)


def sitemap(t: Tables):
    return C.site_pages(t.orders).where("word_count >= 200").select("url")


# The order-free digest of an issue's pages, as the operator forms it.
DIGEST = (
    "count(*) || '/' || sum(CAST('0x' || substr(sha1(url), 1, 8) AS BIGINT)) || '/' || sum(CAST('0x' || substr(sha1(url), 9, 8) AS BIGINT))"
)

# The site of the carriers in SQL.
SITE = f"""WITH site_page AS (
  SELECT *, '{BASE}' || o_orderkey AS url, CASE o_orderstatus WHEN 'P' THEN 404 ELSE 200 END AS status, month(o_orderdate) AS m,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'Orders of customer ' || o_custkey || ' ' || o_orderpriority END AS title,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN 'Bought on ' || strftime(o_orderdate, '%Y-%m-%d') END AS description,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'Customer ' || o_custkey END AS h1,
    CAST(floor(o_totalprice / 1000) AS INTEGER) AS words, CAST(floor(o_totalprice) AS BIGINT) % 100 AS geo
  FROM orders
), ok AS (SELECT * FROM site_page WHERE status = 200 AND m NOT IN (11, 12)
), link AS (SELECT DISTINCT '{BASE}' || l_orderkey AS source, '{BASE}' || l_partkey AS target FROM lineitem
), inlink AS (SELECT target AS url, count(*) AS inlinks FROM link WHERE target IN (SELECT url FROM site_page) GROUP BY target
), node AS (SELECT url, coalesce(inlinks, 0) AS inlinks, words >= 200 AND coalesce(inlinks, 0) = 0 AS orphan FROM site_page LEFT JOIN inlink USING (url)
), dup AS (
  SELECT 'duplicate-' || field AS type, value AS group_key, url FROM (
    SELECT url, unnest([{{'f': 'title', 'v': title}}, {{'f': 'meta-description', 'v': description}}, {{'f': 'h1', 'v': h1}}], recursive := true) FROM ok
  ) AS x(url, field, value) WHERE value IS NOT NULL QUALIFY count(*) OVER (PARTITION BY field, value) > 1
), canon AS (
  SELECT p.url, CASE WHEN o_orderpriority = '1-URGENT' THEN 'other-domain' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'invalid-url'
    WHEN o_orderpriority = '3-MEDIUM' THEN (SELECT CASE WHEN q.status = 404 THEN 'target-error'
      WHEN q.m IN (1, 3) OR (q.m = 2 AND q.o_custkey <> q.o_orderkey) THEN CASE WHEN q.m = 2 THEN 'target-redirects' END END FROM site_page q WHERE q.o_orderkey = p.o_custkey)
    WHEN o_orderpriority = '5-LOW' AND p.m = 2 AND p.o_custkey <> p.o_orderkey THEN 'target-redirects' END AS reason FROM ok p
), weak AS (
  SELECT url, 'quotability' AS dimension FROM ok WHERE (CAST(floor(o_totalprice) AS BIGINT) % 26) / 25 < 0.6
  UNION ALL SELECT url, 'entity' FROM ok WHERE (CAST(floor(o_totalprice) AS BIGINT) % 16) / 15 < 0.6
), member AS (
  SELECT type, 'medium' AS severity, group_key, url FROM dup
  UNION ALL SELECT 'missing-title', 'high', '', url FROM ok WHERE title IS NULL
  UNION ALL SELECT 'missing-meta-description', 'medium', '', url FROM ok WHERE description IS NULL
  UNION ALL SELECT 'missing-h1', 'medium', '', url FROM ok WHERE h1 IS NULL
  UNION ALL SELECT 'missing-canonical', 'medium', '', url FROM ok WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT 'canonical-anomaly', CASE WHEN reason IN ('other-domain', 'target-error') THEN 'high' ELSE 'medium' END, url, url FROM canon WHERE reason IS NOT NULL
  UNION ALL SELECT 'orphan-page', 'medium', '', url FROM node WHERE orphan
  UNION ALL SELECT 'deep-page', 'low', '', url FROM ok WHERE day(o_orderdate) % 5 > 2
  UNION ALL SELECT 'low-inlinks', 'low', '', url FROM ok JOIN node USING (url) WHERE inlinks < 2 AND NOT orphan
  UNION ALL SELECT 'long-redirect-chain', 'low', url, url FROM site_page WHERE m = 1
  UNION ALL SELECT 'redirect-loop', 'high', url, url FROM site_page WHERE m = 3 OR (m = 2 AND o_custkey = o_orderkey)
  UNION ALL SELECT DISTINCT 'broken-internal-link', 'high', target, source FROM link JOIN site_page b ON b.url = target AND b.status = 404
    JOIN site_page s ON s.url = source AND s.status = 200 AND s.m <> 11
  UNION ALL SELECT 'missing-structured-data', 'low', '', url FROM ok WHERE words >= 100 AND m NOT IN (4, 5, 6)
  UNION ALL SELECT 'low-geo-score', CASE WHEN geo < 40 THEN 'high' ELSE 'medium' END, CASE WHEN geo < 40 THEN 'critical' ELSE 'poor' END, url FROM ok WHERE geo < 60
  UNION ALL SELECT 'weak-geo-dimension', 'medium', dimension, url FROM weak QUALIFY count(*) OVER (PARTITION BY dimension) >= 3
), issue AS (
  SELECT 'shop.example.com' AS site, type, severity, group_key, count(*) AS affected, min(url) AS first_url,
    type || ':' || substr(sha1(type || '|' || {DIGEST}), 1, 8) AS issue_id
  FROM member GROUP BY type, severity, group_key
)
"""


def members_of(kind: str) -> str:
    return SITE + f"SELECT 'shop.example.com' AS site, type, severity, group_key, url FROM member WHERE type = '{kind}'"


def _issue_query(name: str, kinds: list[str], build):
    listed = ", ".join(f"'{k}'" for k in kinds)
    sql = SITE + f"SELECT 'shop.example.com' AS site, type, severity, group_key, url FROM member WHERE type IN ({listed})"
    query(name, sql)(lambda t: build(t).select(*I.MEMBER))


_issue_query("duplicate_fields", ["duplicate-title", "duplicate-meta-description", "duplicate-h1"], lambda t: I.duplicates(pages(t)))
_issue_query(
    "missing_fields", ["missing-title", "missing-meta-description", "missing-h1", "missing-canonical"], lambda t: I.missing_fields(pages(t))
)
_issue_query("canonical_anomaly", ["canonical-anomaly"], lambda t: I.canonical_anomalies(pages(t)))
_issue_query("orphan_page", ["orphan-page"], lambda t: I.orphan_pages(G.graph_nodes(edges(t), pages(t), sitemap(t))))
_issue_query("deep_page", ["deep-page"], lambda t: I.deep_pages(pages(t)))
_issue_query("low_inlinks", ["low-inlinks"], lambda t: I.low_inlinks(pages(t), G.graph_nodes(edges(t), pages(t), sitemap(t))))
_issue_query("long_redirect_chain", ["long-redirect-chain"], lambda t: I.long_redirect_chains(pages(t)))
_issue_query("redirect_loop", ["redirect-loop"], lambda t: I.redirect_loops(pages(t)))
_issue_query("broken_internal_link", ["broken-internal-link"], lambda t: I.broken_internal_links(pages(t), edges(t)))
_issue_query("missing_structured_data", ["missing-structured-data"], lambda t: I.missing_structured_data(pages(t)))
_issue_query("low_geo_score", ["low-geo-score"], lambda t: I.low_geo_scores(pages(t)))
_issue_query("weak_geo_dimension", ["weak-geo-dimension"], lambda t: I.weak_dimensions(pages(t)))


@query("canonical_reasons", SITE + "SELECT url, reason FROM canon WHERE reason IS NOT NULL")
def _(t):
    return I.canonical_anomalies(pages(t)).select("url", "reason")


@query("duplicate_title", """
SELECT trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS raw_title, count(*) AS pages, min(url) AS first_url
FROM pages GROUP BY 1 HAVING count(*) > 1 AND raw_title <> ''""")
def _(t):
    raw = X.trim_blank(X.extract("html", "(?is)<title[^>]*>(.*?)</title>"))
    titled = t.pages.selectExpr("url", f"{raw} AS raw_title").where("raw_title <> ''")
    return titled.groupBy("raw_title").agg(F.count("*").alias("pages"), F.min("url").alias("first_url")).where("pages > 1")


@query("indexable_pages", SITE + "SELECT url FROM ok")
def _(t):
    return I.indexable(pages(t)).select("url")


@query("geo_distribution", SITE + """
SELECT 'shop.example.com' AS site, count(*) FILTER (geo < 40) AS critical, count(*) FILTER (geo BETWEEN 40 AND 59) AS poor,
  count(*) FILTER (geo BETWEEN 60 AND 79) AS fair, count(*) FILTER (geo >= 80) AS good FROM ok""")
def _(t):
    return I.geo_distribution(pages(t))


@query("lowest_scoring", SITE + "SELECT url, CAST(geo AS INTEGER) AS geo_score FROM ok ORDER BY geo, url LIMIT 10")
def _(t):
    return I.lowest_scoring(pages(t))


@query("common_weak_dimensions", SITE + "SELECT 'shop.example.com' AS site, dimension, count(*) AS pages FROM weak GROUP BY dimension")
def _(t):
    return I.common_weak_dimensions(pages(t))


@query("schema_coverage", SITE + """
SELECT 'shop.example.com' AS site, schema_type, count(*) AS pages, round(count(*) / (SELECT count(*) FROM ok), 9) AS ratio FROM (
  SELECT unnest(CASE WHEN m IN (4, 5) THEN ['Article', 'Person'] WHEN m = 6 THEN ['Product'] ELSE [] END) AS schema_type FROM ok) GROUP BY schema_type""")
def _(t):
    return I.schema_coverage(pages(t)).withColumn("ratio", F.round("ratio", 9))


@query("crawl_diff", SITE + """, a AS (SELECT url, status, title FROM site_page WHERE m <= 9), b AS (
  SELECT url, CASE WHEN words % 5 = 0 THEN 500 ELSE status END AS status, CASE WHEN words % 7 = 0 THEN NULL ELSE title END AS title FROM site_page WHERE m >= 4)
SELECT url, CASE WHEN a.status IS NULL THEN 'added' WHEN b.status IS NULL THEN 'removed'
  WHEN a.status <> b.status OR a.title IS DISTINCT FROM b.title THEN 'changed' ELSE 'unchanged' END AS change
FROM a FULL JOIN b USING (url)""")
def _(t):
    both = t.orders.select("o_orderkey", F.month("o_orderdate").alias("m")).selectExpr("o_orderkey AS page_id", "m")
    crawl = C.site_pages(t.orders).withColumn("title", F.expr("nullif(trim(title), '')")).join(both, "page_id")
    before = crawl.where("m <= 9")
    after = crawl.where("m >= 4").withColumns(
        {"http_status": F.expr("CASE WHEN word_count % 5 = 0 THEN 500 ELSE http_status END"), "title": F.expr("CASE WHEN word_count % 7 = 0 THEN NULL ELSE title END")}
    )
    return I.crawl_diff(before, after).select("url", "change")


@query("link_edges", LINK_CTE + r"""
SELECT DISTINCT regexp_replace(url, '^(https?)://', '\1://') AS source, regexp_replace(target, '/$', '') AS target FROM links
WHERE NOT regexp_matches(lower(target), '\.(css|js|mjs|png|jpg|jpeg|gif|svg|pdf|zip|webp|ico|woff|woff2|ttf|mp4|webm|mp3)$')""")
def _(t):
    return G.link_edges(spread(t.pages))


@query("crawl_url", r"""
SELECT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END ||
  CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS node
FROM (SELECT url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)""")
def _(t):
    return t.pages.select("url", F.expr(U.crawl_url("url")).alias("node"))


@query("crawl_scope", LINK_CTE + r"""
SELECT DISTINCT url AS source, regexp_replace(target, '/$', '') AS target FROM links
WHERE NOT regexp_matches(lower(target), '\.(css|js|mjs|png|jpg|jpeg|gif|svg|pdf|zip|webp|ico|woff|woff2|ttf|mp4|webm|mp3)$')""")
def _(t):
    return G.crawl_scope(P.page_links(facts(t)).selectExpr("url AS source", "target"))


@query("edge_closure", SITE + "SELECT source, target FROM link WHERE target IN (SELECT url FROM site_page)")
def _(t):
    return G.edge_closure(edges(t).distinct(), pages(t))


@query("inlink_counts", SITE + "SELECT url, inlinks FROM node")
def _(t):
    return G.inlink_counts(edges(t), pages(t))


@query("click_depth", f"""
WITH RECURSIVE link AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS d FROM lineitem), walk(node, depth) AS (
  SELECT 0, 0 UNION SELECT d, depth + 1 FROM walk JOIN link ON s = node WHERE depth < 60)
SELECT '{BASE}' || node AS url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""")
def _(t):
    start = C.site_pages(t.orders).orderBy("page_id").limit(1)
    return G.click_depth(edges(t), start)


@query("crawl_truncation", """
SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS site, count(*) AS found, least(count(*), 5) AS kept, count(*) >= 5 AS truncated,
  CASE WHEN count(*) >= 5 THEN 'page limit reached' END AS reason, round(least(1, count(*) / 5), 9) AS coverage FROM pages GROUP BY 1""")
def _(t):
    return G.crawl_truncation(I.with_site(t.pages), 5).withColumn("coverage", F.round("coverage", 9))


@query("crawl_rows", """
SELECT url, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#:]+)', 1) ORDER BY length(url) % 4, url) <= 5 AS kept FROM (SELECT DISTINCT url FROM pages)""")
def _(t):
    found = I.with_site(t.pages.select("url").distinct()).withColumn("click_depth", F.expr("length(url) % 4"))
    return G.crawl_rows(found, 5).select("url", "kept")


# The busiest site of a stored snapshot, read through its bucket.
@query("site_snapshot", """
WITH p AS (SELECT url, html, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages), busy AS (SELECT host FROM p GROUP BY host ORDER BY count(*) DESC, host LIMIT 1)
SELECT url, CAST(length(html) AS INTEGER) AS characters FROM p WHERE host = (SELECT host FROM busy)""")
def _(t):
    folder = f"{ensure_checkpoint_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    T.write_page_snapshot(T.as_snapshot(t.pages.repartition(8, "url")), folder)
    hosts = I.with_site(t.pages).groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").limit(1).collect()
    return T.site_snapshot(t.spark, folder, hosts[0].site if hosts else "").selectExpr("url", "length(html) AS characters")


@query("site_link_shortlist", LINK_CTE.replace("SELECT DISTINCT url, ", "SELECT url, min(i) AS i, ").replace(
    "(SELECT url, unnest(hrefs) AS h FROM page) WHERE h LIKE '/%'",
    "(SELECT url, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS i FROM page) WHERE h LIKE '/%' GROUP BY 1, 3",
) + r""", classed AS (
  SELECT url, target, i, CASE WHEN regexp_matches(lower(p), '^/(docs|documentation|help|guide|blog|product|solution|case|about|faq)') THEN 0 WHEN p = '/' THEN 1 ELSE 2 END AS path_class
  FROM (SELECT *, regexp_extract(target, '^https?://[^/]+(.*)$', 1) AS p FROM links)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY path_class, i) - 1 AS rank FROM classed QUALIFY row_number() OVER (PARTITION BY url ORDER BY path_class, i) <= 12
) SELECT url, CAST(rank AS INTEGER) AS rank, target, path_class, CASE WHEN rank < ceil(count(*) OVER (PARTITION BY url) / 2) THEN 'core' ELSE 'more' END AS section FROM ranked""")
def _(t):
    return G.site_link_shortlist(spread(t.pages))


# Parts and orders connected by lines, over the whole table.
@query("connected_components", """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, 1000000 + l_orderkey AS b FROM lineitem),
  both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = node WHERE root < b)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def _(t):
    links = t.lineitem.selectExpr("l_partkey AS a", "1000000 + l_orderkey AS b")
    return connected_components(links)


SHINGLES = """WITH token AS (
  SELECT doc_id AS id, regexp_extract_all(lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '\\s+', ' ', 'g'))), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]') AS k FROM documents
), placed AS (SELECT id, unnest(k) AS w, generate_subscripts(k, 1) AS p FROM token WHERE len(k) >= 50
), grams AS (
  SELECT id, w || '|' || lead(w, 1) OVER o || '|' || lead(w, 2) OVER o || '|' || lead(w, 3) OVER o || '|' || lead(w, 4) OVER o AS g FROM placed WINDOW o AS (PARTITION BY id ORDER BY p)
), shingled AS (SELECT id, list_sort(list(DISTINCT substr(sha1(g), 1, 12))) AS s FROM grams WHERE g IS NOT NULL GROUP BY id
)"""
PAIRS = """, folded AS (SELECT min(id) AS id, s FROM shingled GROUP BY s), gram AS (SELECT id, unnest(s) AS g FROM folded), overlap AS (
  SELECT x.id AS a, y.id AS b, count(*) AS shared FROM gram x JOIN gram y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2
), pair AS (
  SELECT a, b, shared, shared / (len(fa.s) + len(fb.s) - shared) AS jaccard FROM overlap JOIN folded fa ON fa.id = a JOIN folded fb ON fb.id = b
  WHERE shared / (len(fa.s) + len(fb.s) - shared) >= 0.8
)"""
GROUPS = PAIRS + """, edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair), walk(node, root) AS (
  SELECT id, id FROM folded UNION SELECT edge.b, root FROM walk JOIN edge ON edge.a = node WHERE root < edge.b
), label AS (SELECT node, min(root) AS group_id FROM walk GROUP BY node), member AS (
  SELECT group_id, shingled.id, count(*) OVER (PARTITION BY group_id) AS members FROM shingled JOIN folded USING (s) JOIN label ON label.node = folded.id)
SELECT group_id, id, members FROM member WHERE members > 1"""


def texts(t: Tables):
    return spread(t.documents).selectExpr("doc_id AS id", "text")


@query("shingles", SHINGLES + " SELECT id, len(s) AS n, md5(array_to_string(s, ',')) AS digest FROM shingled")
def _(t):
    return S.shingles(texts(t)).selectExpr("id", "cast(size(shingles) AS bigint) AS n", "md5(array_join(array_sort(shingles), ',')) AS digest")


@query("jaccard_pairs", SHINGLES + PAIRS + " SELECT a, b, shared, round(jaccard, 9) AS jaccard FROM pair")
def _(t):
    return S.jaccard_pairs(S.shingles(texts(t))).selectExpr("a", "b", "cast(shared AS bigint) AS shared", "round(jaccard, 9) AS jaccard")


@query("duplicate_groups", SHINGLES.replace("WITH token", "WITH RECURSIVE token") + GROUPS)
def _(t):
    return S.duplicate_groups(S.shingles(texts(t)))


def near_copies(t: Tables):
    named = texts(t).selectExpr("concat('https://docs.example.com/', id) AS id", "text")
    return S.duplicate_groups(S.shingles(named))


@query("duplicate_content", SHINGLES.replace("WITH token", "WITH RECURSIVE token") + GROUPS.replace(
    "SELECT group_id, id, members FROM member WHERE members > 1",
    "SELECT 'duplicate-content' AS type, 'medium' AS severity, 'https://docs.example.com/' || id AS url, count(*) OVER (PARTITION BY group_id) AS pages FROM member WHERE members > 1",
))
def _(t):
    rows = I.duplicate_content(near_copies(t))
    sizes = rows.groupBy("group_key").agg(F.count("*").alias("pages"))
    return rows.join(sizes, "group_key").select("type", "severity", "url", "pages")


# Language alternates.
ALTERNATES = """WITH lang_page AS (SELECT *, 'https://i18n.example.com/' || c_custkey AS url FROM customer), entry AS (
  SELECT url AS page_url, 'en' AS lang, url AS target, 'html' AS origin FROM lang_page WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT url, 'de', 'https://i18n.example.com/' || (c_custkey + 1), 'html' FROM lang_page WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT url, 'x-default', url, 'html' FROM lang_page WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT url, 'fr-FR', 'https://i18n.example.com/' || (c_custkey + 1), 'html' FROM lang_page WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL SELECT url, 'english', url, 'html' FROM lang_page WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT url, 'de', 'https://i18n.example.com/' || (c_custkey + 1), 'http-header' FROM lang_page WHERE c_mktsegment = 'HOUSEHOLD'
  UNION ALL SELECT url, 'es', 'https://i18n.example.com/' || (c_custkey + 2), 'sitemap' FROM lang_page WHERE c_mktsegment = 'FURNITURE'
), alt AS (
  SELECT DISTINCT 'hreflang-missing-self' AS type, 'high' AS severity, page_url AS url FROM entry GROUP BY page_url HAVING NOT bool_or(target = page_url AND lang <> 'x-default')
  UNION ALL SELECT DISTINCT 'hreflang-missing-reciprocal', 'high', page_url FROM entry e WHERE lang <> 'x-default' AND target IN (SELECT page_url FROM entry)
    AND NOT EXISTS (SELECT 1 FROM entry b WHERE b.page_url = e.target AND b.target = e.page_url)
  UNION ALL SELECT DISTINCT 'hreflang-invalid-lang', 'medium', page_url FROM entry WHERE lang = 'english'
  UNION ALL SELECT DISTINCT 'hreflang-broken-target', 'high', page_url FROM entry JOIN lang_page ON url = target WHERE c_nationkey IN (3, 4, 5)
  UNION ALL SELECT DISTINCT 'hreflang-canonical-conflict', 'medium', page_url FROM entry JOIN lang_page ON url = target WHERE c_nationkey = 6
  UNION ALL SELECT DISTINCT 'hreflang-missing-x-default', 'low', page_url FROM entry GROUP BY page_url HAVING NOT bool_or(lang = 'x-default')
  UNION ALL SELECT 'hreflang-lang-mismatch', 'low', url FROM lang_page WHERE c_nationkey IN (7, 8)
)
"""


def alternates(t: Tables):
    return L.hreflang_entries(C.language_pages(t.customer), C.language_sitemaps(t.customer))


@query("hreflang_entries", ALTERNATES + "SELECT page_url, lang, target, origin FROM entry")
def _(t):
    return alternates(t)


def _alternate_query(name: str, kind: str, build):
    query(name, ALTERNATES + f"SELECT type, severity, url FROM alt WHERE type = '{kind}'")(
        lambda t: build(alternates(t), C.language_pages(t.customer)).select("type", "severity", "url")
    )


_alternate_query("hreflang_missing_self", "hreflang-missing-self", lambda e, p: L.missing_self(e))
_alternate_query("hreflang_missing_reciprocal", "hreflang-missing-reciprocal", lambda e, p: L.missing_reciprocal(e))
_alternate_query("hreflang_invalid_lang", "hreflang-invalid-lang", lambda e, p: L.invalid_language(e))
_alternate_query("hreflang_broken_target", "hreflang-broken-target", L.broken_target)
_alternate_query("hreflang_canonical_conflict", "hreflang-canonical-conflict", L.canonical_conflict)
_alternate_query("hreflang_missing_x_default", "hreflang-missing-x-default", lambda e, p: L.missing_default(e))
_alternate_query("hreflang_lang_mismatch", "hreflang-lang-mismatch", lambda e, p: L.language_mismatch(p))


@query("hreflang_target_health", ALTERNATES + """
SELECT page_url, lang, target, CASE c_nationkey WHEN 3 THEN 'status' WHEN 4 THEN 'noindex' ELSE 'redirected' END AS reason
FROM entry JOIN lang_page ON url = target WHERE c_nationkey IN (3, 4, 5)""")
def _(t):
    return L.target_health(alternates(t), C.language_pages(t.customer))


@query("hreflang_issues", ALTERNATES + """
SELECT type, severity, count(*) AS affected, min(url) AS first_url,  'hreflang:' || CASE type
  WHEN 'hreflang-missing-self' THEN 'missing-self-reference' WHEN 'hreflang-invalid-lang' THEN 'invalid-lang-code'
  WHEN 'hreflang-lang-mismatch' THEN 'lang-mismatch-suspect' ELSE substr(type, 10) END || ':' || substr(sha1(""" + DIGEST + """), 1, 8) AS issue_id FROM alt GROUP BY type, severity""")
def _(t):
    issues = I.site_issues(L.hreflang_members(C.language_pages(t.customer), alternates(t)))
    return issues.select("type", "severity", "affected", "first_url", "issue_id")


def issues(t: Tables):
    """Issues of every kind, with near copies and language alternates."""
    members = I.all_members(pages(t), edges(t), sitemap(t), duplicate_of=near_copies(t))
    return I.site_issues(I.issue_members([members, L.hreflang_members(C.language_pages(t.customer), alternates(t))]))


def _steps(sql: str) -> str:
    """The named steps of a statement without what opens and closes it."""
    return sql.strip().removeprefix("WITH RECURSIVE ").removeprefix("WITH ").strip()


_COPIES = SHINGLES.replace("SELECT doc_id AS id", "SELECT 'https://docs.example.com/' || doc_id AS id") + GROUPS.replace("member AS (", "copy AS (").replace(
    "SELECT group_id, id, members FROM member WHERE members > 1", ""
)
HREFLANG_ID = """'hreflang:' || CASE type WHEN 'hreflang-missing-self' THEN 'missing-self-reference' WHEN 'hreflang-invalid-lang' THEN 'invalid-lang-code'
  WHEN 'hreflang-lang-mismatch' THEN 'lang-mismatch-suspect' ELSE substr(type, 10) END || ':'"""
#: The site's pages, near copies of texts and language alternates, and the issues of all of them.
EVERY_ISSUE = "WITH RECURSIVE " + _steps(SITE) + ", " + _steps(_COPIES) + ", " + _steps(ALTERNATES) + f""", every_member AS (
  SELECT 'shop.example.com' AS site, type, severity, group_key, url FROM member
  UNION ALL SELECT 'docs.example.com', 'duplicate-content', 'medium', group_id, id FROM copy WHERE members > 1
  UNION ALL SELECT 'i18n.example.com', type, severity, '', url FROM alt
), every_issue AS (
  SELECT site, type, severity, group_key, count(*) AS affected, min(url) AS first_url,
    CASE WHEN type LIKE 'hreflang-%' THEN {HREFLANG_ID} || substr(sha1({DIGEST}), 1, 8) ELSE type || ':' || substr(sha1(type || '|' || {DIGEST}), 1, 8) END AS issue_id
  FROM every_member GROUP BY site, type, severity, group_key
)
"""


@query("site_issues", EVERY_ISSUE + "SELECT site, type, severity, group_key, affected, first_url, issue_id FROM every_issue")
def _(t):
    return I.ordered(issues(t))


@query("multilingual_gate", "SELECT 'i18n.example.com' AS site, true AS is_multilingual, true AS has_language_signal FROM customer LIMIT 1")
def _(t):
    return L.multilingual_gate(C.language_pages(t.customer), alternates(t))


# Protocol files.
FILE_SITE = "'https://' || lower(replace(c_name, '#', '-')) || '.example.com'"
ROBOTS = f"""WITH robot_site AS (SELECT *, {FILE_SITE} AS site FROM customer), file AS (SELECT * FROM robot_site WHERE c_acctbal >= 0), rule AS (
  SELECT site, 1 AS group_no, '*' AS agent, '/private' AS path, false AS allow FROM file UNION ALL SELECT site, 1, '*', '/private/open', true FROM file
  UNION ALL SELECT site, 2, 'gptbot', '/', false FROM file WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT site, 2, u.agent, u.path, u.allow FROM (SELECT site, unnest([
    {{'agent': 'gptbot', 'path': '/', 'allow': true}}, {{'agent': 'gptbot', 'path': '/', 'allow': false}}, {{'agent': 'gptbot', 'path': '/a', 'allow': false}},
    {{'agent': 'claudebot', 'path': '/', 'allow': true}}, {{'agent': 'claudebot', 'path': '/', 'allow': false}}, {{'agent': 'claudebot', 'path': '/a', 'allow': false}}]) AS u
    FROM file WHERE c_mktsegment = 'AUTOMOBILE')
  UNION ALL SELECT site, 2, 'baiduspider', '/', false FROM file WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT site, 1, '*', '/', false FROM file WHERE c_mktsegment = 'HOUSEHOLD'
  UNION ALL SELECT site, 2, 'perplexitybot', '', false FROM file WHERE c_mktsegment = 'FURNITURE'
), crawler(agent, purpose, regional) AS (VALUES {", ".join(f"('{a}', '{p}', {str(r).lower()})" for a, p, r in R.CRAWLERS)}
), policy AS (
  SELECT site, agent, purpose, regional, CASE
    WHEN c_mktsegment = 'BUILDING' AND agent = 'GPTBot' THEN 'blocked'
    WHEN c_mktsegment = 'MACHINERY' AND lower(agent) IN ('baiduspider', 'baiduspider-render') THEN 'blocked'
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'blocked' ELSE 'allowed' END AS policy
  FROM file CROSS JOIN crawler
), guide AS (
  SELECT site, c_acctbal < 5000 AS guide_exists, CASE WHEN c_acctbal < 5000 AND c_nationkey % 4 <> 0 THEN c_name END AS title,
    c_acctbal < 5000 AND c_nationkey % 3 <> 0 AS has_summary, CASE WHEN c_acctbal < 5000 THEN c_nationkey % 5 ELSE 0 END AS sections,
    CASE WHEN c_acctbal < 5000 THEN c_nationkey % 7 ELSE 0 END AS links FROM robot_site
), rated AS (
  SELECT *, CASE WHEN title IS NOT NULL THEN 2 ELSE 0 END AS p1, CASE WHEN has_summary THEN 2 ELSE 1 END AS p2,
    CASE WHEN sections >= 2 THEN 2 WHEN sections = 1 THEN 1 ELSE 0 END AS p3, CASE WHEN links >= 5 THEN 2 WHEN links > 0 THEN 1 ELSE 0 END AS p4 FROM guide
), graded AS (
  SELECT *, CASE WHEN guide_exists THEN CAST(floor((p1 + p2 + p3 + p4 + 2) / 10 * 100 + 0.5) AS BIGINT) ELSE 0 END AS score,
    CASE WHEN guide_exists THEN CAST(p1 = 0 AS INTEGER) + CAST(p3 = 0 AS INTEGER) + CAST(p4 = 0 AS INTEGER) ELSE 1 END AS failed_items FROM rated
), openness AS (
  SELECT site, CAST(floor(count(*) FILTER (purpose <> 'index' AND policy = 'allowed') / count(*) FILTER (purpose <> 'index') * 100 + 0.5) AS BIGINT) AS openness,
    count(*) FILTER (purpose <> 'index' AND policy = 'blocked') AS blocked, CAST(0 AS BIGINT) AS unspecified FROM policy GROUP BY site
)
"""


def robots_bodies(t: Tables):
    return C.robots_files(t.customer).selectExpr("site", "robots AS body").where("body IS NOT NULL")


def robots(t: Tables):
    all_sites = C.robots_files(t.customer).select("site")
    return all_sites.join(R.site_robots(robots_bodies(t)), "site", "left")


def policies(t: Tables):
    return R.crawler_policies(robots(t))


def guides(t: Tables):
    return R.guide_score(C.robots_files(t.customer).selectExpr("site", "guide AS body"))


def protocol(t: Tables):
    return R.protocol_table(robots(t), policies(t), guides(t))


@query("robots_rules", ROBOTS + "SELECT site, CAST(group_no AS BIGINT) AS group_no, agent, path, allow FROM rule")
def _(t):
    return R.robots_rules(robots_bodies(t))


@query("robots_sitemaps", ROBOTS + "SELECT site, site || '/sm.xml' AS url FROM file")
def _(t):
    return R.robots_sitemaps(robots_bodies(t))


@query("crawl_delay", ROBOTS + """
SELECT site, CAST(c_nationkey AS DOUBLE) AS delay FROM file""")
def _(t):
    return R.crawl_delay(robots_bodies(t), "GPTBot")


@query("robots_admission", ROBOTS + """, path AS (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN '/private/x' WHEN '2-HIGH' THEN '/private/open/x' WHEN '3-MEDIUM' THEN '/a/b' ELSE '' END AS path FROM orders),
decided AS (
  SELECT site, path, CASE WHEN c_acctbal < 0 THEN NULL
    WHEN c_mktsegment = 'AUTOMOBILE' THEN CASE WHEN path LIKE '/a%' THEN 'Disallow: /a' ELSE 'Allow: /' END
    WHEN path LIKE '/private/open%' THEN 'Allow: /private/open' WHEN path LIKE '/private%' THEN 'Disallow: /private'
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Disallow: /' END AS rule
  FROM path JOIN robot_site ON c_custkey = o_custkey)
SELECT site, path, coalesce(rule NOT LIKE 'Dis%', true) AS allowed, rule, count(*) AS urls FROM decided GROUP BY ALL""")
def _(t):
    sites = C.robots_files(t.customer).select("site")
    keyed = t.customer.selectExpr("c_custkey AS o_custkey", "concat('https://', lower(replace(c_name, '#', '-')), '.example.com') AS site")
    path = "CASE o_orderpriority WHEN '1-URGENT' THEN '/private/x' WHEN '2-HIGH' THEN '/private/open/x' WHEN '3-MEDIUM' THEN '/a/b' ELSE '' END"
    urls = t.orders.selectExpr("o_custkey", f"{path} AS path").join(keyed, "o_custkey").select("site", "path")
    return R.robots_admission(urls, robots(t), "ClaudeBot").groupBy("site", "path", "allowed", "rule").agg(F.count("*").alias("urls"))


@query("crawler_policies", ROBOTS + "SELECT site, agent, purpose, regional, policy FROM policy")
def _(t):
    return policies(t)


@query("ai_openness", ROBOTS + "SELECT * FROM openness")
def _(t):
    return R.ai_openness(policies(t))


@query("cn_blocked", ROBOTS + "SELECT site, string_agg(agent, '|' ORDER BY agent) AS agents FROM policy WHERE regional AND policy = 'blocked' GROUP BY site")
def _(t):
    return R.regional_blocked(policies(t)).withColumn("agents", F.expr(X.text_list("agents")))


@query("llms_txt_score", ROBOTS + """
SELECT site, guide_exists, title, has_summary, CAST(sections AS INTEGER) AS sections, CAST(links AS INTEGER) AS links, score, failed_items FROM graded""")
def _(t):
    return guides(t).drop("bytes")


PROTOCOL = ROBOTS + """, protocol AS (
  SELECT g.site, f.site IS NOT NULL AS robots_exists, coalesce(o.openness, 0) AS openness, coalesce(b.blocked, '') AS blocked, guide_exists, score AS guide_score, failed_items AS guide_fails
  FROM graded g LEFT JOIN file f ON f.site = g.site LEFT JOIN openness o ON o.site = g.site
  LEFT JOIN (SELECT site, string_agg(agent, '|' ORDER BY agent) AS blocked FROM policy WHERE policy = 'blocked' GROUP BY site) b ON b.site = g.site
)
"""


@query("protocol_findings", PROTOCOL + """
SELECT site, 'robots/ai-blocked' AS issue_id, 'major' AS severity FROM protocol WHERE regexp_matches('|' || blocked || '|', '[|](GPTBot|ClaudeBot|PerplexityBot)[|]')
UNION ALL SELECT site, 'robots/missing', 'minor' FROM protocol WHERE NOT robots_exists
UNION ALL SELECT site, 'llms/missing', 'minor' FROM protocol WHERE NOT guide_exists
UNION ALL SELECT site, 'llms/invalid', 'minor' FROM protocol WHERE guide_exists AND guide_fails > 0""")
def _(t):
    return D.protocol_findings(protocol(t))


@query("sitemap_urls", """
SELECT 'https://sm.example.com/f' || p_partkey || '.xml' AS file, u.kind, u.url FROM (
  SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN [{'kind': 'index', 'url': 'https://sm.example.com/f' || (2 * p_partkey + 1) || '.xml'}, {'kind': 'index', 'url': 'https://sm.example.com/f' || (2 * p_partkey + 2) || '.xml'}]
    ELSE [{'kind': 'urlset', 'url': 'https://sm.example.com/p' || p_partkey}, {'kind': 'urlset', 'url': 'https://sm.example.com/q' || (p_partkey % 10)}] END) AS u FROM part)""")
def _(t):
    return R.sitemap_urls(C.sitemap_files(t.part))


@query("sitemap_closure", """
WITH RECURSIVE walk(site, k, depth) AS (
  SELECT 'https://s' || s_suppkey, s_suppkey, 0 FROM supplier
  UNION SELECT site, 2 * k + u.d, depth + 1 FROM walk JOIN part ON p_partkey = k CROSS JOIN (VALUES (1), (2)) AS u(d) WHERE p_size % 3 = 0 AND depth < 30
)
SELECT DISTINCT site, unnest(['https://sm.example.com/p' || k, 'https://sm.example.com/q' || (k % 10)]) AS url FROM walk JOIN part ON p_partkey = k WHERE p_size % 3 <> 0""")
def _(t):
    sites = t.supplier.selectExpr("concat('https://s', s_suppkey) AS site", "s_suppkey")
    declared = sites.selectExpr("site", "concat('https://sm.example.com/f', s_suppkey, '.xml') AS url")
    return R.sitemap_closure(sites.select("site"), declared, C.sitemap_files(t.part))
