"""Queries over observations built from result tables, and what is read back from the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.functions import urls as U
from siteglass.operators import answers as A
from siteglass.operators import observations as O
from siteglass.operators import observers as B
from siteglass.operators import query_intelligence as M
from siteglass.operators import result_pages as K
from siteglass.operators import search_performance as I
from siteglass.operators import vitals as V
from siteglass.plans.answer_queries import ANSWERS, CLUSTERS, halves, results
from siteglass.plans.answer_queries import cited as cited_answers
from siteglass.plans.catalog import SQL, Tables, query
from siteglass.plans.search_queries import ITEMS, VITALS, items, rated, rows
from siteglass.plans.site_queries import PROTOCOL, guides, protocol
from siteglass.sources import carriers as C

HEAD = ["type", "subject", "source", "status", "confidence"]
AT = "timestamp'2024-06-01 00:00:00'"
SURE = "CASE WHEN status IN ('OBSERVED', 'MENTIONED', 'NOT_MENTIONED') THEN '{0}' ELSE 'unavailable' END AS confidence"


def _field(name: str, kind: str = "string"):
    return F.get_json_object("result", f"$.{name}").cast(kind).alias(name)


COLLECTED = "CASE l_linenumber % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'no_results' ELSE 'failed' END"


@query("collector_status", f"""
SELECT l_orderkey, l_linenumber, CASE {COLLECTED} WHEN 'ok' THEN 'OBSERVED' WHEN 'blocked' THEN 'BLOCKED' WHEN 'failed' THEN 'ERROR' ELSE 'UNOBSERVABLE' END AS status FROM lineitem""")
def _(t):
    collected = t.lineitem.selectExpr("l_orderkey", "l_linenumber", f"{COLLECTED} AS status")
    return collected.withColumn("status", F.expr(O.COLLECTOR_STATUS))


def result_pages(t: Tables):
    targets = t.part.selectExpr("cast(p_partkey AS string) AS query", "'https://x.example3.com/' AS target")
    found = K.target_rank(items(t), targets)
    return found.withColumns({"site": F.lit("https://shop.example.com/"), "status": F.expr("CASE WHEN items % 3 = 0 THEN 'blocked' ELSE 'ok' END"), "observed_at": F.expr(AT)})


@query("observe_rank", ITEMS + """, page AS (SELECT query, engine, items, min(position) FILTER (domain = 'example3.com') AS r, CASE WHEN items % 3 = 0 THEN 'BLOCKED' ELSE 'OBSERVED' END AS status
  FROM (SELECT query, engine, position, regexp_extract(domain, '[^.]+[.]com$') AS domain, count(*) OVER (PARTITION BY query, engine) AS items FROM item) GROUP BY query, engine, items)
SELECT 'rank' AS type, 'search:site=https://shop.example.com|q=' || query AS subject, 'search-engine:' || engine AS source, status, """ + SURE.format("medium") + """, CAST(NULL AS BIGINT) AS "targetRank", items FROM page""")
def _(t):
    return B.rank_observations(result_pages(t)).select(*HEAD, _field("targetRank", "long"), _field("items", "long"))


def answered(t: Tables):
    rows = A.answer_status(cited_answers(t))
    return rows.withColumn("provider", F.lit("acme"))


@query("observe_answers", ANSWERS + """, seen AS (SELECT st.query, st.model, st.observed_at, st.status, contains(lower(st.answer), 'de') AS mentioned,
  CASE WHEN full_answer THEN len(list_distinct(['https://www.d' || (conv_id % 7) || '.example.com/p' || turn, 'https://www.ref' || (turn % 5) || '.org/x', 'https://d' || (conv_id % 3) || '.co.uk/a'])) ELSE 0 END AS citations FROM st WHERE answer IS NOT NULL)
SELECT 'ai_mention' AS type, 'ai-slot:acme:' || model AS subject, 'provider:acme' AS source, status, """ + SURE.format("medium") + """, query, model, mentioned, CAST(citations AS INTEGER) AS citations, observed_at FROM seen""")
def _(t):
    built = B.answer_observations(answered(t))
    read = F.from_json("result", B.RECORD)
    return built.select(*HEAD, read["query"].alias("query"), read["model"].alias("model"), read["mentioned"].alias("mentioned"), F.size(read["citations"]).alias("citations"), "observed_at")


SITE_HEAD = "'site:' || site AS subject, 'http:' || site AS source"
FETCH = "CASE length(site) % 4 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 0 ELSE 404 END"
FETCHED = f"CASE {FETCH} WHEN 0 THEN 'UNOBSERVABLE' WHEN 403 THEN 'BLOCKED' ELSE 'OBSERVED' END"


@query("observe_robots", PROTOCOL + f", o AS (SELECT *, {FETCHED} AS status FROM protocol) SELECT 'robots_policy' AS type, {SITE_HEAD}, status, {SURE.format('high')}, CAST(openness AS BIGINT) AS openness FROM o")
def _(t):
    found = protocol(t).withColumns({"http_status": F.expr(FETCH), "observed_at": F.expr(AT)})
    return B.robots_observations(found).select(*HEAD, _field("openness", "long"))


@query("observe_guides", PROTOCOL + f", o AS (SELECT *, {FETCHED} AS status FROM graded) SELECT 'llms_txt' AS type, {SITE_HEAD}, status, {SURE.format('high')}, score, CAST(failed_items AS BIGINT) AS failed_items FROM o")
def _(t):
    found = guides(t).withColumns({"http_status": F.expr(FETCH), "observed_at": F.expr(AT)})
    return B.guide_observations(found).select(*HEAD, _field("score", "long"), _field("failed_items", "long"))


@query("observe_vitals", VITALS + """, o AS (SELECT target, count(*) FILTER (category = 'poor') AS poor, count(*) FILTER (category = 'needs-improvement') AS needs_improvement FROM rated GROUP BY target)
SELECT 'performance' AS type, 'site:' || target AS subject, 'http:https://www.example.com' AS source, 'OBSERVED' AS status, 'high' AS confidence,
  CASE WHEN poor > 0 THEN 'SLOW' WHEN needs_improvement > 0 THEN 'AVERAGE' ELSE 'FAST' END AS overall, poor, needs_improvement FROM o""")
def _(t):
    found = rated(t)
    counted = found.groupBy("target").agg(
        F.expr("count_if(category = 'poor')").alias("poor"), F.expr("count_if(category = 'needs-improvement')").alias("needs_improvement")
    )
    overall = V.vital_overall(found).join(counted, "target").withColumn("observed_at", F.expr(AT))
    return B.vital_observations(overall).select(*HEAD, _field("overall"), _field("poor", "long"), _field("needs_improvement", "long"))


@query("observe_search", """
WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS impressions FROM events GROUP BY user_id)
SELECT 'gsc' AS type, 'site:https://www.example.com/u/' || user_id AS subject, 'gsc:https://www.example.com' AS source, 'OBSERVED' AS status, 'high' AS confidence, clicks, impressions
FROM s WHERE clicks > 0 OR impressions > 0""")
def _(t):
    totals = I.search_totals(rows(t).withColumn("key", F.col("keys")[0]), "key").withColumn("observed_at", F.expr(AT))
    return B.search_observations(totals).select(*HEAD, _field("clicks", "long"), _field("impressions", "long"))


# The report of citations with both sides read back from stored observations.
@query("citation_report_from_log", SQL["citation_report"])
def _(t):
    before, now = (rows.withColumns({"provider": F.lit("acme"), "status": F.lit("OBSERVED")}) for rows in halves(t))
    return A.citation_report(*B.stored_halves(before, now), "https://www.example.com")


@query("cluster_urls", CLUSTERS + """, held AS (SELECT cluster, url, count(*) AS queries FROM label JOIN e ON e.query = node GROUP BY cluster, url HAVING count(*) > 1)
SELECT cluster, 'https://r.example.com/' || url AS url, queries, CAST(row_number() OVER w AS INTEGER) AS rank FROM held WINDOW w AS (PARTITION BY cluster ORDER BY queries DESC, 'https://r.example.com/' || url)
QUALIFY row_number() OVER w <= 20""")
def _(t):
    members, _ = M.query_clusters(M.query_overlap(results(t), min_shared=3))
    return M.cluster_urls(members, results(t))


@query("search_rollups", """
SELECT day, device, kind, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS impressions, CAST(GROUPING(day, device, kind) AS BIGINT) AS level
FROM (SELECT *, CAST(ts AS DATE) AS day, user_id % 4 AS device, event_id % 3 AS kind FROM events) GROUP BY GROUPING SETS ((day, device), (day), (device, kind), ())""")
def _(t):
    base = t.events.selectExpr(
        "cast(ts AS date) AS day", "user_id % 4 AS device", "event_id % 3 AS kind", "cast(event_type = 'click' AS bigint) AS clicks",
        "cast(event_type = 'view' AS bigint) AS impressions", "value AS position",
    )
    sets = [("day", "device"), ("day",), ("device", "kind"), ()]
    return I.search_rollups(base, ["day", "device", "kind"], sets).select("day", "device", "kind", "clicks", "impressions", "level")


@query("path_language", r"""
SELECT url, CASE WHEN c <> '' THEN CASE WHEN contains(c, '-') THEN lower(split_part(c, '-', 1)) || '-' || upper(split_part(c, '-', 2)) ELSE lower(c) END END AS language
FROM (SELECT url, regexp_extract(url, '(?i)^https?://[^/?#]+/([a-z]{2,3}(-[A-Z]{2})?)(/|$)', 1) AS c FROM (
  SELECT url FROM pages UNION ALL SELECT 'https://i18n.example.com/' || CASE c_custkey % 4 WHEN 0 THEN 'de/x' WHEN 1 THEN 'ZH-cn/' WHEN 2 THEN 'en' ELSE 'guide/de' END FROM customer))""")
def _(t):
    named = t.customer.selectExpr("concat('https://i18n.example.com/', CASE c_custkey % 4 WHEN 0 THEN 'de/x' WHEN 1 THEN 'ZH-cn/' WHEN 2 THEN 'en' ELSE 'guide/de' END) AS url")
    return t.pages.select("url").unionByName(named).selectExpr("url", f"{U.language_of_path('url')} AS language")


@query("recent_search", """
SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS clicks FROM events
WHERE CAST(ts AS DATE) BETWEEN (SELECT max(CAST(ts AS DATE)) - 27 FROM events) AND (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1""")
def _(t):
    days = t.events.selectExpr("cast(ts AS date) AS day", "cast(event_type = 'click' AS bigint) AS clicks")
    last = days.agg(F.max("day")).first()[0]
    begin, end = I.default_period(last) if last else (None, None)
    return days.where(F.col("day").between(F.lit(begin), F.lit(end))).groupBy("day").agg(F.sum("clicks").alias("clicks"))
