"""Queries over search rows, vitals and result pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.operators import result_pages as K
from siteglass.operators import search_performance as I
from siteglass.operators import vitals as J
from siteglass.plans.catalog import Tables, query
from siteglass.sources import carriers as C

# Scaled thresholds: a user of the event table has only a few views per half month.
LIMITS = I.SearchLimits(
    low_ctr_impressions=8, low_ctr=0.9, rank_impressions=6, rank_from=4, rank_to=6, diff_impressions=4, diff_rank=1, diff_clicks=3
)


def rows(t: Tables, period: str | None = None):
    found = C.search_rows(t.events)
    return found.where(F.col("period") == period) if period else found


def crawled(t: Tables):
    return t.customer.where("c_custkey % 2 = 0").selectExpr("concat('HTTPS://www.example.com/u/', c_custkey, '?a=1') AS url")


ROWS = """WITH search AS (
  SELECT CASE WHEN day(ts) <= 15 THEN 'previous' ELSE 'current' END AS period, 'https://www.example.com/u/' || user_id || '/' AS key, any_value(user_id) AS user_id,
    count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS impressions, round(avg(value) / 10, 6) AS position
  FROM events GROUP BY 1, 2
), rated AS (SELECT *, CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END AS ctr FROM search WHERE impressions > 0 OR clicks > 0
), opp AS (
  SELECT 'high-impression-low-ctr' AS kind, key, clicks, impressions FROM rated WHERE impressions >= 8 AND ctr < 0.9
  UNION ALL SELECT 'ranking-opportunity', key, clicks, impressions FROM rated WHERE position BETWEEN 4 AND 6 AND impressions >= 6
  UNION ALL SELECT 'content-gap', key, clicks, impressions FROM rated WHERE impressions > 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
)
"""


def _kind_query(name: str, kind: str, build):
    query(name, ROWS + f"SELECT kind, key, clicks, impressions FROM opp WHERE kind = '{kind}'")(
        lambda t: build(t).select("kind", "key", "clicks", "impressions")
    )


_kind_query("high_impression_low_ctr", "high-impression-low-ctr", lambda t: I.high_impression_low_ctr(rows(t), LIMITS))
_kind_query("ranking_opportunity", "ranking-opportunity", lambda t: I.ranking_opportunity(rows(t), LIMITS))
_kind_query("content_gap", "content-gap", lambda t: I.content_gap(rows(t), crawled(t)))


@query("search_opportunity_counts", ROWS + """
SELECT count(*) FILTER (kind = 'high-impression-low-ctr') AS high_impression_low_ctr, count(*) FILTER (kind = 'ranking-opportunity') AS ranking_opportunity,
  count(*) FILTER (kind = 'content-gap') AS content_gap FROM opp""")
def _(t):
    return I.opportunity_counts(I.search_opportunities(rows(t), crawled(t), LIMITS))


@query("period_diff", ROWS + """, a AS (SELECT * FROM rated WHERE period = 'previous'), b AS (SELECT * FROM rated WHERE period = 'current'), d AS (
  SELECT key, CASE WHEN a.clicks IS NULL THEN 'new' WHEN b.clicks IS NULL THEN 'lost' WHEN a.impressions < 4 AND b.impressions < 4 THEN NULL
    WHEN b.position - a.position <= -1 OR b.clicks - a.clicks >= 3 THEN 'improved' WHEN b.position - a.position >= 1 OR b.clicks - a.clicks <= -3 THEN 'declined' END AS change,
    b.clicks - a.clicks AS clicks_delta, b.impressions - a.impressions AS impressions_delta, round(b.position - a.position, 6) AS position_delta
  FROM a FULL JOIN b USING (key)) SELECT * FROM d WHERE change IS NOT NULL""")
def _(t):
    diff = I.period_diff(rows(t, "previous"), rows(t, "current"), LIMITS)
    return I.by_impact(diff).withColumn("position_delta", F.round("position_delta", 6))


@query("search_totals", ROWS + """
SELECT period, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(clicks) / sum(impressions), 6) AS ctr,
  round(sum(position * impressions) / sum(impressions), 6) AS position FROM rated GROUP BY period""")
def _(t):
    return I.search_totals(rows(t), "period").selectExpr("period", "clicks", "impressions", "round(ctr, 6) AS ctr", "round(position, 6) AS position")


@query("top_search_rows", ROWS + "SELECT key, clicks, impressions FROM rated WHERE period = 'current' ORDER BY impressions DESC, key LIMIT 100")
def _(t):
    return I.top_search_rows(rows(t, "current")).select("key", "clicks", "impressions")


@query("search_rollup", """
SELECT CAST(ts AS DATE) AS day, user_id % 4 AS device, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS impressions FROM events GROUP BY 1, 2""")
def _(t):
    base = t.events.selectExpr(
        "cast(ts AS date) AS day", "user_id % 4 AS device", "cast(event_type = 'click' AS bigint) AS clicks",
        "cast(event_type = 'view' AS bigint) AS impressions", "value AS position",
    )
    return I.search_rollup(base, "day", "device").select("day", "device", "clicks", "impressions")


METRIC = "CASE event_type WHEN 'view' THEN 'largest_contentful_paint' WHEN 'click' THEN 'interaction_to_next_paint' WHEN 'error' THEN 'cumulative_layout_shift' WHEN 'signup' THEN 'first_contentful_paint' ELSE 'experimental_time_to_first_byte' END"
VITALS = f"""WITH p AS (
  SELECT 'https://www.example.com/u/' || user_id AS target, event_type, {METRIC} AS metric,
    quantile_cont(value * CASE event_type WHEN 'view' THEN 60.0::DOUBLE WHEN 'click' THEN 6.0::DOUBLE WHEN 'error' THEN 0.003::DOUBLE WHEN 'signup' THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END, 0.75) AS p75
  FROM events GROUP BY user_id, event_type
), r AS (
  SELECT *, CASE event_type WHEN 'view' THEN 2500 WHEN 'click' THEN 200 WHEN 'error' THEN 0.1 WHEN 'signup' THEN 1800 ELSE 800 END AS good,
    CASE event_type WHEN 'view' THEN 4000 WHEN 'click' THEN 500 WHEN 'error' THEN 0.25 WHEN 'signup' THEN 3000 ELSE 1800 END AS ni FROM p
), rated AS (SELECT *, CASE WHEN p75 <= good THEN 'good' WHEN p75 <= ni THEN 'needs-improvement' ELSE 'poor' END AS category FROM r)
"""


def rated(t: Tables):
    return J.vital_rating(J.raw_p75(C.vital_samples(t.events)))


@query("raw_p75", VITALS + "SELECT target, metric, round(p75, 9) AS p75 FROM p")
def _(t):
    return J.raw_p75(C.vital_samples(t.events)).withColumn("p75", F.round("p75", 9))


@query("vital_rating", VITALS + "SELECT target, metric, category FROM rated")
def _(t):
    return rated(t).select("target", "metric", "category")


@query("vital_overall", VITALS + """
SELECT target, CASE WHEN bool_or(category = 'poor') THEN 'SLOW' WHEN bool_or(category = 'needs-improvement') THEN 'AVERAGE' ELSE 'FAST' END AS overall FROM rated GROUP BY target""")
def _(t):
    return J.vital_overall(rated(t))


@query("vital_densities", """
WITH h AS (SELECT user_id, count(*) FILTER (value < 33) / count(*) AS a, count(*) FILTER (value >= 33 AND value < 66) / count(*) AS b, count(*) FILTER (value >= 66) / count(*) AS c FROM events GROUP BY user_id)
SELECT 'https://www.example.com/u/' || user_id AS target, 'largest_contentful_paint' AS metric, round(a, 6) AS good, round(b, 6) AS needs_improvement, round(c, 6) AS poor FROM h""")
def _(t):
    share = lambda cond: F.expr(f"count_if({cond}) / count(*)")
    bins = t.events.groupBy("user_id").agg(share("value < 33").alias("a"), share("value >= 33 AND value < 66").alias("b"), share("value >= 66").alias("c"))
    hist = (
        "array(named_struct('start', 0D, 'end', 2500D, 'density', a), named_struct('start', 2500D, 'end', 4000D, 'density', b), "
        "named_struct('start', 4000D, 'end', cast(NULL AS double), 'density', c))"
    )
    df = bins.selectExpr("concat('https://www.example.com/u/', user_id) AS target", "'largest_contentful_paint' AS metric", f"{hist} AS histogram")
    return J.vital_densities(df).selectExpr(
        "target", "metric", "round(good, 6) AS good", "round(needs_improvement, 6) AS needs_improvement", "round(poor, 6) AS poor"
    )


@query("vital_status_counts", """
SELECT count(*) AS total, count(*) FILTER (event_type IN ('view', 'click')) AS ok, count(*) FILTER (event_type = 'signup') AS unavailable,
  count(*) FILTER (event_type = 'purchase') AS blocked, count(*) FILTER (event_type = 'error') AS error FROM events""")
def _(t):
    status = "CASE event_type WHEN 'signup' THEN 'unavailable' WHEN 'purchase' THEN 'blocked' WHEN 'error' THEN 'error' ELSE 'ok' END AS status"
    return J.vital_status_counts(t.events.selectExpr(status))


@query("vital_sample", """
WITH p AS (SELECT o_custkey % 20 AS site, o_orderkey AS pos, 'https://shop.example.com/o/' || o_orderkey AS url,
  CASE WHEN month(o_orderdate) IN (4, 5) THEN 'article' WHEN month(o_orderdate) = 6 THEN 'product' END AS g FROM orders WHERE o_orderstatus <> 'P' AND month(o_orderdate) <> 11)
SELECT site, g AS sample_group, CAST(row_number() OVER (PARTITION BY site, g ORDER BY pos) AS INTEGER) AS n, url FROM p WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, g ORDER BY pos) <= 2""")
def _(t):
    keys = t.orders.selectExpr("o_orderkey AS page_id", "o_custkey % 20 AS site")
    pages = C.site_pages(t.orders).join(keys, "page_id").withColumn("position", F.col("page_id"))
    return J.vital_sample(pages)


@query("lab_fallback", VITALS + """, f AS (SELECT target, metric, p75, event_type, CAST(regexp_extract(target, '[0-9]+$') AS BIGINT) % 3 = 0 AS missing FROM p)
SELECT target, metric, round(p75, 9) AS p75, 'field' AS data_source FROM f WHERE NOT missing
UNION ALL SELECT target, metric, round(floor(p75 * 100 + 0.5) / 100, 9), 'lab' FROM f WHERE missing""")
def _(t):
    p75 = J.raw_p75(C.vital_samples(t.events)).withColumn("missing", F.expr("cast(regexp_extract(target, '[0-9]+$', 0) AS bigint) % 3 = 0"))
    field = p75.selectExpr(
        "target", "metric", "CASE WHEN NOT missing THEN p75 END AS p75", "CASE WHEN missing THEN 'unavailable' ELSE 'ok' END AS status",
        "CASE WHEN missing THEN 404 ELSE 200 END AS http_status",
    )
    lab = p75.selectExpr("target", "CASE WHEN metric = 'interaction_to_next_paint' THEN 'total_blocking_time' ELSE metric END AS metric", "p75 AS value")
    return J.lab_fallback(field, lab).withColumn("p75", F.round("p75", 9))


def items(t: Tables):
    return C.result_items(t.lineitem, t.part)


ITEMS = """WITH item AS (
  SELECT CAST(l_partkey AS VARCHAR) AS query, l_returnflag AS engine, 's' || l_suppkey || '.example' || (l_suppkey % 7) || '.com' AS domain, l_linenumber AS position,
    'https://s' || l_suppkey || '.example' || (l_suppkey % 7) || '.com/o/' || l_orderkey AS url,
    p_name || CASE WHEN p_size % 7 = 0 THEN '?' ELSE '' END || ' - ' || p_type || ' ' || p_brand AS title, l_linestatus = 'F' AND l_linenumber = 1 AS owned
  FROM lineitem JOIN part ON p_partkey = l_partkey
), target_page AS (
  SELECT query, engine, CAST(min(position) FILTER (domain LIKE '%.example3.com') AS INTEGER) AS target_rank, count(*) AS items FROM item GROUP BY query, engine
)
"""


@query("serp_dedup", ITEMS + "SELECT query, engine, domain, min(position) AS position FROM item GROUP BY query, engine, domain")
def _(t):
    return K.serp_dedup(items(t)).select("query", "engine", "domain", "position")


def registrable(t: Tables):
    return items(t).withColumn("domain", F.expr("regexp_replace(domain, '^s[0-9]+[.]', '')"))


def target_pages(t: Tables):
    targets = t.part.selectExpr("cast(p_partkey AS string) AS query", "'https://www.example3.com/' AS target")
    return K.target_rank(registrable(t), targets)


@query("target_rank", ITEMS + "SELECT query, engine, target_rank, items FROM target_page")
def _(t):
    return target_pages(t)


@query("rank_summary", ITEMS + """
SELECT query, count(*) FILTER (engine <> 'N') AS ok_engines, count(*) FILTER (engine = 'N') AS blocked_engines,
  floor(avg(target_rank) FILTER (engine <> 'N') * 10 + 0.5) / 10 AS average_rank, CAST(min(target_rank) FILTER (engine <> 'N') AS INTEGER) AS best_rank,
  CAST(sum(items) AS BIGINT) AS total_items FROM target_page GROUP BY query""")
def _(t):
    status = F.expr("CASE WHEN engine = 'N' THEN 'blocked' ELSE 'ok' END")
    return K.rank_summary(target_pages(t).withColumn("status", status))


@query("serp_positions", """
SELECT l_orderkey AS query, l_returnflag AS engine, l_linenumber // 4 AS page, l_partkey AS ordinal, (l_linenumber // 4) * 10 + row_number() OVER (
  PARTITION BY l_orderkey, l_returnflag, l_linenumber // 4 ORDER BY l_partkey) AS position FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber // 4, l_partkey ORDER BY l_linenumber) = 1)""")
def _(t):
    found = t.lineitem.selectExpr(
        "l_orderkey AS query", "l_returnflag AS engine", "l_linenumber DIV 4 AS page", "l_partkey AS ordinal", "10 AS page_size"
    ).distinct()
    return K.serp_positions(found).select("query", "engine", "page", "ordinal", F.col("position").cast("bigint").alias("position"))


ENGINE_OF = "CASE o_custkey % 4 WHEN 0 THEN 'baidu' WHEN 1 THEN 'google' WHEN 2 THEN 'sogou' ELSE 'bing' END"
RAW_URL = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN concat('https://www.baidu.com/link?url=', o_orderkey) WHEN '2-HIGH' THEN concat('https://baike.baidu.com/item/', o_orderkey) "
    "WHEN '3-MEDIUM' THEN concat('https://site', o_custkey, '.example.com/', o_orderkey) WHEN '4-NOT SPECIFIED' THEN concat('https://cut.lianlianpa', o_custkey, '/') "
    "ELSE concat('https://www.google.com/search?u=', o_orderkey) END"
)
CLEAN = f"""WITH raw AS (SELECT o_orderkey, {ENGINE_OF} AS engine, {RAW_URL} AS url, CASE o_orderpriority WHEN '1-URGENT' THEN 'baidu.com' WHEN '2-HIGH' THEN 'baidu.com'
    WHEN '3-MEDIUM' THEN 'example.com' WHEN '4-NOT SPECIFIED' THEN 'cut.lianlianpa' || o_custkey ELSE 'google.com' END AS domain, o_orderpriority FROM orders
), clean AS (
  SELECT *, (engine = 'baidu' AND o_orderpriority = '1-URGENT') OR (engine = 'google' AND o_orderpriority = '5-LOW') AS redirect_wrapper FROM raw
  WHERE o_orderpriority <> '4-NOT SPECIFIED' AND (domain <> engine || '.com' OR o_orderpriority IN ('1-URGENT', '5-LOW')))
"""


def clean(t: Tables):
    raw = t.orders.selectExpr("cast(o_custkey AS string) AS query", f"{ENGINE_OF} AS engine", f"{RAW_URL} AS url", "o_orderkey AS position")
    return K.serp_item_clean(raw, K.engine_table(t.spark))


@query("serp_item_clean", CLEAN + "SELECT engine, url, domain, redirect_wrapper, false AS owned, NOT redirect_wrapper AS resolved FROM clean")
def _(t):
    return clean(t).select("engine", "url", "domain", "redirect_wrapper", "owned", "resolved")


@query("resolved_domains", CLEAN + """
SELECT engine, CASE WHEN redirect_wrapper AND o_orderkey % 2 = 0 THEN 'https://real' || (o_orderkey % 9) || '.example.org/x' ELSE url END AS url,
  CASE WHEN redirect_wrapper AND o_orderkey % 2 = 0 THEN 'example.org' ELSE domain END AS domain, redirect_wrapper AND o_orderkey % 2 = 1 AS redirect_wrapper FROM clean""")
def _(t):
    redirects = t.orders.where("o_orderkey % 2 = 0").selectExpr(f"{RAW_URL} AS url", "concat('https://real', o_orderkey % 9, '.example.org/x') AS final_url")
    return K.resolved_domains(clean(t), redirects).select("engine", "url", "domain", "redirect_wrapper")


@query("engine_selection", CLEAN + "SELECT engine, count(*) AS items FROM clean WHERE engine IN ('baidu', 'sogou') GROUP BY engine")
def _(t):
    chosen = K.engine_selection(K.engine_table(t.spark), "cn").select("engine")
    return clean(t).join(F.broadcast(chosen), "engine", "left_semi").groupBy("engine").agg(F.count("*").alias("items"))
