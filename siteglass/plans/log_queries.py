"""Queries over the observation and evidence logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteglass.functions.rows import spread
from siteglass.operators import findings as D
from siteglass.operators import observations as O
from siteglass.operators.page_extract import with_page_facts
from siteglass.operators.scoring import with_scores
from siteglass.plans.catalog import Tables, query
from siteglass.plans.page_queries import AS_OF, PAGE_CTE, SEO, snapshot
from siteglass.session import ensure_checkpoint_dir
from siteglass.sources import carriers as C
from siteglass.sources import evidence_log as E


def log(t: Tables):
    return C.observations(spread(t.events))


def keyed(t: Tables):
    return O.with_keys(log(t))


def pairs(t: Tables):
    return O.latest_pair(keyed(t))


SEP = "chr(1)"
LOG = f"""WITH o AS (
  SELECT *, 'obs-' || event_id AS id, CASE event_type WHEN 'click' THEN 'rank' WHEN 'view' THEN 'geo_score' WHEN 'error' THEN 'ai_mention' WHEN 'signup' THEN 'crawl' ELSE 'gsc' END AS type,
    'site:https://www.example.com/u/' || user_id AS subject, 'http:https://www.example.com/' || (user_id % 2) AS source,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'run-' || strftime(ts, '%Y-%m-%d') END AS run_id, 'parser@' || (CAST(json_extract_string(props, '$.k') AS INTEGER) // 50) AS parser_version,
    CASE WHEN event_type = 'click' THEN 'strategy@' || (event_id % 2) END AS strategy_version,
    CASE event_type WHEN 'error' THEN CASE WHEN value < 20 THEN 'MENTIONED' WHEN value < 60 THEN 'NOT_MENTIONED' WHEN value < 90 THEN 'INDETERMINATE' ELSE 'UNOBSERVABLE' END
      ELSE CASE WHEN value > 200 THEN 'BLOCKED' ELSE 'OBSERVED' END END AS status FROM events
), k AS (
  SELECT *, sha256(type || {SEP} || subject || {SEP} || source) AS identity_key, sha256('observer@1' || {SEP} || parser_version || {SEP} || coalesce(strategy_version, '-')) AS version_key FROM o
), n AS (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY ts DESC, event_id DESC) AS rn FROM k
), pair AS (SELECT c.*, p.id AS pid, p.parser_version AS pp, p.status AS ps, p.value AS pv, p.event_id AS pe, p.strategy_version AS pstrat FROM n c LEFT JOIN n p ON p.identity_key = c.identity_key AND p.rn = 2 WHERE c.rn = 1
), cmp AS (
  SELECT *, CASE WHEN pid IS NULL THEN 'missing_previous' WHEN pp <> parser_version THEN 'parser_version_changed'
    WHEN ps NOT IN ('OBSERVED', 'MENTIONED', 'NOT_MENTIONED') OR status NOT IN ('OBSERVED', 'MENTIONED', 'NOT_MENTIONED') THEN 'status_not_observed' END AS reason FROM pair
), sides AS (
  SELECT *, CAST(floor(pv) AS INTEGER) AS s0, CAST(floor(value) AS INTEGER) AS s1, CAST(floor(pv / 2) AS INTEGER) AS g0, CAST(floor(value / 2) AS INTEGER) AS g1,
    CASE WHEN pv >= 30 THEN CAST(floor(pv / 10) AS INTEGER) END AS r0, CASE WHEN value >= 30 THEN CAST(floor(value / 10) AS INTEGER) END AS r1,
    list_distinct(['d' || (pe % 4) || '.com', 'd' || (pe % 3) || '.org']) AS i0, list_distinct(['d' || (event_id % 4) || '.com', 'd' || (event_id % 3) || '.org']) AS i1,
    ['c' || (pe % 4) || '.com', 'c' || (pe % 3) || '.org'] AS c0, ['c' || (event_id % 4) || '.com', 'c' || (event_id % 3) || '.org'] AS c1,
    CASE WHEN pe % 9 = 0 THEN '2.0.0' ELSE '1.0.0' END AS v0, CASE WHEN event_id % 9 = 0 THEN '2.0.0' ELSE '1.0.0' END AS v1 FROM cmp WHERE reason IS NULL
), chg AS (
  SELECT identity_key, 'VALUE' AS kind, 'result.seoScore' AS path, CASE WHEN abs(s1 - s0) < 5 THEN 'neutral' WHEN s1 > s0 THEN 'improved' ELSE 'degraded' END AS direction, CAST(s1 - s0 AS DOUBLE) AS delta FROM sides WHERE type = 'geo_score' AND s0 <> s1
  UNION ALL SELECT identity_key, 'VALUE', 'result.geoScore', CASE WHEN abs(g1 - g0) < 5 THEN 'neutral' WHEN g1 > g0 THEN 'improved' ELSE 'degraded' END, g1 - g0 FROM sides WHERE type = 'geo_score' AND g0 <> g1
  UNION ALL SELECT identity_key, 'VALUE', 'result.targetRank', CASE WHEN r0 IS NULL THEN 'improved' WHEN r1 IS NULL THEN 'degraded' WHEN abs(r1 - r0) < 3 THEN 'neutral' WHEN r1 < r0 THEN 'improved' ELSE 'degraded' END, r1 - r0
    FROM sides WHERE type = 'rank' AND r0 IS DISTINCT FROM r1
  UNION ALL SELECT identity_key, 'ADDED', CASE type WHEN 'rank' THEN 'result.items[].domain' ELSE 'result.citedDomains' END, 'neutral', NULL FROM sides
    WHERE (type = 'rank' AND len(list_filter(i1, lambda x: NOT list_contains(i0, x))) > 0) OR (type = 'ai_mention' AND len(list_filter(c1, lambda x: NOT list_contains(c0, x))) > 0)
  UNION ALL SELECT identity_key, 'REMOVED', CASE type WHEN 'rank' THEN 'result.items[].domain' ELSE 'result.citedDomains' END, 'neutral', NULL FROM sides
    WHERE (type = 'rank' AND len(list_filter(i0, lambda x: NOT list_contains(i1, x))) > 0) OR (type = 'ai_mention' AND len(list_filter(c0, lambda x: NOT list_contains(c1, x))) > 0)
  UNION ALL SELECT identity_key, 'STATUS', 'status', CASE WHEN ps = 'NOT_MENTIONED' AND status = 'MENTIONED' THEN 'improved' WHEN ps = 'MENTIONED' AND status = 'NOT_MENTIONED' THEN 'degraded' ELSE 'unknown' END, NULL FROM sides WHERE ps <> status
  UNION ALL SELECT identity_key, 'COVERAGE', 'coverage', 'unknown', NULL FROM sides WHERE (CASE WHEN pv > 200 THEN 0 WHEN pe % 7 = 0 THEN 1 ELSE 2 END) <> (CASE WHEN value > 200 THEN 0 WHEN event_id % 7 = 0 THEN 1 ELSE 2 END)
  UNION ALL SELECT identity_key, 'VERSION', 'strategyVersion', 'unknown', NULL FROM sides WHERE pstrat IS DISTINCT FROM strategy_version
  UNION ALL SELECT identity_key, 'VERSION', 'result.scoringVersion', 'unknown', NULL FROM sides WHERE type = 'geo_score' AND v0 <> v1
  UNION ALL SELECT identity_key, 'EVIDENCE', 'evidenceRefs', 'neutral', NULL FROM sides WHERE pe % 3 <> event_id % 3
  UNION ALL SELECT identity_key, 'EVIDENCE', 'extractedEvidence.value.band', 'unknown', NULL FROM sides WHERE floor(pv / 20) <> floor(value / 20)
  UNION ALL SELECT identity_key, 'EVIDENCE', 'extractedEvidence.extra.' || (event_id % 2), 'unknown', NULL FROM sides WHERE pe % 2 <> event_id % 2
  UNION ALL SELECT identity_key, 'EVIDENCE', 'extractedEvidence.extra.' || (pe % 2), 'unknown', NULL FROM sides WHERE pe % 2 <> event_id % 2
), rough AS (
  SELECT identity_key, 'STATUS' AS kind, 'status' AS path, 'unknown' AS direction, CAST(NULL AS DOUBLE) AS delta FROM cmp WHERE (reason = 'status_not_observed') OR (reason = 'parser_version_changed' AND ps <> status)
  UNION ALL SELECT identity_key, 'VERSION', 'parserVersion', 'unknown', NULL FROM cmp WHERE reason = 'parser_version_changed'
), change AS (SELECT * FROM chg UNION ALL SELECT * FROM rough)
"""


@query("validate_observations", LOG + """
SELECT id, (value > 100) OR (status IN ('BLOCKED', 'UNOBSERVABLE') AND NOT (value > 200 AND event_id % 2 = 0)) AS quarantined FROM o""")
def _(t):
    return O.validate_observations(log(t)).selectExpr("id", "size(errors) > 0 AS quarantined")


@query("identity_keys", LOG + "SELECT id, identity_key, version_key FROM k")
def _(t):
    return keyed(t).select("id", "identity_key", "version_key")


@query("subject_source", """
SELECT url, 'site:' || regexp_replace(regexp_replace(url, '#.*$', ''), '/(\\?|$)', '\\1') AS subject, 'http:' || regexp_extract(url, '^https?://[^/?#]+') AS source,
  regexp_replace(regexp_replace(url, '#.*$', ''), '/(\\?|$)', '\\1') AS site FROM pages""".replace("\\\\", "\\"))
def _(t):
    named = t.pages.selectExpr("url", f"{O.site_subject('url')} AS subject", f"{O.http_source('url')} AS source")
    return O.parse_subject(named).select("url", "subject", "source", "site")


@query("materialize_run", LOG + """
SELECT identity_key, version_key, run_id, arg_min(id, event_id) AS id, max(event_id) AS write_seq, min(event_id) AS first_seq FROM k WHERE run_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT identity_key, version_key, run_id, id, event_id, event_id FROM k WHERE run_id IS NULL""")
def _(t):
    return O.materialize_run(log(t)).select("identity_key", "version_key", "run_id", "id", "write_seq", "first_seq")


@query("version_chain", LOG + """, m AS (SELECT identity_key, version_key, id, event_id AS s, ts FROM k), c AS (
  SELECT *, lag(id) OVER w AS prev_id, lag(version_key) OVER w AS prev_version FROM m WINDOW w AS (PARTITION BY identity_key ORDER BY s))
SELECT id, CASE WHEN prev_version <> version_key THEN prev_id END AS replaces FROM c""")
def _(t):
    # Events arrive in time order, so the running latest row is the one before.
    return O.version_chain(keyed(t).withColumn("first_seq", F.col("write_seq")), block=3000).select("id", "replaces")


@query("idempotent_observations", LOG + "SELECT arg_min(id, event_id) AS id FROM k GROUP BY identity_key, CAST(ts AS DATE)")
def _(t):
    rows = keyed(t).withColumn("idempotency_key", F.concat_ws("/", "identity_key", F.to_date("observed_at")))
    return O.idempotent_observations(rows).select("id")


@query("latest_per_identity", LOG + "SELECT identity_key, id FROM n WHERE rn = 1")
def _(t):
    return O.latest_per_identity(keyed(t)).select("identity_key", "id")


@query("latest_pair", LOG + "SELECT identity_key, pid AS previous_id, id AS current_id FROM pair")
def _(t):
    return pairs(t).selectExpr("identity_key", "prev.id AS previous_id", "cur.id AS current_id")


@query("comparability", LOG + "SELECT identity_key, reason IS NULL AS comparable, reason FROM cmp")
def _(t):
    return O.comparability(pairs(t)).select("identity_key", "comparable", "reason")


def _diff_query(name: str, sql_filter: str, spark_filter: str):
    @query(name, LOG + f"SELECT identity_key, kind, path, direction, delta FROM change WHERE {sql_filter}")
    def _(t):
        return O.diff_observations(pairs(t)).where(spark_filter).select("identity_key", "kind", "path", "direction", "delta")


_diff_query("diff_observations", "true", "true")
_diff_query("diff_values", "path IN ('result.seoScore', 'result.geoScore')", "path IN ('result.seoScore', 'result.geoScore')")
_diff_query("diff_rank", "path = 'result.targetRank'", "path = 'result.targetRank'")
_diff_query("diff_sets", "kind IN ('ADDED', 'REMOVED')", "kind IN ('ADDED', 'REMOVED')")
_diff_query("diff_status", "kind = 'STATUS'", "kind = 'STATUS'")
_diff_query("diff_coverage", "kind = 'COVERAGE'", "kind = 'COVERAGE'")
_diff_query("diff_versions", "kind = 'VERSION'", "kind = 'VERSION'")
_diff_query("diff_evidence_refs", "path = 'evidenceRefs'", "path = 'evidenceRefs'")
_diff_query("diff_signals", "path LIKE 'extracted%'", "path LIKE 'extracted%'")

COUNTS = ", ".join(f"count(*) FILTER (direction = '{d}') AS {d}" for d in ("improved", "degraded", "neutral", "unknown"))


@query("diff_summary", LOG + f"""SELECT cmp.identity_key, cmp.reason IS NULL AS comparable, {COUNTS} FROM cmp LEFT JOIN change USING (identity_key) GROUP BY ALL""")
def _(t):
    return O.diff_summary(pairs(t)).select("identity_key", "comparable", "improved", "degraded", "neutral", "unknown")


@query("history_gate", LOG + """
, s AS (SELECT cmp.identity_key, cmp.reason, count(*) FILTER (direction = 'degraded') AS worse FROM cmp LEFT JOIN change USING (identity_key) GROUP BY ALL)
SELECT identity_key, CASE WHEN reason IS NULL AND worse > 0 THEN 'fail' ELSE 'pass' END AS decision, CASE WHEN reason IS NULL AND worse > 0 THEN 'degraded' WHEN reason IS NOT NULL THEN 'incomparable' ELSE 'none' END AS reason FROM s""")
def _(t):
    return D.history_gate(O.diff_summary(pairs(t)))


@query("observation_history", LOG + """
SELECT id FROM k WHERE type = 'rank' AND status = 'OBSERVED' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'""")
def _(t):
    return O.history(log(t), type="rank", status="OBSERVED", since="2024-01-05", until="2024-01-20").select("id")


@query("rank_freshness", LOG + "SELECT id, ts + INTERVAL 24 HOUR AS valid_until FROM k WHERE type = 'rank'")
def _(t):
    return O.rank_freshness(log(t)).select("id", "valid_until")


@query("confidence", """
SELECT user_id, CASE WHEN count(*) FILTER (value < 50) = 0 THEN 'unavailable' WHEN count(*) FILTER (value < 50) = count(*) THEN 'high'
  WHEN count(*) FILTER (value < 50) / count(*) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM events GROUP BY user_id""")
def _(t):
    counted = t.events.groupBy("user_id").agg(F.expr("count_if(value < 50)").alias("ok"), F.count("*").alias("total"))
    return counted.selectExpr("user_id", f"{O.confidence('ok', 'total')} AS confidence")


FETCH_STATUS = "CASE o_orderkey % 9 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 0 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 301 WHEN 6 THEN 418 WHEN 7 THEN 0 ELSE 204 END"


@query("site_status", f"""
WITH f AS (SELECT o_orderkey, {FETCH_STATUS} AS s, CASE WHEN o_orderkey % 9 = 7 THEN 'too_large' END AS e, o_orderstatus <> 'P' AS body FROM orders)
SELECT o_orderkey, CASE s WHEN 0 THEN CASE WHEN e IS NOT NULL THEN 'ERROR' ELSE 'UNOBSERVABLE' END WHEN 429 THEN 'BLOCKED' WHEN 503 THEN 'ERROR' WHEN 404 THEN 'OBSERVED' WHEN 418 THEN 'ERROR'
  ELSE CASE WHEN body THEN 'OBSERVED' ELSE 'PARTIAL' END END AS site_status, CASE s WHEN 0 THEN 'UNOBSERVABLE' WHEN 429 THEN 'BLOCKED' WHEN 503 THEN 'ERROR' ELSE 'OBSERVED' END AS protocol_status FROM f""")
def _(t):
    f = t.orders.selectExpr("o_orderkey", f"{FETCH_STATUS} AS s", "CASE WHEN o_orderkey % 9 = 7 THEN 'too_large' END AS e", "o_orderstatus <> 'P' AS body")
    return f.selectExpr("o_orderkey", f"{O.site_status('s', 'e', 'body')} AS site_status", f"{O.protocol_status('s')} AS protocol_status")


@query("build_observations", PAGE_CTE + f"""
, seo AS (SELECT url, {SEO} AS seo_score FROM checks GROUP BY url)
SELECT 'geo_score' AS type, 'site:' || regexp_replace(regexp_replace(url, '#.*$', ''), '/(\\?|$)', '\\1') AS subject, 'OBSERVED' AS status, 'high' AS confidence,
  CAST(seo_score AS VARCHAR) AS seo_score, CAST(q1 + s1 + c1 + f1 + r1 AS VARCHAR) AS geo_score FROM seo JOIN scores USING (url)""")
def _(t):
    scored = with_scores(with_page_facts(snapshot(t), AS_OF)).withColumn("observed_at", F.lit(AS_OF))
    built = O.build_observations(
        scored, "geo_score", O.site_subject("url"), O.http_source("url"), O.site_status("http_status", "NULL", "html <> ''"),
        ["url", "seo_score", "geo_score", "scoring_version"],
    )
    return built.selectExpr(
        "type", "subject", "status", "confidence", "get_json_object(result, '$.seo_score') AS seo_score", "get_json_object(result, '$.geo_score') AS geo_score"
    )


# Evidence log.
def fetches(t: Tables):
    return t.orders.selectExpr(
        "concat('ev-', o_orderkey) AS id",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'serp_html' WHEN '2-HIGH' THEN 'llm_response' WHEN '3-MEDIUM' THEN 'robots_txt' WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'page_html' END AS kind",
        "concat('https://www.example.com/o/', o_custkey, '/?token=abc', o_orderkey, '&q=1') AS request_url",
        "concat('https://www.example.com/o/', o_custkey, '/?Api_Key=', o_orderkey, '&p=2#f') AS final_url",
        "map('Authorization', concat('Bearer s', o_orderkey), 'X-Next', CASE WHEN o_orderstatus = 'F' THEN concat('Basic leak-', o_custkey) ELSE 'plain' END, "
        "'X-Long', repeat('z', cast(o_custkey % 200 AS int)), 'X-Session', 'hidden') AS headers",
        "200 AS status", "concat('body ', o_custkey) AS body", "o_orderdate AS observed_at",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('run-', o_custkey % 5) END AS run_id", "12 AS elapsed_ms", "o_orderkey AS write_seq", "o_custkey",
    )


@query("evidence_rows", """
SELECT 'ev-' || o_orderkey AS id, 'site:https://www.example.com/o/' || o_custkey || '?Api_Key=' || o_orderkey || '&p=2' AS subject, 'https://www.example.com/o/' || o_custkey || '/?token=%5BREDACTED%5D&q=1' AS request_url,
  'https://www.example.com/o/' || o_custkey || '/?Api_Key=%5BREDACTED%5D&p=2#f' AS final_url, substr(sha256('body ' || o_custkey), 1, 32) AS content_hash,
  '[REDACTED]' AS auth, CASE WHEN o_orderstatus = 'F' THEN 'Basic [REDACTED]' ELSE 'plain' END AS next_header,
  CASE WHEN o_custkey % 200 > 120 THEN repeat('z', 40) || '…[truncated ' || (o_custkey % 200 - 40) || ']' ELSE repeat('z', CAST(o_custkey % 200 AS INTEGER)) END AS long_header FROM orders""")
def _(t):
    return E.evidence_rows(fetches(t)).selectExpr(
        "id", "subject", "request_url", "final_url", "content_hash", "headers['Authorization'] AS auth", "headers['X-Next'] AS next_header", "headers['X-Long'] AS long_header"
    )


@query("leak_check", "SELECT 'ev-' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND contains('leak-' || o_custkey, 'leak-100')")
def _(t):
    return E.leak_check(fetches(t), ["leak-100", "short"])


@query("retention_plan", """
SELECT 'ev-' || o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'serpRaw' WHEN '2-HIGH' THEN 'aiRaw' ELSE 'siteRaw' END AS retention_class,
  o_orderdate + to_days(CASE o_orderpriority WHEN '2-HIGH' THEN 90 ELSE 30 END) AS expires_at FROM orders
WHERE o_orderdate + to_days(CASE o_orderpriority WHEN '2-HIGH' THEN 90 ELSE 30 END) <= TIMESTAMP '1998-06-01'""")
def _(t):
    return E.retention_plan(fetches(t).withColumn("body_ref", F.lit(None)), "1998-06-01").select("id", "retention_class", "expires_at")


@query("dedupe_evidence", """
WITH e AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 5 END AS run, o_orderpriority FROM orders)
SELECT 'ev-' || min(o_orderkey) AS id FROM e WHERE run IS NOT NULL GROUP BY o_custkey, run, o_orderpriority UNION ALL SELECT 'ev-' || o_orderkey FROM e WHERE run IS NULL""")
def _(t):
    rows = fetches(t).selectExpr(
        "id", "kind", "concat('s', o_custkey) AS subject", "'http:x' AS source", "'u' AS request_url", "body AS content_hash", "run_id", "cast(NULL AS string) AS explicit_key", "write_seq"
    )
    return O.dedupe_evidence(rows).select("id")


@query("import_missing", "SELECT 'ev-' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    return E.import_missing(fetches(t).join(t.orders.where("o_orderstatus = 'F'").selectExpr("concat('ev-', o_orderkey) AS id"), "id", "left_semi"), fetches(t)).select("id")


@query("evidence_history", """
SELECT 'ev-' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""")
def _(t):
    return E.evidence_history(fetches(t), kind="serp_html", since="1997-01-01", until="1997-12-31").select("id")


@query("log_read", """
SELECT CASE WHEN event_id % 10 = 3 THEN 'quarantined' ELSE 'good' END AS outcome, count(*) AS lines FROM events GROUP BY 1""")
def _(t):
    line = "CASE WHEN event_id % 10 = 3 THEN concat('{\"id\": \"', event_id) ELSE to_json(named_struct('id', cast(event_id AS string), 'kind', event_type)) END AS line"
    folder = f"{ensure_checkpoint_dir(t.spark)}/lines-{uuid.uuid4().hex}"
    t.events.selectExpr(line).write.text(folder)
    good, bad = E.read_log(t.spark, folder)
    marked = good.selectExpr("'good' AS outcome").unionByName(bad.selectExpr("'quarantined' AS outcome"))
    return marked.groupBy("outcome").agg(F.count("*").alias("lines"))


@query("evidence_store", """
SELECT 'ev-' || o_orderkey AS id, o_orderdate AS observed_at FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-09-30'""")
def _(t):
    folder = f"{ensure_checkpoint_dir(t.spark)}/evidence-{uuid.uuid4().hex}"
    kept = fetches(t).select("id", "kind", "observed_at")
    for early in (True, False):  # two appends
        E.append_evidence(kept.where((F.col("observed_at") < "1995-01-01") == early), folder)
    return E.read_evidence(t.spark, folder, since="1997-03-01", until="1997-09-30").select("id", "observed_at")


@query("normalize_legacy", """
SELECT 'r' || o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'kept' WHEN o_orderpriority = '1-URGENT' THEN 'search:site=https://a.com/x|q=red shoes' WHEN o_orderpriority = '2-HIGH' THEN 'ai-slot:acme:unknown'
  ELSE 'site:https://www.example.com/o/' || o_orderkey END AS subject,
  CASE WHEN o_orderstatus = 'F' THEN 'kept' WHEN o_orderpriority = '1-URGENT' THEN 'search-engine:sogou' WHEN o_orderpriority = '2-HIGH' THEN 'provider:acme' ELSE 'http:https://www.example.com' END AS source,
  CASE WHEN o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' THEN 'sogou-citeLinkClass@1' END AS strategy_version FROM orders""")
def _(t):
    records = t.orders.selectExpr(
        "concat('r', o_orderkey) AS id", "CASE o_orderpriority WHEN '1-URGENT' THEN 'serp' WHEN '2-HIGH' THEN 'ai-visibility' END AS purpose",
        "concat('https://www.example.com/o/', o_orderkey, '/') AS target", "'' AS request_url", "'' AS final_url",
        "CASE WHEN o_orderstatus = 'F' THEN 'kept' END AS subject", "CASE WHEN o_orderstatus = 'F' THEN 'kept' END AS source",
        "CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS provenance", "'sogou' AS engine", "' red   shoes ' AS keyword", "'a.com/x/' AS site_url", "'acme' AS provider",
        "'' AS model", "cast(NULL AS string) AS contract_version",
    )
    return E.normalize_legacy(records).select("id", "subject", "source", "strategy_version")
