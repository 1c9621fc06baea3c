"""Queries over AI answers and query intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.operators import answers as A
from siteglass.operators import query_intelligence as M
from siteglass.plans.catalog import Tables, query
from siteglass.plans.search_queries import ITEMS, items
from siteglass.sources import carriers as C


def statuses(t: Tables):
    return A.answer_status(C.answers(t.conversations))


def cited(t: Tables):
    base = A.competitors_mentioned(A.with_citations(C.answers(t.conversations).where("answer IS NOT NULL")))
    return base.withColumn("mentioned", F.expr("contains(lower(answer), lower(brand))"))


ANSWERS = r"""WITH RECURSIVE a AS (
  SELECT conv_id, turn, 'topic ' || (conv_id % 40) AS query, 'm' || (turn % 3) AS model, role, text, 'm' || ((turn + conv_id % 2) % 3) AS served_model,
    CASE role WHEN 'assistant' THEN 200 WHEN 'system' THEN 429 ELSE CASE turn % 4 WHEN 0 THEN 500 WHEN 2 THEN 0 ELSE 401 END END AS http_status,
    CASE WHEN role <> 'assistant' THEN NULL WHEN conv_id % 11 = 0 THEN 'Sorry, I cannot provide a recommendation here.' WHEN conv_id % 13 = 0 THEN 'No.'
      ELSE text || ' See [guide ' || turn || '](https://www.d' || (conv_id % 7) || '.example.com/p' || turn || ') and www.ref' || (turn % 5) || '.org/x. Also https://d' || (conv_id % 3) || '.co.uk/a) or shop.io here' END AS answer,
    role = 'assistant' AND conv_id % 11 <> 0 AND conv_id % 13 <> 0 AS full_answer, make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000) AS observed_at
  FROM conversations
), st AS (
  SELECT *, CASE WHEN http_status = 0 THEN 'ERROR' WHEN http_status IN (401, 402, 403, 429) THEN 'BLOCKED' WHEN http_status <> 200 THEN 'ERROR'
    WHEN conv_id % 11 = 0 OR conv_id % 13 = 0 THEN 'INDETERMINATE' WHEN contains(lower(answer), 'de') THEN 'MENTIONED' ELSE 'NOT_MENTIONED' END AS status FROM a
), cite AS (
  SELECT conv_id, turn, query, model, observed_at, u.ordinal, u.url, u.position FROM (SELECT *, unnest([
    {'ordinal': 0, 'url': 'https://www.d' || (conv_id % 7) || '.example.com/p' || turn, 'position': length(text) + 5},
    {'ordinal': 1, 'url': 'https://www.ref' || (turn % 5) || '.org/x', 'position': length(text) + 5 + length('[guide ' || turn || '](https://www.d' || (conv_id % 7) || '.example.com/p' || turn || ') and ')},
    {'ordinal': 2, 'url': 'https://d' || (conv_id % 3) || '.co.uk/a', 'position': length(text) + 5 + length('[guide ' || turn || '](https://www.d' || (conv_id % 7) || '.example.com/p' || turn || ') and www.ref' || (turn % 5) || '.org/x. Also ')}]) AS u FROM a WHERE full_answer)
), rec AS (SELECT *, contains(lower(answer), 'de') AS mentioned, list_filter(['la', 'Die', 'zzz'], lambda c: contains(lower(answer), lower(c))) AS comps FROM a WHERE answer IS NOT NULL)
, domain AS (SELECT conv_id, turn, query, unnest(['example.com', 'ref' || (turn % 5) || '.org', 'd' || (conv_id % 3) || '.co.uk']) AS domain FROM a WHERE full_answer)
"""


@query("answer_signal", ANSWERS + """
SELECT conv_id, turn, CASE WHEN answer IS NULL THEN 'empty' WHEN conv_id % 11 = 0 THEN 'refusal' WHEN conv_id % 13 = 0 THEN 'too_short' END AS low_signal FROM a""")
def _(t):
    return A.answer_signal(C.answers(t.conversations)).select("conv_id", "turn", "low_signal")


@query("answer_status", ANSWERS + "SELECT conv_id, turn, status FROM st")
def _(t):
    return statuses(t).select("conv_id", "turn", "status")


@query("mention_context", ANSWERS + r"""
SELECT conv_id, turn, replace(substr(answer, greatest(i - 50, 1), i - greatest(i - 50, 1) + 52), chr(10), ' ') AS context FROM (SELECT *, instr(lower(answer), 'de') AS i FROM rec WHERE mentioned)""")
def _(t):
    return A.mention_context(C.answers(t.conversations)).select("conv_id", "turn", "context")


@query("competitors_mentioned", ANSWERS + "SELECT conv_id, turn, array_to_string(comps, '|') AS competitors FROM rec")
def _(t):
    return cited(t).select("conv_id", "turn", F.array_join("competitors_mentioned", "|").alias("competitors"))


@query("answer_citations", ANSWERS + "SELECT conv_id, turn, ordinal, url, CAST(position AS INTEGER) AS position FROM cite")
def _(t):
    return A.answer_citations(cited(t), "conv_id", "turn").drop("title")


@query("answer_domains", ANSWERS + """
SELECT DISTINCT conv_id, turn, unnest(['d' || (conv_id % 7) || '.example.com', 'd' || (conv_id % 3) || '.co.uk', 'example.com', 'ref' || (turn % 5) || '.org', 'shop.io']) AS domain FROM a
WHERE full_answer AND NOT regexp_matches(text, '(?i)[a-z0-9-]\\.(com|cn|net|org|io|dev|ai|so|hk)\\b|https?://')""".replace("\\\\", "\\"))
def _(t):
    plain = C.answers(t.conversations).join(t.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    plain = plain.where(F.expr("answer LIKE '%shop.io%' AND NOT text rlike '(?i)[a-z0-9-]\\\\.(com|cn|net|org|io|dev|ai|so|hk)\\\\b|https?://'"))
    return A.answer_domains(plain, "conv_id", "turn")


# Over all answers, with the domains of their texts; tests compare it with brute force.
@query("whole_answer_domains")
def _(t):
    return A.answer_domains(C.answers(t.conversations), "conv_id", "turn")


COUNTS = """count(*) AS attempted, count(*) FILTER (status IN ('MENTIONED', 'NOT_MENTIONED', 'INDETERMINATE')) AS successful,
  count(*) FILTER (status IN ('MENTIONED', 'NOT_MENTIONED')) AS determinable, count(*) FILTER (status = 'INDETERMINATE') AS indeterminate, count(*) FILTER (status = 'MENTIONED') AS mentioned,
  count(*) FILTER (status = 'NOT_MENTIONED') AS not_mentioned, count(*) FILTER (status = 'BLOCKED') AS blocked, count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (status = 'UNOBSERVABLE') AS unobservable"""
SCORE = "CASE WHEN determinable = 0 THEN 0 ELSE CAST(floor(mentioned / determinable * 100 + 0.5) AS BIGINT) END AS visibility_score"


@query("status_summary", ANSWERS + f"SELECT model, {COUNTS} FROM st GROUP BY model")
def _(t):
    return A.status_summary(statuses(t), "model")


@query("visibility_score", ANSWERS + f"SELECT model, {SCORE} FROM (SELECT model, {COUNTS} FROM st GROUP BY model)")
def _(t):
    return A.visibility_score(A.status_summary(statuses(t), "model")).select("model", "visibility_score")


@query("visibility_report", ANSWERS + f"""
SELECT query, attempted - unobservable AS configured, determinable AS observed, mentioned, blocked + error AS failed, unobservable, {SCORE}
FROM (SELECT query, {COUNTS} FROM st GROUP BY query)""")
def _(t):
    return A.visibility_report(statuses(t), "query")


@query("top_cited_domains", ANSWERS + "SELECT domain, count(*) AS answers FROM domain GROUP BY domain ORDER BY answers DESC, domain LIMIT 10")
def _(t):
    from siteglass.functions import urls as U

    named = A.answer_citations(cited(t), "conv_id", "turn").select("conv_id", "turn", F.expr(U.registrable_domain("url")).alias("domain")).distinct()
    return A.top_cited_domains(named)


@query("domain_ranking", ANSWERS + "SELECT domain, count(*) AS records FROM domain GROUP BY domain")
def _(t):
    return A.domain_ranking(cited(t))


@query("citation_usable", ANSWERS + "SELECT conv_id, turn FROM a WHERE full_answer")
def _(t):
    return cited(t).where(A.USABLE).select("conv_id", "turn")


@query("competitor_frequency", ANSWERS + "SELECT competitor, count(*) AS records FROM (SELECT unnest(comps) AS competitor FROM rec WHERE full_answer) GROUP BY competitor")
def _(t):
    return A.competitor_frequency(cited(t))


@query("citation_gap", ANSWERS + "SELECT domain, count(*) AS records FROM domain WHERE domain <> 'example.com' GROUP BY domain HAVING count(*) >= 2")
def _(t):
    return A.citation_gap(A.domain_ranking(cited(t)), "https://www.example.com")


DIFF = ANSWERS + """, urls AS (SELECT conv_id, turn, list(url ORDER BY ordinal) AS urls FROM cite GROUP BY 1, 2), r AS (
  SELECT rec.*, coalesce(urls.urls, []) AS urls FROM rec LEFT JOIN urls USING (conv_id, turn)
), d AS (
  SELECT c.query, c.model, c.observed_at, p.urls AS old, c.urls AS new, p.mentioned AS pm, c.mentioned AS cm FROM (SELECT * FROM r WHERE conv_id % 2 = 0) c ASOF LEFT JOIN (SELECT * FROM r WHERE conv_id % 2 = 1) p
    ON p.query = c.query AND p.model = c.model AND p.observed_at < c.observed_at
), changed AS (
  SELECT query, model, observed_at, old IS NOT NULL AS has_previous, CASE WHEN pm IS NULL THEN NULL WHEN pm = cm THEN 'unchanged' WHEN cm THEN 'added' ELSE 'lost' END AS mention,
    coalesce(len(list_filter(new, lambda u: NOT list_contains(old, u))), 0) AS added, coalesce(len(list_filter(old, lambda u: NOT list_contains(new, u))), 0) AS lost FROM d)
"""
# The parity split above needs previous and current records of one query: topics are numbered by conv_id % 40, so shift by one.
DIFF = DIFF.replace("p.query = c.query", "p.topic = c.topic").replace(
    "SELECT rec.*, coalesce(urls.urls, []) AS urls", "SELECT rec.*, conv_id // 2 % 20 AS topic, coalesce(urls.urls, []) AS urls"
).replace("SELECT c.query, c.model", "SELECT 'pair ' || c.topic AS query, c.model")


def halves(t: Tables):
    paired = cited(t).withColumn("query", F.expr("concat('pair ', conv_id DIV 2 % 20)"))
    return paired.where("conv_id % 2 = 1"), paired.where("conv_id % 2 = 0")


@query("citation_diff", DIFF + "SELECT query, model, observed_at, has_previous, mention, CAST(added AS INTEGER) AS added, CAST(lost AS INTEGER) AS lost FROM changed")
def _(t):
    return A.citation_diff(*halves(t)).selectExpr(
        "query", "model", "observed_at", "has_previous", "mention", "size(citations_added) AS added", "size(citations_lost) AS lost"
    )


@query("citation_report", DIFF + """, cur AS (SELECT domain, count(*) AS records FROM domain WHERE conv_id % 2 = 0 GROUP BY domain)
SELECT 'domain' AS section, domain AS item, records FROM cur UNION ALL SELECT 'gap', domain, records FROM cur WHERE records >= 2 AND domain <> 'example.com'
UNION ALL SELECT 'competitor', competitor, count(*) FROM (SELECT unnest(comps) AS competitor FROM rec WHERE full_answer AND conv_id % 2 = 0) GROUP BY competitor
UNION ALL SELECT 'change', coalesce(mention, 'no history'), count(*) FROM changed GROUP BY 2""")
def _(t):
    return A.citation_report(*halves(t), "https://www.example.com")


@query("model_drift", ANSWERS + "SELECT conv_id, turn, served_model <> model AS drift FROM a")
def _(t):
    return A.model_drift(C.answers(t.conversations)).select("conv_id", "turn", "drift")


# Query intelligence over result pages.
@query("query_intent", ITEMS + """, f AS (SELECT query, bool_or(position = 1 AND owned) AS own, bool_or(contains(title, '?')) AS ask FROM item GROUP BY query), q AS (
  SELECT CAST(p_partkey AS VARCHAR) AS query, coalesce(own, false) AS own, coalesce(ask, false) AS ask FROM part LEFT JOIN f ON f.query = CAST(p_partkey AS VARCHAR))
SELECT query, CASE WHEN own THEN 'navigational' ELSE 'informational' END AS intent, CASE WHEN own AND ask THEN 'high' WHEN own OR ask THEN 'medium' ELSE 'low' END AS confidence FROM q""")
def _(t):
    return M.query_intent(t.part.selectExpr("cast(p_partkey AS string) AS query"), items(t))


@query("query_intent_text", """
WITH q AS (SELECT DISTINCT text AS query, lower(trim(text)) AS k FROM documents), h AS (
  SELECT query, CAST(regexp_matches(k, 'login|sign in|register') AS INTEGER) AS n, CAST(regexp_matches(k, 'buy|price|deal|coupon|discount|order|cheap') AS INTEGER) AS t,
    CAST(regexp_matches(k, 'near me|nearby|address|directions|hours') AS INTEGER) AS l, CAST(regexp_matches(k, 'vs|compare|comparison|difference|versus|best') AS INTEGER) AS c,
    CAST(regexp_matches(k, 'how to|how do|how does|why|what is|what are|guide') AS INTEGER) AS i FROM q)
SELECT md5(query) AS query_md5, CASE WHEN n > 0 THEN 'navigational' WHEN t > 0 THEN 'transactional' WHEN l > 0 THEN 'local' WHEN c > 0 THEN 'comparative' ELSE 'informational' END AS intent,
  CASE WHEN n + t + l + c + i >= 2 THEN 'high' WHEN n + t + l + c + i = 1 THEN 'medium' ELSE 'low' END AS confidence FROM h""")
def _(t):
    return M.query_intent(t.documents.selectExpr("text AS query")).selectExpr("md5(query) AS query_md5", "intent", "confidence")


# Result pages and answers of the same queries: some suppliers' hosts are also cited, and every answer asks a question.
BOTH = ANSWERS + ", " + ITEMS.removeprefix("WITH ") + """, shown AS (
  SELECT query, domain, count(*) AS pages, count(DISTINCT position) AS positions, CAST(min(position) AS INTEGER) AS best_position FROM (
    SELECT query, engine, CASE WHEN domain LIKE 's%0.example%' THEN 'ref0.org' ELSE domain END AS domain, min(position) AS position FROM item GROUP BY 1, 2, 3) GROUP BY query, domain
), named AS (SELECT CAST(conv_id % 40 AS VARCHAR) AS query, domain, count(*) AS answers FROM domain GROUP BY 1, 2
), rival AS (
  SELECT query, domain, coalesce(pages, 0) AS pages, coalesce(positions, 0) AS positions, best_position, coalesce(answers, 0) AS answers,
    CASE WHEN pages IS NOT NULL AND answers IS NOT NULL THEN 'both' WHEN pages IS NOT NULL THEN 'serp' ELSE 'ai' END AS source FROM shown FULL JOIN named USING (query, domain)
), asked AS (
  SELECT query, title AS question, 'serp' || engine || position AS source FROM item WHERE contains(title, '?')
  UNION SELECT CAST(conv_id % 40 AS VARCHAR), '如何选择 ' || model, 'ai' || model FROM rec WHERE full_answer
)
"""


def shown(t: Tables):
    return items(t).withColumn("domain", F.expr("CASE WHEN domain LIKE 's%0.example%' THEN 'ref0.org' ELSE domain END"))


def told(t: Tables):
    return cited(t).withColumns({"query": F.expr("cast(conv_id % 40 AS string)"), "answer": F.expr("concat(answer, '。如何选择 ', model, '？')")})


@query("related_questions", BOTH + "SELECT query, question, count(*) AS sources FROM asked GROUP BY query, question")
def _(t):
    return M.related_questions(shown(t), told(t)).select("query", "question", "sources")


@query("answer_questions", BOTH + "SELECT query, question, count(*) AS sources FROM asked GROUP BY query, question HAVING min(source) LIKE 'ai%'")
def _(t):
    return M.related_questions(shown(t), told(t)).where("first_source LIKE 'ai:%'").select("query", "question", "sources")


@query("query_competitors", BOTH + "SELECT query, domain, pages, positions, best_position, answers, source FROM rival")
def _(t):
    return M.query_competitors(shown(t), told(t))


@query("answer_competitors", BOTH + "SELECT query, domain, answers, source FROM rival WHERE domain <> 'example.com' AND answers > 0")
def _(t):
    return M.query_competitors(shown(t), told(t), "https://www.example.com").where("answers > 0").select("query", "domain", "answers", "source")


GAP = ITEMS + """, tok AS (SELECT query, domain, list_filter(regexp_split_to_array(title, '[\\s\\-·,.:|()]+'), lambda w: length(w) BETWEEN 2 AND 12) AS w FROM item),
topic AS (SELECT query, topic, count(DISTINCT domain) AS covered FROM (SELECT query, domain, unnest(w) AS topic FROM tok) GROUP BY query, topic HAVING count(DISTINCT domain) >= 2),
own AS (SELECT DISTINCT lower(p_name) AS title FROM part), gap AS (
  SELECT query, topic, covered, CASE WHEN NOT EXISTS (SELECT 1 FROM own WHERE contains(title, lower(topic))) THEN 'none' WHEN covered >= 3 THEN 'partial' ELSE 'full' END AS own_coverage FROM topic)
"""


def gaps(t: Tables):
    return M.topic_gap(items(t), t.part.selectExpr("p_name AS title"))


@query("topic_gap", (GAP + "SELECT query, topic, covered, own_coverage FROM gap WHERE own_coverage <> 'full'").replace(",.:", ",:"))
def _(t):
    return gaps(t)


def results(t: Tables):
    return t.lineitem.selectExpr("cast(l_partkey AS string) AS query", "concat('https://r.example.com/', l_orderkey) AS url")


def overlap_sql(shared: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS query, l_orderkey AS url FROM lineitem), n AS (SELECT query, count(*) AS n FROM e GROUP BY query),
p AS (SELECT x.query AS a, y.query AS b, count(*) AS shared FROM e x JOIN e y ON x.url = y.url AND x.query < y.query GROUP BY 1, 2),
pair AS (SELECT a, b, shared, shared / (na.n + nb.n - shared) AS jaccard FROM p JOIN n na ON na.query = a JOIN n nb ON nb.query = b WHERE shared >= {shared} OR shared / (na.n + nb.n - shared) >= 0.3)
"""


@query("query_overlap", overlap_sql(2) + "SELECT a, b, shared, round(jaccard, 9) AS jaccard FROM pair")
def _(t):
    return M.query_overlap(results(t)).selectExpr("a", "b", "shared", "round(jaccard, 9) AS jaccard")


def clusters_sql(shared: int) -> str:
    return overlap_sql(shared) + """, both_ways AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair), walk(node, root) AS (
  SELECT DISTINCT a, a FROM both_ways UNION SELECT b, root FROM walk JOIN both_ways ON a = node WHERE root < b), label AS (SELECT node, min(root) AS cluster FROM walk GROUP BY node)
"""


CLUSTERS = clusters_sql(3)


@query("query_clusters", clusters_sql(2) + """
SELECT cluster, queries, round(m, 3) AS overlap FROM (SELECT cluster, count(*) AS queries FROM label GROUP BY cluster)
JOIN (SELECT cluster, avg(jaccard) AS m FROM pair JOIN label ON node = a GROUP BY cluster) USING (cluster)""")
def _(t):
    return M.query_clusters(M.query_overlap(results(t)))[1]


@query("source_availability", ANSWERS + """
SELECT query, true AS serp, bool_or(full_answer) AS ai FROM a GROUP BY query""")
def _(t):
    base = C.answers(t.conversations)
    return M.source_availability(base, serp=base, ai=cited(t).where(A.USABLE))


@query("query_profile", BOTH + ", " + GAP.removeprefix(ITEMS).strip().removeprefix(",").replace(",.:", ",:") + """, f AS (
  SELECT query, bool_or(position = 1 AND owned) AS own FROM item GROUP BY query), nq AS (SELECT query, count(DISTINCT question) AS n FROM asked GROUP BY query),
nc AS (SELECT query, count(*) AS n FROM rival GROUP BY query), ng AS (SELECT query, count(*) AS n FROM gap WHERE own_coverage <> 'full' GROUP BY query)
SELECT query, CASE WHEN own THEN 'navigational' ELSE 'informational' END AS intent, coalesce(nq.n, 0) AS questions, coalesce(nc.n, 0) AS competitors, coalesce(ng.n, 0) AS topic_gaps,
  true AS serp, query IN (SELECT query FROM named) AS ai FROM f LEFT JOIN nq USING (query) LEFT JOIN nc USING (query) LEFT JOIN ng USING (query)""")
def _(t):
    found, said = shown(t), told(t)
    profile = M.query_profile(
        M.query_intent(found, items(t)), M.related_questions(found, said), M.query_competitors(found, said), gaps(t),
        M.source_availability(found, serp=found, ai=said.where(A.USABLE)),
    )
    return profile.select("query", "intent", "questions", "competitors", "topic_gaps", "serp", "ai")
