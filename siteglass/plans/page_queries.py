"""Queries over raw pages: extraction, checks, scores and findings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions.rows import spread
from siteglass.operators import findings as D
from siteglass.operators import page_extract as P
from siteglass.operators import scoring as S
from siteglass.plans.catalog import Tables, query
from siteglass.sources.tables import as_snapshot

AS_OF = dt.datetime(2025, 1, 1)


def snapshot(t: Tables) -> DataFrame:
    return as_snapshot(spread(t.pages))


def facts(t: Tables) -> DataFrame:
    return P.with_page_facts(snapshot(t), AS_OF)


def scored(t: Tables, version: str = "1.0.0") -> DataFrame:
    return S.with_scores(facts(t), version)


# The same facts in SQL. The given pages carry no description, canonical, image, card or structured-data tags.
BLANKS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def decoded(value: str) -> str:
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''")]:
        value = f"replace({value}, '{entity}', '{char}')"
    return value


def visible(value: str) -> str:
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "<[^>]+>"):
        value = f"regexp_replace({value}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace({decoded(value)}, '{BLANKS}+', ' ', 'g'))"


PAGE_CTE = f"""
WITH tagged AS (
  SELECT url, html,
    list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'']|"[^"]*"|''[^'']*'')*)>', 1), lambda n: lower(n)) AS names,
    {decoded("nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)(?:</title>|$)', 1)), '')")} AS title,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    {visible("regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1)")} AS body,
    list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda h: {visible("h")}) AS h1s,
    regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1) AS hrefs
  FROM pages
), page AS (
  SELECT *,
    len(regexp_extract_all(body, '[\\x{{4e00}}-\\x{{9fa5}}]')) + len(regexp_extract_all(body, '[a-zA-Z]+')) AS words,
    len(regexp_extract_all(body, '\\d+(\\.\\d+)?{BLANKS}*(%|％|亿元|万元|亿美元|万|亿|kg|ms|px)'))
      + len(regexp_extract_all(body, '20\\d\\d{BLANKS}*年')) AS facts,
    len(list_filter(names, lambda n: n = 'p')) AS paragraphs,
    len(list_filter(names, lambda n: n IN ('ul', 'ol'))) AS lists,
    len(list_filter(names, lambda n: n = 'li')) AS items,
    len(list_filter(names, lambda n: n IN ('main', 'article'))) > 0 AS landmarks,
    len(list_filter(h1s, lambda h: h <> '')) AS h1_count,
    len(list_filter(h1s, lambda h: regexp_matches(h, '[?？]$'))) AS questions,
    list_filter(regexp_split_to_array(body, '[。！？.!?]+'), lambda s: regexp_replace(s, '{BLANKS}+', '', 'g') <> '') AS pieces
  FROM tagged
), shape AS (
  SELECT *,
    CASE WHEN len(pieces) > 0 THEN CAST(floor(length(regexp_replace(body, '[。！？.!?]', '', 'g')) / len(pieces) + 0.5) AS BIGINT) ELSE 0 END AS sentence,
    regexp_matches(substr(body, 1, 400), '(?i)(总结|核心结论|要点|综上|一句话|tldr|key takeaway| TL;?DR)')
      OR (facts > 0 AND length(substr(body, 1, 400)) > 80) AS summary
  FROM page
), graded AS (
  SELECT *,
    summary OR regexp_matches(substr(body, 1, 400), '(?i)(定义|简言之|简单来说|核心是|答案是|什么是|指的是|：|:|is\\s+a|refers\\s+to|means)') AS direct,
    questions >= 2 AND paragraphs >= questions AS faq,
    items / greatest(paragraphs, 1) AS item_density,
    CASE WHEN title IS NULL THEN 'fail' WHEN length(title) < 10 OR length(title) > 60 THEN 'warn' ELSE 'pass' END AS title_level,
    facts / (greatest(words, 300) / 1000) AS fact_density
  FROM shape
), score_parts AS (
  SELECT *,
    least(25, CASE WHEN summary THEN 8 ELSE 0 END + least(6, lists * 2) + CASE WHEN items >= 5 THEN 3 ELSE 0 END
      + CASE WHEN facts >= 3 THEN 5 WHEN facts > 0 THEN 2 ELSE 0 END) AS q1,
    CASE WHEN h1_count >= 1 THEN 4 ELSE 0 END + CASE WHEN paragraphs >= 5 THEN 2 ELSE 0 END AS s1,
    6 + CASE WHEN lang <> '' THEN 3 ELSE 0 END + 2 + CASE WHEN words > 0 THEN 2 ELSE 0 END AS c1,
    CASE WHEN fact_density >= 3 THEN 6 WHEN fact_density >= 1.5 THEN 4 WHEN fact_density > 0 THEN 2 ELSE 0 END AS fd,
    CASE WHEN sentence > 0 AND sentence <= 45 THEN 4 WHEN sentence <= 70 THEN 2 ELSE 0 END AS r1,
    least(25, CASE WHEN direct THEN 7 ELSE 0 END + CASE WHEN items >= 5 THEN 4 WHEN lists > 0 OR items > 0 THEN 2 ELSE 0 END
      + CASE WHEN facts >= 3 THEN 4 WHEN facts > 0 THEN 2 ELSE 0 END + CASE WHEN faq THEN 3 ELSE 0 END) AS q2,
    CASE WHEN h1_count >= 1 THEN 3 ELSE 0 END + CASE WHEN landmarks THEN 4 ELSE 0 END + CASE WHEN paragraphs >= 4 THEN 2 ELSE 0 END
      + CASE WHEN item_density >= 0.5 THEN 2 WHEN item_density > 0 THEN 1 ELSE 0 END AS s2,
    6 + CASE WHEN lang <> '' THEN 3 ELSE 0 END + 2 + CASE WHEN words > 100 THEN 2 ELSE 0 END AS c2,
    CASE WHEN sentence BETWEEN 10 AND 45 THEN 4 WHEN sentence <= 65 THEN 2 ELSE 0 END AS r2
  FROM graded
), scores AS (
  SELECT *,
    CASE WHEN words < 300 THEN least(3, fd + d1) ELSE fd + d1 END AS f1,
    CASE WHEN words < 300 THEN least(3, fd + d2) ELSE fd + d2 END AS f2
  FROM (SELECT *, CASE WHEN words >= 1200 THEN 4 WHEN words >= 600 THEN 2 ELSE 0 END AS d1,
          CASE WHEN words >= 1500 THEN 4 WHEN words >= 800 THEN 2 WHEN words >= 400 THEN 1 ELSE 0 END AS d2 FROM score_parts)
), checks AS (
  SELECT url, title, u.check_id, u.level, u.weight, u.value FROM (
    SELECT url, title, unnest([
      {{'check_id': 'http', 'level': 'pass', 'weight': 10, 'value': '200'}},
      {{'check_id': 'title', 'level': title_level, 'weight': 10, 'value': coalesce(title, '')}},
      {{'check_id': 'desc', 'level': 'fail', 'weight': 8, 'value': ''}},
      {{'check_id': 'canonical', 'level': 'warn', 'weight': 6, 'value': ''}},
      {{'check_id': 'robots', 'level': 'pass', 'weight': 8, 'value': ''}},
      {{'check_id': 'h1', 'level': CASE WHEN h1_count = 1 THEN 'pass' ELSE 'warn' END, 'weight': 7, 'value': coalesce(list_filter(h1s, lambda h: h <> '')[1], '')}},
      {{'check_id': 'alt', 'level': 'pass', 'weight': 4, 'value': '0'}},
      {{'check_id': 'viewport', 'level': 'warn', 'weight': 5, 'value': ''}},
      {{'check_id': 'lang', 'level': CASE WHEN lang <> '' THEN 'pass' ELSE 'warn' END, 'weight': 4, 'value': lang}},
      {{'check_id': 'jsonld', 'level': 'warn', 'weight': 8, 'value': ''}},
      {{'check_id': 'og', 'level': 'warn', 'weight': 5, 'value': ''}}
    ]) AS u FROM scores)
), found AS (
  SELECT url, check_id,
    CASE check_id WHEN 'title' THEN CASE WHEN value = '' THEN 'title/missing' ELSE 'title/length' END
      WHEN 'desc' THEN 'desc/missing' WHEN 'h1' THEN 'h1/structure' WHEN 'og' THEN 'og/incomplete' ELSE check_id || '/missing' END AS issue_id,
    CASE WHEN level = 'fail' THEN 'major' ELSE 'minor' END AS severity,
    CASE check_id WHEN 'canonical' THEN 'canonical' WHEN 'viewport' THEN 'viewport' WHEN 'lang' THEN 'lang' WHEN 'og' THEN 'og-skeleton' END AS fix_id
  FROM checks WHERE level <> 'pass'
), dims AS (
  SELECT url, u.dimension, u.score, u.max, q1 + s1 + c1 + f1 + r1 AS total FROM (
    SELECT *, unnest([
      {{'dimension': 'quotability', 'score': q1, 'max': 25}}, {{'dimension': 'structuredness', 'score': s1, 'max': 20}},
      {{'dimension': 'entity', 'score': 0, 'max': 15}}, {{'dimension': 'crawlability', 'score': c1, 'max': 15}},
      {{'dimension': 'density', 'score': f1, 'max': 15}}, {{'dimension': 'readability', 'score': r1, 'max': 10}}
    ]) AS u FROM scores)
)
"""

SEO = "CAST(floor(sum(weight * CASE level WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END) / sum(weight) * 100 + 0.5) AS INTEGER)"


@query("page_facts", PAGE_CTE + """
SELECT url, title, CAST(NULL AS VARCHAR) AS description, lang, false AS has_viewport, 0 AS og_tags, 0 AS hreflang_codes FROM page""")
def _(t):
    return P.page_facts(facts(t)).select(
        "url", "title", "description", "lang", "has_viewport",
        F.size("og").alias("og_tags"), F.size("hreflang").alias("hreflang_codes"),
    )


@query("page_headings", PAGE_CTE + """
SELECT url, CAST(ordinal AS INTEGER) AS ordinal, 1 AS level, text
FROM (SELECT url, unnest(f) AS text, generate_subscripts(f, 1) - 1 AS ordinal
      FROM (SELECT url, list_filter(h1s, lambda h: h <> '') AS f FROM page))""")
def _(t):
    return P.page_headings(facts(t))


ENCODED = r"""array_to_string(list_transform(string_split(h, ''), lambda c:
  CASE WHEN regexp_matches(c, '^[\x21-\x7e]$') AND c NOT IN ('"', '<', '>', '`', '{', '}', '^') THEN c ELSE url_encode(c) END), '')"""

LINK_CTE = PAGE_CTE + f"""
, links AS (
  SELECT DISTINCT url, regexp_extract(url, '^https?://[^/]+') || {ENCODED} AS target
  FROM (SELECT url, unnest(hrefs) AS h FROM page) WHERE h LIKE '/%'
)"""


@query("page_links", LINK_CTE + " SELECT url, target, true AS internal FROM links")
def _(t):
    return P.page_links(facts(t))


@query("body_text", PAGE_CTE + " SELECT url, md5(body) AS text_md5, CAST(words AS INTEGER) AS word_count FROM page")
def _(t):
    return P.body_text(facts(t)).select("url", F.md5("text").alias("text_md5"), "word_count")


@query("image_alt", PAGE_CTE + """
SELECT url, CAST(len(list_filter(names, lambda n: n = 'img')) AS INTEGER) AS image_count, 0 AS images_without_alt FROM page""")
def _(t):
    return P.image_alt(facts(t))


@query("content_shape", PAGE_CTE + """
SELECT url, CAST(paragraphs AS INTEGER) AS paragraphs, CAST(lists AS INTEGER) AS lists, CAST(items AS INTEGER) AS list_items,
  CAST(facts AS INTEGER) AS data_points, summary AS has_summary, sentence AS sentence_length, direct AS has_direct_answer,
  landmarks AS has_landmarks, true AS heading_continuity, faq AS has_faq, round(item_density, 6) AS structured_density,
  CAST(len(list_filter(hrefs, lambda h: regexp_matches(h, '(?i)^https?://'))) AS INTEGER) AS external_citations
FROM graded""")
def _(t):
    return P.content_shape(facts(t)).select(
        "url", "paragraphs", "lists", "list_items", "data_points", "has_summary", "sentence_length", "has_direct_answer",
        "has_landmarks", "heading_continuity", "has_faq", F.round("structured_density", 6).alias("structured_density"),
        "external_citations",
    )


@query("seo_checks", PAGE_CTE + " SELECT url, check_id, level, weight, value FROM checks")
def _(t):
    return S.seo_checks(scored(t))


@query("seo_score", PAGE_CTE + f" SELECT url, {SEO} AS seo_score FROM checks GROUP BY url")
def _(t):
    return S.seo_score(scored(t))


@query("geo_score_v1", PAGE_CTE + """
SELECT url, CAST(q1 AS INTEGER) AS quotability, CAST(s1 AS INTEGER) AS structuredness, 0 AS entity, CAST(c1 AS INTEGER) AS crawlability,
  CAST(f1 AS INTEGER) AS density, CAST(r1 AS INTEGER) AS readability, CAST(q1 + s1 + c1 + f1 + r1 AS INTEGER) AS geo_score FROM scores""")
def _(t):
    return S.geo_score(scored(t))


@query("geo_score_v2", PAGE_CTE + """
SELECT url, CAST(q2 AS INTEGER) AS quotability, CAST(s2 AS INTEGER) AS structuredness, 0 AS entity, CAST(c2 AS INTEGER) AS crawlability,
  CAST(f2 AS INTEGER) AS density, CAST(r2 AS INTEGER) AS readability, CAST(q2 + s2 + c2 + f2 + r2 AS INTEGER) AS geo_score FROM scores""")
def _(t):
    return S.geo_score(scored(t, "2.0.0"))


@query("geo_breakdown", PAGE_CTE + """
SELECT url, dimension, CAST(score AS INTEGER) AS score, max, CAST(total AS INTEGER) AS geo_score FROM dims""")
def _(t):
    return S.geo_breakdown(scored(t))


@query("weak_dimension_advice", PAGE_CTE + " SELECT url, dimension AS advice_id FROM dims WHERE score / max < 0.75")
def _(t):
    return S.weak_dimension_advice(scored(t)).select("url", "advice_id")


# Pages whose address ends in .html stand in for failed fetches.
@query("fetch_failures", """
SELECT url, 'fetch' AS check_id, 'fail' AS level, 100 AS weight, 0 AS seo_score, 0 AS geo_score
FROM pages WHERE url LIKE '%.html'""")
def _(t):
    pages = snapshot(t).withColumn("http_status", F.expr("CASE WHEN url LIKE '%.html' THEN 0 ELSE 200 END"))
    return S.fetch_failures(S.with_scores(P.with_page_facts(pages, AS_OF)))


@query("findings", PAGE_CTE + " SELECT url, check_id, issue_id, severity, fix_id FROM found")
def _(t):
    return D.findings(S.seo_checks(scored(t)))


@query("finding_severity", PAGE_CTE + """
SELECT url, CAST(0 AS BIGINT) AS blockers, count(*) FILTER (severity = 'major') AS majors, count(*) FILTER (severity = 'minor') AS minors,
  count(*) FILTER (severity = 'major') > 0 AS failing FROM found GROUP BY url""")
def _(t):
    return D.finding_severity(D.findings(S.seo_checks(scored(t))), t.pages)


@query("fixable_rollup", PAGE_CTE + """
SELECT fix_id, count(*) AS findings, count(DISTINCT url) AS pages FROM found WHERE fix_id IS NOT NULL GROUP BY fix_id""")
def _(t):
    return D.fixable_rollup(D.findings(S.seo_checks(scored(t))))
