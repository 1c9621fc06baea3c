"""Queries over structured data: nodes, signals, page types, fields, consistency, clarity, draft coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.operators import jsonld as J
from siteglass.operators import structured_data as Q
from siteglass.plans.catalog import Tables, query
from siteglass.plans.page_queries import AS_OF
from siteglass.sources.carriers import marked_up_pages


def pages(t: Tables):
    return marked_up_pages(t.part)


def facts(t: Tables):
    return Q.with_schema_facts(pages(t), AS_OF)


def typed(t: Tables):
    return Q.with_page_type(facts(t))


URL = "'https://shop' || p_partkey || '.example.com/' || CASE p_type WHEN 'SMALL' THEN '' WHEN 'PROMO' THEN 'about' ELSE 'item' END"
MARKED = f"WITH page AS (SELECT {URL} AS url, * FROM part)"
PAGE_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 'product' WHEN 'STANDARD' THEN 'article' WHEN 'MEDIUM' THEN 'faq' WHEN 'PROMO' THEN 'organization' WHEN 'LARGE' THEN 'faq' ELSE 'website' END"
NODES = (
    "CASE p_type WHEN 'ECONOMY' THEN ['Product', 'Offer', 'Brand'] WHEN 'STANDARD' THEN ['Article', 'Person', 'Organization'] "
    "WHEN 'MEDIUM' THEN CASE WHEN p_size % 2 = 0 THEN ['FAQPage', 'Question', 'Answer', 'Question', 'Answer'] ELSE ['FAQPage', 'Question', 'Answer', 'Question'] END "
    "WHEN 'PROMO' THEN ['Organization', 'WebSite,CreativeWork'] ELSE [] END"
)


@query("jsonld_nodes", MARKED + f"""
SELECT url, CAST(i - 1 AS INTEGER) AS node_ordinal, n[i] AS types FROM (SELECT url, {NODES} AS n, unnest(range(1, len({NODES}) + 1)) AS i FROM page)""")
def _(t):
    return J.jsonld_nodes(pages(t)).select("url", "node_ordinal", F.array_join("types", ",").alias("types"))


@query("jsonld_signals", MARKED + """
SELECT url,
  CASE p_type WHEN 'ECONOMY' THEN 'Product' WHEN 'STANDARD' THEN 'Article,Person,Organization' WHEN 'MEDIUM' THEN 'FAQPage,Question' WHEN 'PROMO' THEN 'Organization,WebSite,CreativeWork' ELSE '' END AS types,
  p_type = 'STANDARD' AS has_author, p_type = 'STANDARD' AS has_organization, p_type = 'STANDARD' AS has_date_published, false AS has_date_modified,
  p_type IN ('STANDARD', 'PROMO') AS has_same_as, p_type = 'MEDIUM' AS has_faq_page, p_type = 'STANDARD' AS has_author_same_as
FROM page""")
def _(t):
    return J.jsonld_signals(pages(t)).withColumn("types", F.array_join("types", ","))


@query("root_types", MARKED + """
SELECT url, unnest(CASE p_type WHEN 'ECONOMY' THEN ['Product'] WHEN 'STANDARD' THEN ['Article'] WHEN 'MEDIUM' THEN ['FAQPage'] WHEN 'PROMO' THEN ['Organization', 'WebSite', 'CreativeWork'] ELSE [] END) AS root_type FROM page""")
def _(t):
    return J.root_types(pages(t))


@query("page_contacts", MARKED + """
SELECT url, u.kind, u.value FROM (SELECT url, unnest([{'kind': 'tel', 'value': '+155501'}, {'kind': 'mailto', 'value': 'a@b.co'},
  {'kind': 'social', 'value': 'https://github.com/x'}, {'kind': 'address', 'value': '1 Main St'}]) AS u FROM page WHERE p_type = 'LARGE')""")
def _(t):
    return Q.page_contacts(facts(t))


@query("page_dates", MARKED + """
SELECT url, CASE WHEN p_type = 'STANDARD' THEN '2024-03-05' END AS published_date, CAST(NULL AS VARCHAR) AS modified_date,
  CASE WHEN p_type = 'LARGE' THEN '2024-05-06,2024-07-08' ELSE '' END AS visible_dates FROM page""")
def _(t):
    return Q.page_dates(facts(t)).withColumn("visible_dates", F.array_join("visible_dates", ","))


@query("page_qa_pairs", MARKED + """
SELECT url, u.ordinal, u.question, u.answer FROM (SELECT url, unnest([{'ordinal': 0, 'question': 'How big?', 'answer': 'Ten units.'},
  {'ordinal': 1, 'question': 'How old?', 'answer': 'Nine years. Address: 1 Main St'}]) AS u FROM page WHERE p_type = 'LARGE')""")
def _(t):
    return Q.page_qa_pairs(facts(t))


@query("page_steps", MARKED + """
SELECT url, u.ordinal, u.step FROM (SELECT url, unnest([{'ordinal': 0, 'step': 'Cut'}, {'ordinal': 1, 'step': 'Glue'}]) AS u FROM page WHERE p_type = 'LARGE')""")
def _(t):
    return Q.page_steps(facts(t))


@query("page_prices", MARKED + """
SELECT url, u.raw, u.value, u.currency FROM (SELECT url, unnest([{'raw': '$12.50', 'value': '12.50', 'currency': 'USD'},
  {'raw': '30 USD', 'value': '30', 'currency': 'USD'}]) AS u FROM page WHERE p_type = 'LARGE')""")
def _(t):
    return Q.page_prices(facts(t))


@query("page_actions", MARKED + " SELECT url, p_type = 'LARGE' AS has_buy_action, p_type = 'LARGE' AS has_search_action FROM page")
def _(t):
    return Q.page_actions(facts(t))


@query("page_type", MARKED + f"""
SELECT url, {PAGE_TYPE} AS page_type, CASE p_type WHEN 'LARGE' THEN 'medium' WHEN 'SMALL' THEN 'low' ELSE 'high' END AS type_confidence FROM page""")
def _(t):
    return Q.page_type(typed(t))


FIELDS = MARKED + """, catalogue(p_type, path, level, status) AS (VALUES
  ('ECONOMY', 'name', 'required', 'present'), ('ECONOMY', 'image', 'recommended', 'missing'), ('ECONOMY', 'description', 'recommended', 'missing'),
  ('ECONOMY', 'brand.name', 'recommended', 'present'), ('ECONOMY', 'offers.price', 'recommended', 'present'),
  ('ECONOMY', 'offers.priceCurrency', 'recommended', 'missing'), ('ECONOMY', 'offers.availability', 'recommended', 'missing'),
  ('ECONOMY', 'sku', 'recommended', 'present'), ('ECONOMY', 'aggregateRating.ratingValue', 'recommended', 'missing'),
  ('STANDARD', 'headline', 'required', 'present'), ('STANDARD', 'datePublished', 'required', 'present'),
  ('STANDARD', 'author.name', 'recommended', 'present'), ('STANDARD', 'publisher.name', 'recommended', 'present'),
  ('STANDARD', 'dateModified', 'recommended', 'missing'), ('STANDARD', 'image', 'recommended', 'missing'),
  ('STANDARD', 'mainEntityOfPage', 'recommended', 'missing'), ('STANDARD', 'description', 'recommended', 'missing'),
  ('MEDIUM', 'mainEntity', 'required', 'present'), ('MEDIUM', 'mainEntity[].name', 'recommended', 'present'),
  ('MEDIUM', 'mainEntity[].acceptedAnswer.text', 'recommended', 'by size'),
  ('LARGE', 'mainEntity', 'required', 'missing'), ('LARGE', 'mainEntity[].name', 'recommended', 'missing'),
  ('LARGE', 'mainEntity[].acceptedAnswer.text', 'recommended', 'missing'),
  ('PROMO', 'name', 'required', 'present'), ('PROMO', 'url', 'required', 'present'), ('PROMO', 'logo', 'recommended', 'empty'),
  ('PROMO', 'sameAs', 'recommended', 'present'), ('PROMO', 'contactPoint.telephone', 'recommended', 'missing'),
  ('PROMO', 'contactPoint.email', 'recommended', 'missing'), ('PROMO', 'address', 'recommended', 'missing'),
  ('SMALL', 'name', 'required', 'missing'), ('SMALL', 'url', 'required', 'missing'),
  ('SMALL', 'potentialAction', 'recommended', 'missing'), ('SMALL', 'description', 'recommended', 'missing')
), field AS (
  SELECT url, p_type, p_size, path, level, CASE WHEN status <> 'by size' THEN status WHEN p_size % 2 = 0 THEN 'present' ELSE 'incomplete' END AS status
  FROM page JOIN catalogue USING (p_type))"""


@query("field_completeness", FIELDS + f" SELECT url, {PAGE_TYPE} AS page_type, path, level, status FROM field")
def _(t):
    return Q.field_completeness(typed(t))


@query("schema_gap_counts", FIELDS + """
SELECT url, count(*) FILTER (level = 'required' AND status IN ('missing', 'empty')) AS missing_required,
  count(*) FILTER (level = 'recommended' AND status IN ('missing', 'empty', 'incomplete')) AS missing_recommended FROM field GROUP BY url""")
def _(t):
    return Q.schema_gap_counts(Q.field_completeness(typed(t)))


@query("schema_consistency", MARKED + """
SELECT url, 'headline-h1-mismatch' AS kind, 'mismatch' AS severity, p_name AS jsonld_value, p_name || ' and everything else about it' AS page_value
FROM page WHERE p_type IN ('STANDARD', 'ECONOMY') AND p_size % 2 = 1
UNION ALL SELECT url, 'headline-h1-mismatch', 'mismatch', p_brand, p_name || CASE WHEN p_size % 2 = 1 THEN ' and everything else about it' ELSE '' END FROM page WHERE p_type = 'PROMO'
UNION ALL SELECT url, 'date-published-mismatch', 'mismatch', '2024-04-01', '2024-03-05' FROM page WHERE p_type = 'STANDARD' AND p_size % 3 = 0
UNION ALL SELECT url, 'author-mismatch', 'suspect', 'Bob Ray', 'Ann Lee' FROM page WHERE p_type = 'STANDARD' AND p_size % 5 = 0
UNION ALL SELECT url, 'title-mismatch', 'suspect', p_brand, p_name || ' ' || p_brand FROM page
  WHERE p_type = 'PROMO' AND length(p_brand) / length(p_name || ' ' || p_brand) < 0.6""")
def _(t):
    return Q.schema_consistency(typed(t)).drop("page_type")


@query("entity_clarity", MARKED + """, signal AS (
  SELECT url, 'author' AS signal, CASE WHEN p_type = 'STANDARD' THEN CASE WHEN p_size % 5 = 0 THEN 'Bob Ray' ELSE 'Ann Lee' END END AS value, 'jsonld' AS source FROM page
  UNION ALL SELECT url, 'organization', CASE p_type WHEN 'STANDARD' THEN 'P' WHEN 'PROMO' THEN p_brand END, 'jsonld' FROM page
  UNION ALL SELECT url, 'sameAs', CASE p_type WHEN 'STANDARD' THEN '1' WHEN 'PROMO' THEN '2' WHEN 'LARGE' THEN '1' END, CASE WHEN p_type = 'LARGE' THEN 'visible' ELSE 'jsonld' END FROM page
  UNION ALL SELECT url, 'contact', CASE p_type WHEN 'LARGE' THEN '+155501' END, 'visible' FROM page
  UNION ALL SELECT url, 'datePublished', CASE WHEN p_type = 'STANDARD' THEN CASE WHEN p_size % 3 = 0 THEN '2024-04-01' ELSE '2024-03-05' END END, 'jsonld' FROM page
  UNION ALL SELECT url, 'dateModified', NULL, 'jsonld' FROM page
) SELECT url, signal, value IS NOT NULL AS present, value, CASE WHEN value IS NOT NULL THEN source END AS source FROM signal""")
def _(t):
    return Q.entity_clarity(facts(t))


@query("draft_coverage", FIELDS + f""", known AS (
  SELECT {PAGE_TYPE} AS page_type, path, level,
    status IN ('present') OR (p_type = 'ECONOMY' AND path IN ('image')) OR (p_type = 'STANDARD' AND path = 'mainEntityOfPage')
    OR (p_type = 'LARGE') OR (p_type = 'SMALL' AND path IN ('name', 'url')) AS known
  FROM field)
SELECT page_type, path, level, count(*) AS pages, count(*) FILTER (known) AS fillable, count(*) - count(*) FILTER (known) AS manual FROM known GROUP BY ALL""")
def _(t):
    return Q.draft_coverage(typed(t))
