"""Adapters that give the supplied tables the shapes operators expect.

Every frame is derived row by row (or by one grouping) from a supplied table,
so its size follows the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from siteglass.functions.rows import spread

_JSONLD = """CASE p_type
  WHEN 'ECONOMY' THEN concat('{"@type":"Product","name":"', p_name, '","sku":"k', p_partkey, '","image":"  ","brand":{"@type":"Brand","name":"', p_brand,
    '"},"offers":[{"@type":"Offer","price":"9.5"}]}')
  WHEN 'STANDARD' THEN concat('{"@type":"Article","headline":"', p_name, '","datePublished":"', CASE WHEN p_size % 3 = 0 THEN '2024-04-01' ELSE '2024-03-05' END,
    '","author":{"@type":"Person","name":"', CASE WHEN p_size % 5 = 0 THEN 'Bob Ray' ELSE 'Ann Lee' END,
    '","sameAs":["https://x.com/a"]},"publisher":{"@type":"Organization","name":"P"}}')
  WHEN 'MEDIUM' THEN concat('{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"A","acceptedAnswer":{"@type":"Answer","text":"T"}},{"@type":"Question","name":"B"',
    CASE WHEN p_size % 2 = 0 THEN ',"acceptedAnswer":{"@type":"Answer","text":"U"}' ELSE '' END, '}]}')
  WHEN 'PROMO' THEN concat('{"@graph":[{"@type":"Organization","name":"', p_brand, '","url":"u","logo":"","sameAs":["a","b"]},{"@type":["WebSite","CreativeWork"],"name":"w"}]}')
  WHEN 'SMALL' THEN '{bad'
  ELSE '' END"""

_VISIBLE = (
    '<ol><li>Cut</li><li>Glue</li></ol><p>Price $12.50 or 30 USD buy now</p><a href="tel:+1 555-01">call</a>'
    '<a href="mailto:a@b.co">mail</a><a href="https://github.com/x">gh</a><p>2024-05-06 and 2024年7月8日.</p>'
    '<h2>How big?</h2><p>Ten units.</p><h2>How old?</h2><p>Nine years.</p><form action="/search"></form><p>Address: 1 Main St</p>'
)


def marked_up_pages(part: DataFrame) -> DataFrame:
    """Pages with structured data of several kinds (and none, and broken), one per part."""
    return spread(part).selectExpr(
        "concat('https://shop', p_partkey, '.example.com/', CASE p_type WHEN 'SMALL' THEN '' WHEN 'PROMO' THEN 'about' ELSE 'item' END) AS url",
        "200 AS http_status",
        f"""concat('<html lang="en"><head><title>', p_name, ' ', p_brand, '</title>',
          CASE WHEN p_type = 'STANDARD' THEN '<meta name="author" content="Ann Lee"><meta property="article:published_time" content="2024-03-05">' ELSE '' END,
          '<script type="application/ld+json">', {_JSONLD}, '</script></head><body><h1>', p_name,
          CASE WHEN p_size % 2 = 1 THEN ' and everything else about it' ELSE '' END, '</h1>',
          CASE WHEN p_type = 'LARGE' THEN '{_VISIBLE}' ELSE '' END, '</body></html>') AS html""",
        "p_type", "p_size",
    )


def site_pages(orders: DataFrame) -> DataFrame:
    """A crawled site with one page per order: statuses, titles, canonicals, redirects and scores from its columns."""
    return orders.selectExpr(
        "o_orderkey AS page_id",
        "concat('https://shop.example.com/o/', o_orderkey) AS url",
        "CASE WHEN month(o_orderdate) = 2 THEN concat('https://shop.example.com/o/', o_custkey) ELSE concat('https://shop.example.com/o/', o_orderkey) END AS final_url",
        "CASE o_orderstatus WHEN 'P' THEN 404 ELSE 200 END AS http_status",
        "CASE month(o_orderdate) WHEN 1 THEN array('https://shop.example.com/r1', 'https://shop.example.com/r2', 'https://shop.example.com/r3') "
        "WHEN 2 THEN array(concat('https://shop.example.com/o/', o_custkey)) "
        "WHEN 3 THEN array('https://shop.example.com/r1', concat('https://shop.example.com/o/', o_orderkey)) "
        "ELSE cast(array() AS array<string>) END AS redirect_chain",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN '  ' ELSE concat('Orders of customer ', o_custkey, ' ', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END) END AS title",
        "CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE concat('Bought on ', date_format(o_orderdate, 'yyyy-MM-dd')) END AS description",
        "CASE WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE concat('Customer ', o_custkey) END AS h1",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'https://other.example.net/x' WHEN '2-HIGH' THEN NULL "
        "WHEN '3-MEDIUM' THEN concat('/o/', o_custkey) WHEN '4-NOT SPECIFIED' THEN 'https://' "
        "ELSE concat('https://shop.example.com/o/', o_orderkey) END AS canonical",
        "month(o_orderdate) = 12 AS noindex",
        "CASE WHEN month(o_orderdate) = 11 THEN 'robots' END AS blocked_reason",
        "cast(floor(o_totalprice / 1000) AS int) AS word_count",
        "cast(floor(o_totalprice) % 100 AS int) AS geo_score",
        "day(o_orderdate) % 5 AS click_depth",
        "CASE WHEN month(o_orderdate) IN (4, 5) THEN array('Article', 'Person') WHEN month(o_orderdate) = 6 THEN array('Product') "
        "ELSE cast(array() AS array<string>) END AS jsonld_types",
        "array(named_struct('id', 'quotability', 'score', cast(floor(o_totalprice) % 26 AS int), 'max', 25), "
        "named_struct('id', 'entity', 'score', cast(floor(o_totalprice) % 16 AS int), 'max', 15)) AS breakdown",
    )


def site_links(lineitem: DataFrame) -> DataFrame:
    """Links of that site: the page of an order links to the page numbered like the part."""
    return lineitem.selectExpr(
        "concat('https://shop.example.com/o/', l_orderkey) AS source", "concat('https://shop.example.com/o/', l_partkey) AS target"
    )


def result_items(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Result-page items: a part is a keyword, a supplier a domain, an order a URL, the return flag an engine."""
    titles = part.selectExpr("p_partkey AS l_partkey", "concat(p_name, CASE WHEN p_size % 7 = 0 THEN '?' ELSE '' END, ' - ', p_type, ' ', p_brand) AS title")
    return lineitem.join(titles, "l_partkey").selectExpr(
        "cast(l_partkey AS string) AS query", "l_returnflag AS engine",
        "concat('https://s', l_suppkey, '.example', l_suppkey % 7, '.com/o/', l_orderkey) AS url",
        "concat('s', l_suppkey, '.example', l_suppkey % 7, '.com') AS domain",
        "l_linenumber AS position", "title", "l_linestatus = 'F' AND l_linenumber = 1 AS owned",
    )


def answers(conversations: DataFrame) -> DataFrame:
    """AI answers: assistant turns with citations appended; other turns become failed or refused calls."""
    return conversations.selectExpr(
        "conv_id", "turn", "concat('topic ', conv_id % 40) AS query", "concat('m', turn % 3) AS model",
        "CASE role WHEN 'assistant' THEN 200 WHEN 'system' THEN 429 ELSE CASE turn % 4 WHEN 0 THEN 500 WHEN 2 THEN 0 ELSE 401 END END AS http_status",
        "CASE WHEN role <> 'assistant' THEN NULL WHEN conv_id % 11 = 0 THEN 'Sorry, I cannot provide a recommendation here.' "
        "WHEN conv_id % 13 = 0 THEN 'No.' "
        "ELSE concat(text, ' See [guide ', turn, '](https://www.d', conv_id % 7, '.example.com/p', turn, ') and www.ref', turn % 5, '.org/x. "
        "Also https://d', conv_id % 3, '.co.uk/a) or shop.io here') END AS answer",
        "'de' AS brand", "array('la', 'Die', 'zzz') AS competitors",
        "concat('m', (turn + conv_id % 2) % 3) AS served_model",
        "timestamp_seconds(1704067200 + conv_id * 60 + turn) AS observed_at",
    )


def search_rows(events: DataFrame) -> DataFrame:
    """Search-performance rows per user (as query) and half month: views are impressions, clicks are clicks."""
    return events.selectExpr(
        "CASE WHEN day(ts) <= 15 THEN 'previous' ELSE 'current' END AS period", "concat('https://www.example.com/u/', user_id, '/') AS key",
        "event_type", "value",
    ).groupBy("period", "key").agg(
        *_search_measures()
    ).where("impressions > 0 OR clicks > 0").selectExpr(
        "period", "array(key) AS keys", "clicks", "impressions",
        "CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0D END AS ctr", "position",
    )


def _search_measures():
    from pyspark.sql import functions as F

    return [
        F.expr("count_if(event_type = 'click')").alias("clicks"),
        F.expr("count_if(event_type = 'view')").alias("impressions"),
        # Exact, so that a mean halfway between two positions does not hang on the order of the sum.
        F.expr("cast(round(avg(cast(value AS decimal(18, 6))) / 10, 6) AS double)").alias("position"),
    ]


def vital_samples(events: DataFrame) -> DataFrame:
    """Raw timing samples: users are targets, event types are metrics."""
    return events.selectExpr(
        "concat('https://www.example.com/u/', user_id) AS target",
        "CASE event_type WHEN 'view' THEN 'largest_contentful_paint' WHEN 'click' THEN 'interaction_to_next_paint' "
        "WHEN 'error' THEN 'cumulative_layout_shift' WHEN 'signup' THEN 'first_contentful_paint' ELSE 'experimental_time_to_first_byte' END AS metric",
        "value * CASE event_type WHEN 'view' THEN 60D WHEN 'click' THEN 6D WHEN 'error' THEN 0.003D WHEN 'signup' THEN 40D ELSE 20D END AS sample",
    )


def observations(events: DataFrame) -> DataFrame:
    """Observation log: one row per event; type from the event type, subject from the user, run from the day."""
    return events.selectExpr(
        "concat('obs-', event_id) AS id",
        "CASE event_type WHEN 'click' THEN 'rank' WHEN 'view' THEN 'geo_score' WHEN 'error' THEN 'ai_mention' WHEN 'signup' THEN 'crawl' ELSE 'gsc' END AS type",
        "concat('site:https://www.example.com/u/', user_id) AS subject",
        "cast(NULL AS string) AS target",
        "concat('http:https://www.example.com/', user_id % 2) AS source",
        "ts AS observed_at",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('run-', date_format(ts, 'yyyy-MM-dd')) END AS run_id",
        "'observer@1' AS observer_version",
        "concat('parser@', cast(get_json_object(props, '$.k') AS int) DIV 50) AS parser_version",
        "CASE WHEN event_type = 'click' THEN concat('strategy@', event_id % 2) END AS strategy_version",
        "cast(NULL AS string) AS prompt_version",
        "CASE event_type WHEN 'error' THEN CASE WHEN value < 20 THEN 'MENTIONED' WHEN value < 60 THEN 'NOT_MENTIONED' WHEN value < 90 THEN 'INDETERMINATE' ELSE 'UNOBSERVABLE' END "
        "ELSE CASE WHEN value > 200 THEN 'BLOCKED' ELSE 'OBSERVED' END END AS status",
        "CASE WHEN value > 200 AND event_id % 2 = 0 THEN 'HTTP 429' END AS status_reason",
        "array(concat('ev-', event_id % 3)) AS evidence_refs",
        "to_json(named_struct('seoScore', cast(floor(value) AS int), 'geoScore', cast(floor(value / 2) AS int), "
        "'targetRank', CASE WHEN value < 30 THEN NULL ELSE cast(floor(value / 10) AS int) END, "
        "'items', array(named_struct('domain', concat('d', event_id % 4, '.com')), named_struct('domain', concat('d', event_id % 3, '.org'))), "
        "'citedDomains', array(concat('c', event_id % 4, '.com'), concat('c', event_id % 3, '.org')), "
        "'geoVersion', CASE WHEN event_id % 9 = 0 THEN '2.0.0' ELSE '1.0.0' END), map('ignoreNullFields', 'false')) AS result",
        "array(named_struct('signal', 'value.band', 'value', cast(cast(floor(value / 20) AS int) AS string)), "
        "named_struct('signal', concat('extra.', event_id % 2), 'value', 'x')) AS signals",
        "CASE WHEN value > 100 THEN 'certain' ELSE 'medium' END AS confidence",
        "named_struct('expected', 2, 'observed', CASE WHEN value > 200 THEN 0 WHEN event_id % 7 = 0 THEN 1 ELSE 2 END, "
        "'ratio', CASE WHEN value > 200 THEN 0D WHEN event_id % 7 = 0 THEN 0.5D ELSE 1D END) AS coverage",
        "event_id AS write_seq",
    )


def language_pages(customer: DataFrame) -> DataFrame:
    """Pages with language alternates in tags or header, and the states their targets can be in."""
    own, nxt = "concat('https://i18n.example.com/', c_custkey)", "concat('https://i18n.example.com/', c_custkey + 1)"
    tag = "concat('<link rel=\"alternate\" hreflang=\"', {lang}, '\" href=\"', {url}, '\">')"
    return customer.selectExpr(
        f"{own} AS url",
        f"CASE c_mktsegment WHEN 'BUILDING' THEN concat({tag.format(lang=repr('en'), url=own)}, {tag.format(lang=repr('de'), url=nxt)}, {tag.format(lang=repr('x-default'), url=own)}) "
        f"WHEN 'AUTOMOBILE' THEN {tag.format(lang=repr('fr-FR'), url=nxt)} WHEN 'MACHINERY' THEN {tag.format(lang=repr('english'), url=own)} ELSE '<p>none</p>' END AS html",
        f"CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN concat('<', {nxt}, '>; rel=\"alternate\"; hreflang=\"de\"') END AS link_header",
        "CASE WHEN c_nationkey = 3 THEN 404 ELSE 200 END AS http_status", "c_nationkey = 4 AS noindex",
        "CASE WHEN c_nationkey = 5 THEN array('https://i18n.example.com/moved') ELSE cast(array() AS array<string>) END AS redirect_chain",
        f"CASE c_nationkey WHEN 6 THEN 'https://i18n.example.com/canon' WHEN 7 THEN NULL ELSE {own} END AS canonical",
        "CASE c_nationkey WHEN 7 THEN 'ZH-cn' WHEN 8 THEN 'en' WHEN 9 THEN 'zh' ELSE '' END AS html_lang",
        "CASE c_nationkey WHEN 7 THEN 'plain latin text' WHEN 8 THEN '中文字符 mixed' WHEN 9 THEN '中文 half' ELSE 'text' END AS text",
    )


def language_sitemaps(customer: DataFrame) -> DataFrame:
    """Sitemap files with alternates for every page of one segment."""
    return customer.where("c_mktsegment = 'FURNITURE'").selectExpr(
        "concat('https://i18n.example.com/map', c_custkey, '.xml') AS url",
        "concat('<urlset><url>\\n<loc> https://i18n.example.com/', c_custkey, ' </loc><xhtml:link rel=\"alternate\" hreflang=\"es\" href=\"https://i18n.example.com/', "
        "c_custkey + 2, '\"/></url></urlset>') AS body",
    )


def sitemap_files(part: DataFrame) -> DataFrame:
    """A tree of sitemap files: file k is an index of files 2k+1 and 2k+2, or a list of two pages."""
    file = "'https://sm.example.com/f'"
    return spread(part).selectExpr(
        f"concat({file}, p_partkey, '.xml') AS url",
        f"CASE WHEN p_size % 3 = 0 THEN concat('<?xml version=\"1.0\"?><sitemapindex ><sitemap><loc>', {file}, 2 * p_partkey + 1, '.xml</loc></sitemap><sitemap><loc>', "
        f"{file}, 2 * p_partkey + 2, '.xml</loc></sitemap></sitemapindex>') "
        "ELSE concat('<urlset><url><sm:loc><![CDATA[ https://sm.example.com/p', p_partkey, ' ]]></sm:loc></url><url><loc>\\nhttps://sm.example.com/q', "
        "p_partkey % 10, '</loc></url><url><loc> </loc></url></urlset>') END AS body",
    )


def robots_files(customer: DataFrame) -> DataFrame:
    """Robots and guide files of one site per customer; the account balance decides which are absent."""
    body = (
        "concat('# file of ', c_name, '\\nUser-agent: *\\nDisallow: /private # hidden\\nAllow: /private/open\\n', CASE c_mktsegment "
        "WHEN 'BUILDING' THEN 'User-agent: GPTBot\\nDisallow: /\\n' "
        "WHEN 'AUTOMOBILE' THEN 'User-agent: GPTBot\\nUser-agent: ClaudeBot\\nAllow: /\\nDisallow: /\\nDisallow: /a\\n' "
        "WHEN 'MACHINERY' THEN 'User-Agent: Baiduspider\\nDisallow: /\\nCrawl-delay: 5\\n' "
        "WHEN 'HOUSEHOLD' THEN 'Disallow: /\\n' ELSE 'User-agent: PerplexityBot\\nDisallow:\\n' END, "
        "'Crawl-delay: ', c_nationkey, '\\nSitemap: https://', lower(replace(c_name, '#', '-')), '.example.com/sm.xml\\n')"
    )
    guide = (
        "concat(CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE concat('# ', c_name, '\\n') END, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE '> about us\\n' END, "
        "repeat('## part\\n', cast(c_nationkey % 5 AS int)), repeat('- [a](https://x.test/a)\\n', cast(c_nationkey % 7 AS int)))"
    )
    return spread(customer).selectExpr(
        "concat('https://', lower(replace(c_name, '#', '-')), '.example.com') AS site",
        f"CASE WHEN c_acctbal >= 0 THEN {body} END AS robots", f"CASE WHEN c_acctbal < 5000 THEN {guide} END AS guide",
    )
