"""Site issues in long form: one row per affected page, plus one header row per issue.

Members are never gathered into a list of unbounded length. A header holds the
count, the first page and an id, built from order-free sums of digests that
every task can contribute to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions import keys as K
from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import attach_by_key, explode_rows, held_by_key
from siteglass.operators import crawl_graph as G
from siteglass.session import stored


# Thresholds.
DEEP_PAGE = 2
FEW_INLINKS = 2
LONG_CHAIN = 2
GEO_CRITICAL = 40
GEO_POOR = 60
GEO_FAIR = 80
WEAK_RATIO = 0.6
WEAK_MIN_PAGES = 3
MARKUP_MIN_WORDS = 100

# Severity per issue type where it does not depend on the case.
SEVERITY = {
    "duplicate-title": "medium", "duplicate-meta-description": "medium", "duplicate-h1": "medium",
    "missing-title": "high", "missing-meta-description": "medium", "missing-h1": "medium", "missing-canonical": "medium",
    "orphan-page": "medium", "deep-page": "low", "low-inlinks": "low", "long-redirect-chain": "low", "redirect-loop": "high",
    "broken-internal-link": "high", "missing-structured-data": "low", "weak-geo-dimension": "medium", "duplicate-content": "medium",
    "hreflang-missing-self": "high", "hreflang-missing-reciprocal": "high", "hreflang-invalid-lang": "medium",
    "hreflang-broken-target": "high", "hreflang-canonical-conflict": "medium", "hreflang-missing-x-default": "low",
    "hreflang-lang-mismatch": "low",
}

# Check names used in the ids of hreflang issues.
HREFLANG_CHECKS = {
    "hreflang-missing-self": "missing-self-reference",
    "hreflang-missing-reciprocal": "missing-reciprocal",
    "hreflang-invalid-lang": "invalid-lang-code",
    "hreflang-broken-target": "broken-target",
    "hreflang-canonical-conflict": "canonical-conflict",
    "hreflang-missing-x-default": "missing-x-default",
    "hreflang-lang-mismatch": "lang-mismatch-suspect",
}

FIELDS = {"title": "title", "meta-description": "description", "h1": "h1"}
MEMBER = ["site", "type", "severity", "group_key", "url"]


def with_site(pages: DataFrame) -> DataFrame:
    """Add `site`, the host of the page."""
    return pages.withColumn("site", F.expr(U.host_of("url")))


def indexable(pages: DataFrame) -> DataFrame:
    """Not blocked, answered with 2xx, not marked noindex."""
    return pages.where("blocked_reason IS NULL AND http_status BETWEEN 200 AND 299 AND NOT noindex")


def _members(df: DataFrame, kind: str, key: str = "''") -> DataFrame:
    return df.selectExpr("site", f"'{kind}' AS type", f"'{SEVERITY[kind]}' AS severity", f"{key} AS group_key", "url")


def duplicates(pages: DataFrame) -> DataFrame:
    """Pages sharing a trimmed title, description or first heading with another page of the site."""
    fields = ", ".join(
        f"CASE WHEN NOT {X.is_blank(col)} THEN named_struct('type', 'duplicate-{name}', 'value', {X.trim_blank(col)}) END"
        for name, col in FIELDS.items()
    )
    keyed = explode_rows(indexable(pages), f"array({fields})", "f", "site", "url").selectExpr(
        "site", "f.type AS type", "f.value AS group_key", "url"
    )
    shared = keyed.groupBy("site", "type", "group_key").agg(F.count("*").alias("_n")).where("_n > 1")
    found = attach_by_key(keyed, shared, ["site", "type", "group_key"], "_n", F.col("url")).where("_n IS NOT NULL")
    return found.withColumn("severity", F.lit("medium")).select(*MEMBER)


def missing_fields(pages: DataFrame) -> DataFrame:
    """Pages without title, description, first heading or canonical."""
    fields = ", ".join(
        f"CASE WHEN {X.is_blank(col)} THEN 'missing-{name}' END" for name, col in {**FIELDS, "canonical": "canonical"}.items()
    )
    rows = explode_rows(indexable(pages), f"array({fields})", "type", "site", "url")
    return rows.selectExpr(
        "site", "type", "CASE WHEN type = 'missing-title' THEN 'high' ELSE 'medium' END AS severity", "'' AS group_key", "url"
    )


def canonical_anomalies(pages: DataFrame) -> DataFrame:
    """Canonicals that are invalid, leave the host, or point at failing or redirecting pages; adds `reason`."""
    declared = indexable(pages).where(f"NOT {X.is_blank('canonical')}").select(
        "site", "url", F.expr(U.absolute_url("canonical", "url")).alias("target")
    ).withColumns({"target_host": F.expr(U.host_of("target")), "own_host": F.expr(U.host_of("url"))})
    local = declared.where("target_host = '' OR target_host <> own_host").selectExpr(
        "site", "url", "CASE WHEN target_host = '' THEN 'invalid-url' ELSE 'other-domain' END AS reason"
    )
    targets = pages.where("http_status >= 400 OR (size(redirect_chain) > 0 AND final_url <> url)").selectExpr(
        "url AS target", "CASE WHEN http_status >= 400 THEN 'target-error' ELSE 'target-redirects' END AS reason"
    )
    looked_up = declared.where("target_host = own_host").join(targets, "target").select("site", "url", "reason")
    return local.union(looked_up).selectExpr(
        "site", "'canonical-anomaly' AS type",
        "CASE WHEN reason IN ('other-domain', 'target-error') THEN 'high' ELSE 'medium' END AS severity",
        "url AS group_key", "url", "reason",
    )


def orphan_pages(nodes: DataFrame) -> DataFrame:
    return _members(with_site(nodes.where("orphan")), "orphan-page")


def deep_pages(pages: DataFrame) -> DataFrame:
    return _members(indexable(pages).where(f"click_depth > {DEEP_PAGE}"), "deep-page")


def low_inlinks(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    joined = indexable(pages).select("site", "url").join(nodes, "url", "left")
    few = joined.where(f"coalesce(inlinks, 0) < {FEW_INLINKS} AND NOT coalesce(orphan, false)")
    return _members(few, "low-inlinks")


def long_redirect_chains(pages: DataFrame) -> DataFrame:
    return _members(pages.where(f"size(redirect_chain) > {LONG_CHAIN}"), "long-redirect-chain", "url")


def redirect_loops(pages: DataFrame) -> DataFrame:
    chain = "concat(array(url), redirect_chain)"
    return _members(pages.where(f"size(array_distinct({chain})) < size({chain})"), "redirect-loop", "url")


def broken_internal_links(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Reachable pages linking to a crawled page that answers 4xx or 5xx; grouped by the broken target."""
    sources = pages.where("blocked_reason IS NULL AND http_status BETWEEN 200 AND 299").selectExpr("site", "url AS source")
    broken = pages.where("http_status >= 400").selectExpr("url AS target").distinct()
    hits = held_by_key(edges.select("source", "target"), "target", broken, F.col("source")).join(sources, "source")
    return _members(hits.selectExpr("site", "target", "source AS url").distinct(), "broken-internal-link", "target")


def missing_structured_data(pages: DataFrame) -> DataFrame:
    bare = indexable(pages).where(f"word_count >= {MARKUP_MIN_WORDS} AND size(jsonld_types) = 0")
    return _members(bare, "missing-structured-data")


def low_geo_scores(pages: DataFrame) -> DataFrame:
    """Pages under 40 (high) and under 60 (medium)."""
    return indexable(pages).where(f"geo_score < {GEO_POOR}").selectExpr(
        "site", "'low-geo-score' AS type", f"CASE WHEN geo_score < {GEO_CRITICAL} THEN 'high' ELSE 'medium' END AS severity",
        f"CASE WHEN geo_score < {GEO_CRITICAL} THEN 'critical' ELSE 'poor' END AS group_key", "url",
    )


def _weak(pages: DataFrame) -> DataFrame:
    weak = f"filter(breakdown, d -> d.max > 0 AND d.score / d.max < {WEAK_RATIO}D)"
    return explode_rows(indexable(pages), weak, "d", "site", "url").selectExpr("site", "url", "d.id AS dimension")


def common_weak_dimensions(pages: DataFrame) -> DataFrame:
    """Pages per weak dimension and site."""
    return _weak(pages).groupBy("site", "dimension").agg(F.count("*").alias("pages"))


def weak_dimensions(pages: DataFrame) -> DataFrame:
    weak = _weak(pages)
    common = weak.groupBy("site", "dimension").agg(F.count("*").alias("pages")).where(f"pages >= {WEAK_MIN_PAGES}")
    found = attach_by_key(weak, common, ["site", "dimension"], "pages", F.col("url")).where("pages IS NOT NULL")
    return _members(found, "weak-geo-dimension", "dimension")


def duplicate_content(groups: DataFrame) -> DataFrame:
    """Members of near-duplicate groups (group_id, id as URL) as issue rows."""
    return _members(with_site(groups.selectExpr("id AS url", "group_id")), "duplicate-content", "group_id")


def geo_distribution(pages: DataFrame) -> DataFrame:
    """Per site: pages under 40, 40-59, 60-79 and from 80."""
    return indexable(pages).groupBy("site").agg(
        F.expr(f"count_if(geo_score < {GEO_CRITICAL})").alias("critical"),
        F.expr(f"count_if(geo_score >= {GEO_CRITICAL} AND geo_score < {GEO_POOR})").alias("poor"),
        F.expr(f"count_if(geo_score >= {GEO_POOR} AND geo_score < {GEO_FAIR})").alias("fair"),
        F.expr(f"count_if(geo_score >= {GEO_FAIR})").alias("good"),
    )


def lowest_scoring(pages: DataFrame, k: int = 10) -> DataFrame:
    """The k lowest pages of each site."""
    order = Window.partitionBy("site").orderBy("geo_score", "url")
    ranked = indexable(pages).select("site", "url", "geo_score").withColumn("_n", F.row_number().over(order))
    return ranked.where(f"_n <= {k}").select("url", "geo_score")


def schema_coverage(pages: DataFrame) -> DataFrame:
    """Pages per structured-data type and their share of the site's indexable pages."""
    base = indexable(pages)
    totals = base.groupBy("site").agg(F.count("*").alias("_total"))
    typed = explode_rows(base, "array_distinct(jsonld_types)", "schema_type", "site")
    counted = typed.groupBy("site", "schema_type").agg(F.count("*").alias("pages"))
    return counted.join(totals, "site").selectExpr("site", "schema_type", "pages", "pages / _total AS ratio")


def issue_members(frames: list[DataFrame]) -> DataFrame:
    """Union of the member rows of several generators."""
    return reduce(lambda a, b: a.unionByName(b), [f.select(*MEMBER) for f in frames])


def page_members(pages: DataFrame) -> DataFrame:
    """Members of all issues that a page has by itself, in one pass over the pages."""
    shown = "(blocked_reason IS NULL AND http_status BETWEEN 200 AND 299 AND NOT noindex)"
    chain = "concat(array(url), redirect_chain)"
    missing = {f"missing-{name}": X.is_blank(col) for name, col in {**FIELDS, "canonical": "canonical"}.items()}
    rules = [(f"{shown} AND {blank}", kind, "''") for kind, blank in missing.items()]
    rules += [
        (f"{shown} AND click_depth > {DEEP_PAGE}", "deep-page", "''"),
        (f"size(redirect_chain) > {LONG_CHAIN}", "long-redirect-chain", "url"),
        (f"size(array_distinct({chain})) < size({chain})", "redirect-loop", "url"),
        (f"{shown} AND word_count >= {MARKUP_MIN_WORDS} AND size(jsonld_types) = 0", "missing-structured-data", "''"),
    ]
    entry = lambda kind, severity, key: f"named_struct('type', '{kind}', 'severity', '{severity}', 'group_key', {key})"
    found = [f"CASE WHEN {condition} THEN {entry(kind, SEVERITY[kind], key)} END" for condition, kind, key in rules]
    found.append(
        f"CASE WHEN {shown} AND geo_score < {GEO_CRITICAL} THEN {entry('low-geo-score', 'high', '\'critical\'')} "
        f"WHEN {shown} AND geo_score < {GEO_POOR} THEN {entry('low-geo-score', 'medium', '\'poor\'')} END"
    )
    rows = explode_rows(pages, f"array({', '.join(found)})", "m", "site", "url")
    return rows.select("site", "m.type", "m.severity", "m.group_key", "url")


def all_members(pages: DataFrame, edges: DataFrame, sitemap: DataFrame, duplicate_of: DataFrame | None = None) -> DataFrame:
    """Members of every site issue; hreflang members can be added with `issue_members`. The link graph is made once."""
    # Written as tables, so that the shuffle files of the links are freed before the next step and do not add up.
    nodes = stored(G.graph_nodes(edges, pages, sitemap), "nodes")
    broken = stored(broken_internal_links(pages, edges), "broken")
    frames = [
        page_members(pages), stored(duplicates(pages), "duplicates"), stored(canonical_anomalies(pages), "canonicals"), orphan_pages(nodes),
        low_inlinks(pages, nodes), broken, weak_dimensions(pages),
    ]
    if duplicate_of is not None:
        frames.append(duplicate_content(duplicate_of))
    return issue_members(frames)


def site_issues(members: DataFrame) -> DataFrame:
    """One header per issue: id, site, type, severity, group_key, affected, first_url.

    The id is a digest of the number of pages and of two sums over their URLs' digests, so it depends on no order,
    gathers no list and is formed alike for issues of any size.
    """
    issue = ["site", "type", "severity", "group_key"]
    part = lambda at: f"sum(cast(conv(substring(sha1(url), {at}, 8), 16, 10) AS bigint))"
    headers = members.distinct().groupBy(*issue).agg(
        F.count("*").alias("affected"), F.min("url").alias("first_url"), F.expr(part(1)).alias("_s1"), F.expr(part(9)).alias("_s2")
    )
    payload = "concat_ws('/', affected, _s1, _s2)"
    checks = ", ".join(f"'{k}', '{v}'" for k, v in HREFLANG_CHECKS.items())
    hreflang = f"concat('hreflang:', element_at(map({checks}), type), ':', substring(sha1({payload}), 1, 8))"
    issue_id = f"CASE WHEN type LIKE 'hreflang-%' THEN {hreflang} ELSE {K.short_id('type', payload)} END"
    return headers.selectExpr(f"{issue_id} AS issue_id", *issue, "affected", "first_url")


def ordered(issues: DataFrame) -> DataFrame:
    """Severity first, then affected pages, then type."""
    rank = F.expr("CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END")
    return issues.orderBy(rank, F.desc("affected"), "type", "issue_id")


def crawl_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages added, removed or changed in status or title between two snapshots."""
    a = before.selectExpr("url", "http_status AS prev_status", "title AS prev_title", "true AS _in_a")
    b = after.selectExpr("url", "http_status AS cur_status", "title AS cur_title", "true AS _in_b")
    change = (
        "CASE WHEN _in_a IS NULL THEN 'added' WHEN _in_b IS NULL THEN 'removed' "
        "WHEN prev_status <> cur_status OR NOT (prev_title <=> cur_title) THEN 'changed' ELSE 'unchanged' END"
    )
    return a.join(b, "url", "full_outer").selectExpr(
        "url", f"{change} AS change", "prev_status", "cur_status", "prev_title", "cur_title"
    )
