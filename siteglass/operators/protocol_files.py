"""Protocol files of a site: robots rules and delays, sitemaps, guide files (llms.txt).

A file is one row and bounded in size, so its rules become an array on that row;
admission checks are then row-local after one join on the site.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import attach_written, explode_rows
from siteglass.functions.text import Sql, each, keep, let
from siteglass.session import cut_lineage

# Known crawlers as (agent, purpose, regional).
CRAWLERS = [
    ("GPTBot", "training", False),
    ("OAI-SearchBot", "retrieval", False),
    ("ChatGPT-User", "user", False),
    ("ClaudeBot", "training", False),
    ("anthropic-ai", "training", False),
    ("Claude-User", "user", False),
    ("PerplexityBot", "retrieval", False),
    ("Google-Extended", "training", False),
    ("Applebot-Extended", "training", False),
    ("CCBot", "training", False),
    ("Bytespider", "training", True),
    ("Baiduspider", "index", True),
    ("BaiduSpider-render", "index", True),
    ("Sogou web spider", "index", True),
    ("360Spider", "index", True),
    ("Timpibot", "index", False),
    ("Diffbot", "training", False),
    ("YouBot", "retrieval", False),
    ("meta-externalagent", "training", False),
    ("cohere-ai", "training", False),
]

LOCATION = "(?is)<(?:[\\w.-]+:)?loc>(.*?)</(?:[\\w.-]+:)?loc>"
INDEX_ROOT = "(?i)<[^>]*sitemapindex[\\s>]"
CDATA = "(?is)^<!\\[CDATA\\[(.*?)\\]\\]>$"


def _lines(files: DataFrame) -> DataFrame:
    """site, line_no, key, value of the `key: value` lines of robots files; comments removed."""
    rows = explode_rows(files, "split(body, '\\\\r?\\\\n', -1)", "line", "site", position="line_no")
    bare = rows.withColumn("line", F.expr(X.trim_blank(X.replaced("line", "#.*$", "")))).where("contains(line, ':')")
    value = X.trim_blank(X.replaced("line", "^[^:]*:", ""))
    return bare.selectExpr("site", "line_no", "lower(trim(substring_index(line, ':', 1))) AS key", f"{value} AS value")


def _grouped(lines: DataFrame) -> DataFrame:
    """Number the groups: an agent line opens one unless the line before it is an agent line too."""
    order = Window.partitionBy("site").orderBy("line_no")
    before = F.lag("key").over(order)
    opens = F.when(before.isNull() | ((F.col("key") == "user-agent") & (before != "user-agent")), 1).otherwise(0)
    return lines.withColumn("_opens", opens).withColumn("group_no", F.sum("_opens").over(order)).drop("_opens")


def robots_groups(files: DataFrame) -> DataFrame:
    """site, group_no, agents, rules (in file order)."""
    lines = _grouped(_lines(files).where("key IN ('user-agent', 'allow', 'disallow')"))
    agent = "CASE WHEN key = 'user-agent' THEN lower(value) END"
    rule = "CASE WHEN key <> 'user-agent' THEN named_struct('line_no', line_no, 'path', value, 'allow', key = 'allow') END"
    return lines.groupBy("site", "group_no").agg(
        F.collect_list(F.expr(agent)).alias("agents"), F.array_sort(F.collect_list(F.expr(rule))).alias("rules")
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """Long form: site, group_no, agent, path, allow."""
    rows = explode_rows(robots_groups(files), "rules", "r", "site", "group_no", "agents")
    agents = explode_rows(rows, "agents", "agent", "site", "group_no", "r")
    return agents.selectExpr("site", "group_no", "agent", "r.path", "r.allow")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """Sitemap URLs declared in robots files."""
    return _lines(files).where("key = 'sitemap'").selectExpr("site", "value AS url")


def site_robots(files: DataFrame) -> DataFrame:
    """One row per site: its groups as an array."""
    groups = robots_groups(files).groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("group_no", "agents", "rules"))).alias("groups")
    )
    return files.select("site").join(groups, "site", "left")


def _pool(groups: Sql, agent: Sql) -> Sql:
    """Groups that apply to an agent: named ones before `*`; names match by substring either way."""

    def split_out(g: Sql) -> Sql:
        exact = keep(g, lambda x: f"NOT array_contains({x}.agents, '*')")
        return let(exact, lambda e: f"CASE WHEN size({e}) > 0 THEN {e} ELSE {g} END")

    hits = keep(
        groups,
        lambda g: f"exists({g}.agents, a -> a = '*' OR contains(lower({agent}), a) OR contains(a, lower({agent})))",
    )
    return let(hits, split_out)


def _best_rule(pool: Sql, path: Sql) -> Sql:
    """struct<n, allow, path> of the longest matching rule; allow wins a tie; empty paths never match."""
    matching = keep(
        f"flatten({each(pool, lambda g: f'{g}.rules')})",
        lambda r: f"{r}.path <> '' AND ({r}.path = '/' OR startswith({path}, {r}.path))",
    )
    return f"array_max({each(matching, lambda r: f'named_struct(\'n\', length({r}.path), \'allow\', {r}.allow, \'path\', {r}.path)')})"


def robots_admission(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Whether each (site, path) may be fetched by `agent`, and the rule that decides.

    The longest rule that begins a path is found by equality: a path is cut at each rule length of its site, and the pieces are
    looked up among the site's rules. The work grows with paths and rule lengths, not with paths times rules.
    """
    pools = robots.select("site", F.expr(f"flatten({each(_pool('coalesce(groups, array())', X.lit(agent)), lambda g: f'{g}.rules')})").alias("rules"))
    rules = explode_rows(pools, "rules", "r", "site").where("r.path <> ''").groupBy("site", F.col("r.path").alias("piece")).agg(F.max("r.allow").alias("allow"))
    rules = cut_lineage(rules)
    lengths = rules.groupBy("site").agg(F.collect_set(F.length("piece")).alias("_lengths"))

    rooted = urls.withColumn("_path", F.expr("coalesce(nullif(path, ''), '/')"))
    paths = attach_written(rooted.select("site", "_path").distinct(), lengths, ["site"], "inner")
    cut = "transform(filter(_lengths, n -> n <= length(_path)), n -> substring(_path, 1, n))"
    # The rule "/" also holds for paths that begin otherwise.
    pieces = paths.select("site", "_path", F.explode(F.expr(f"array_union({cut}, array('/'))")).alias("piece"))
    found = pieces.join(rules, ["site", "piece"])  # rules are written, so a hot piece is split
    best = found.groupBy("site", "_path").agg(F.max(F.struct(F.length("piece").alias("n"), "allow", "piece")).alias("_best"))

    df = attach_written(rooted, best, ["site", "_path"]).select(*urls.columns, "_best")
    rule = "CASE WHEN _best IS NOT NULL THEN concat(CASE WHEN _best.allow THEN 'Allow: ' ELSE 'Disallow: ' END, _best.piece) END"
    return df.withColumns({"allowed": F.expr("coalesce(_best.allow, true)"), "rule": F.expr(rule)}).drop("_best")


def crawl_delay(files: DataFrame, agent: str) -> DataFrame:
    """First delay of the groups applying to `agent`; a group ends once it has a delay."""
    delay = "CASE WHEN value = '' THEN 0D ELSE try_cast(value AS double) END"
    lines = _lines(files).where("key IN ('user-agent', 'crawl-delay')").withColumn("_delay", F.expr(delay))
    lines = _grouped(lines.where("key = 'user-agent' OR _delay >= 0"))
    groups = lines.groupBy("site", "group_no").agg(
        F.collect_list(F.expr("CASE WHEN key = 'user-agent' THEN lower(value) END")).alias("agents"),
        F.max_by(F.expr("CASE WHEN key = 'crawl-delay' THEN _delay END"), F.expr("CASE WHEN key = 'crawl-delay' THEN line_no END")).alias("delay"),
    )
    sites = groups.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("group_no", "agents", "delay"))).alias("groups"))
    with_delay = keep(_pool("groups", X.lit(agent)), lambda g: f"{g}.delay IS NOT NULL")
    found = sites.select("site", F.expr(f"try_element_at({with_delay}, 1).delay").alias("delay"))
    return found.where("delay IS NOT NULL")


def crawler_policies(robots: DataFrame) -> DataFrame:
    """site, agent, purpose, regional, policy (allowed, blocked, unspecified) at the site root."""
    listed = ", ".join(
        f"named_struct('agent', {X.lit(a)}, 'purpose', '{p}', 'regional', {str(r).lower()})" for a, p, r in CRAWLERS
    )
    rows = robots.where("groups IS NOT NULL").select("site", "groups", F.explode(F.expr(f"array({listed})")).alias("c"))
    rooted = f"{_best_rule('pool', X.lit('/'))}"
    df = rows.selectExpr("site", "c.*", f"{_pool('groups', 'c.agent')} AS pool")
    policy = f"CASE WHEN size(pool) = 0 THEN 'unspecified' WHEN coalesce({rooted}.allow, true) THEN 'allowed' ELSE 'blocked' END"
    return df.selectExpr("site", "agent", "purpose", "regional", f"{policy} AS policy")


def ai_openness(policies: DataFrame) -> DataFrame:
    """Per site: share of non-index crawlers allowed (0-100), blocked ones, unspecified ones of all."""
    ai = "purpose <> 'index'"
    return policies.groupBy("site").agg(
        F.expr(X.half_up(f"count_if({ai} AND policy = 'allowed') / count_if({ai}) * 100")).alias("openness"),
        F.expr(f"count_if({ai} AND policy = 'blocked')").alias("blocked"),
        F.expr("count_if(policy = 'unspecified')").alias("unspecified"),
    )


def regional_blocked(policies: DataFrame) -> DataFrame:
    """Blocked regional crawlers per site (at most the known ones)."""
    return policies.where("regional AND policy = 'blocked'").groupBy("site").agg(
        F.array_sort(F.collect_list("agent")).alias("agents")
    )


def _locations(body: Sql) -> Sql:
    clean = each(X.extract_all(body, LOCATION, 1), lambda m: X.trim_blank(X.replaced(X.trim_blank(m), CDATA, "$1")))
    return keep(clean, lambda u: f"{u} <> ''")


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(file, kind, url): locations of sitemap files; `index` when the root is an index, else `urlset`."""
    kind = f"CASE WHEN {X.matches('body', INDEX_ROOT)} THEN 'index' ELSE 'urlset' END"
    rows = explode_rows(files.withColumn("kind", F.expr(kind)), _locations("body"), "location", "url", "kind")
    return rows.selectExpr("url AS file", "kind", "location AS url")


def sitemap_closure(sites: DataFrame, declared: DataFrame, files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(site, url): distinct page URLs reachable from a site's sitemaps, following indexes to the end or to `max_depth`."""
    default = sites.join(declared.select("site").distinct(), "site", "left_anti").selectExpr(
        "site", f"concat({X.replaced('site', '/$', '')}, '/sitemap.xml') AS url"
    )
    frontier = cut_lineage(declared.select("site", "url").union(default).distinct())
    listed = cut_lineage(sitemap_urls(files))  # read at every depth
    visited, leaves = frontier, None
    for depth in count():
        found = frontier.withColumnRenamed("url", "file").join(listed, "file")
        pages = found.where("kind = 'urlset'").select("site", "url")
        leaves = pages if leaves is None else leaves.union(pages)
        if depth == max_depth:
            break
        frontier = cut_lineage(
            found.where("kind = 'index'").select("site", "url").distinct().join(visited, ["site", "url"], "left_anti")
        )
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return leaves.distinct().join(visited, ["site", "url"], "left_anti")


def guide_score(files: DataFrame) -> DataFrame:
    """Structure of guide files (site, body; null body = absent): title, summary, sections, links, size, score, failed items."""
    newline = "(?m)"
    df = files.selectExpr(
        "site", "body IS NOT NULL AS guide_exists",
        f"nullif(trim({X.extract('body', newline + '^#[ \\t]+(.+)$')}), '') AS title",
        f"coalesce({X.matches('body', newline + '^>\\s*\\S')}, false) AS has_summary",
        f"coalesce({X.count_matches('body', newline + '^##\\s+')}, 0) AS sections",
        f"coalesce({X.count_matches('body', newline + '^-\\s*\\[.+\\]\\(.+\\)')}, 0) AS links",
        "coalesce(octet_length(body), 0) AS bytes",
    )
    items = (
        "array(CASE WHEN title IS NOT NULL THEN 2 ELSE 0 END, CASE WHEN has_summary THEN 2 ELSE 1 END, "
        "CASE WHEN sections >= 2 THEN 2 WHEN sections = 1 THEN 1 ELSE 0 END, "
        "CASE WHEN links >= 5 THEN 2 WHEN links > 0 THEN 1 ELSE 0 END, CASE WHEN bytes < 100000 THEN 2 ELSE 1 END)"
    )
    df = df.withColumn("_items", F.expr(f"CASE WHEN guide_exists THEN {items} ELSE array(0) END"))
    return df.selectExpr(
        "site", "guide_exists", "title", "has_summary", "sections", "links", "bytes",
        f"CASE WHEN guide_exists THEN {X.half_up('aggregate(_items, 0, (a, i) -> a + i) / (size(_items) * 2) * 100')} ELSE 0 END AS score",
        "size(filter(_items, i -> i = 0)) AS failed_items",
    )


def protocol_table(robots: DataFrame, policies: DataFrame, guides: DataFrame) -> DataFrame:
    """One row per site joining robots and guide results: input of findings and comparison."""
    blocked = policies.where("policy = 'blocked'").groupBy("site").agg(F.array_sort(F.collect_list("agent")).alias("blocked"))
    return (
        robots.selectExpr("site", "groups IS NOT NULL AS robots_exists")
        .join(ai_openness(policies).select("site", "openness"), "site", "left")
        .join(blocked, "site", "left")
        .join(guides.selectExpr("site", "guide_exists", "score AS guide_score", "failed_items AS guide_fails"), "site", "left")
        .selectExpr(
            "site", "robots_exists", "coalesce(openness, 0) AS openness", "coalesce(blocked, array()) AS blocked",
            "coalesce(guide_exists, false) AS guide_exists", "coalesce(guide_score, 0) AS guide_score",
            "coalesce(guide_fails, 0) AS guide_fails",
        )
    )
