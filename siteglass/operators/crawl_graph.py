"""Link graph of stored pages: edges, inlinks, click depth, truncation, link shortlist."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions import html as H
from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import attach_written, explode_rows, fence, held_by_key
from siteglass.functions.text import each, keep, let
from siteglass.operators.page_extract import SKIPPED_LINK
from siteglass.session import stored

# The link pattern and the schemes that are never followed.
LINK = "(?i)<a\\s[^>]*href=[\"']([^\"']+)[\"']"
NOT_FOLLOWED = "(?i)^(#|mailto:|tel:|javascript:|data:)"
FIRST_PATHS = "^/(docs|documentation|help|guide|blog|product|solution|case|about|faq)"


def link_edges(pages: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """(source, target): normalised links of a page into its own site, static files and itself left out."""
    hrefs = keep(
        each(X.extract_all("html", LINK, 1), X.trim_blank), lambda h: f"{h} <> '' AND NOT {X.matches(h, NOT_FOLLOWED)}"
    )
    absolute = let(U.pieces("url"), lambda b: each(hrefs, lambda h: U.resolve(h, b)))
    followed = keep(
        absolute,
        lambda u: f"{X.matches(u, U.ABSOLUTE)} AND {U.same_site(u, 'url', include_subdomains)} AND NOT {U.is_static_asset(u)}",
    )
    rows = explode_rows(pages, f"array_distinct({each(followed, U.crawl_url)})", "target", "url")
    # Pages that share a URL have its links once.
    return rows.selectExpr("url AS source", "target").where("source <> target").distinct()


def crawl_scope(links: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """Of (source, target) links, those a crawl would follow, with the target normalised."""
    scoped = links.where(
        F.expr(f"{U.same_site('target', 'source', include_subdomains)} AND NOT {U.is_static_asset('target')}")
    )
    return scoped.withColumn("target", F.expr(U.crawl_url("target"))).where("target <> source AND target <> ''").distinct()


def edge_closure(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges whose target is a crawled page."""
    return held_by_key(edges.select("source", "target"), "target", pages.selectExpr("url AS target"), F.col("source"))


def inlink_counts(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct linking pages per crawled page, zero included."""
    counted = edge_closure(edges.distinct(), pages).groupBy("target").agg(F.count("*").alias("inlinks"))
    return pages.select("url").distinct().join(counted.withColumnRenamed("target", "url"), "url", "left").select(
        "url", F.coalesce("inlinks", F.lit(0).cast("bigint")).alias("inlinks")
    )


def graph_nodes(edges: DataFrame, pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """url, inlinks, orphan (declared in the sitemap, linked from nowhere)."""
    listed = sitemap.select("url").distinct().withColumn("listed", F.lit(True))
    nodes = inlink_counts(edges, pages).join(listed, "url", "left")
    return nodes.selectExpr("url", "inlinks", "coalesce(listed, false) AND inlinks = 0 AS orphan")


def click_depth(edges: DataFrame, start: DataFrame, sitemap: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Breadth-first depth from the start pages, to the end or to `max_depth`; unreached sitemap pages join at the largest depth."""
    # Each step is written as a table: its shuffle files are freed before the next, and a small frontier is broadcast.
    edges = stored(edges.select("source", "target"), "links")  # read at every depth
    seen = stored(start.select("url").distinct().withColumn("depth", F.lit(0)), "depth")
    frontier = seen.select("url")
    largest = max_depth or 0
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        reached = edges.join(frontier.withColumnRenamed("url", "source"), "source", "left_semi")
        fresh = stored(reached.selectExpr("target AS url").distinct().join(seen, "url", "left_anti"), "depth")
        if fresh.isEmpty():
            break
        seen = seen.union(fresh.withColumn("depth", F.lit(depth)))
        frontier, largest = fresh, max(largest, depth)
    if sitemap is not None:
        late = sitemap.select("url").distinct().join(seen, "url", "left_anti")
        seen = seen.union(late.withColumn("depth", F.lit(largest)))
    return seen


def crawl_truncation(pages: DataFrame, max_pages: int = 100, site: str = "site") -> DataFrame:
    """Per site: pages found, kept under the limit, and how much of the expected number was observed."""
    counted = pages.groupBy(site).agg(F.count("*").alias("found"))
    return counted.selectExpr(
        site, "found", f"least(found, {max_pages}) AS kept", f"found >= {max_pages} AS truncated",
        f"CASE WHEN found >= {max_pages} THEN 'page limit reached' END AS reason",
        f"least(1D, found / {max_pages}) AS coverage",
    )


def crawl_rows(pages: DataFrame, max_pages: int = 100, site: str = "site") -> DataFrame:
    """`pages` (url, click_depth and more) with `kept`: among the first `max_pages` of the site by depth and URL, the rest is cut.

    Tasks hold back all but each site's first pages before they are ranked, and only those are looked up again.
    """
    order = Window.partitionBy(site).orderBy("click_depth", "url")
    first = pages.select(site, "url", "click_depth").distinct().withColumn("_n", F.row_number().over(order)).where(f"_n <= {max_pages}")
    return attach_written(pages, first.select(site, "url", F.lit(True).alias("_first")), [site, "url"]).withColumn(
        "kept", F.coalesce("_first", F.lit(False))
    ).drop("_first")


def site_link_shortlist(homes: DataFrame, max_links: int = 12) -> DataFrame:
    """Links of a site's home page worth listing: documentation-like paths first, the first half as core.

    Pages that share a URL give one list: a target stands at its first place on any of them, equal places by target.
    """
    hrefs = keep(each(H.anchors(H.open_tags("html")), lambda a: f"{a}.href"), lambda h: f"{h} IS NOT NULL")

    def resolved(h: str, b: str) -> str:
        return f"CASE WHEN {X.filled(h)} AND NOT {X.matches(h, SKIPPED_LINK)} THEN {U.resolve(h, b)} END"

    absolute = let(U.pieces("url"), lambda b: each(hrefs, lambda h: resolved(h, b)))
    own = let(
        U.registrable_domain("url"),
        lambda d: keep("array_distinct(places)", lambda u: f"{u} IS NOT NULL AND {U.is_url(u)} AND {U.registrable_domain(u)} = {d}"),
    )

    def path_class(u: str) -> str:
        return let(
            f"lower({U.path_of(u)})",
            lambda p: f"CASE WHEN {X.matches(p, FIRST_PATHS)} THEN 0 WHEN {p} = '/' THEN 1 ELSE 2 END",
        )

    ranked = f"array_sort(transform({own}, u -> named_struct('path_class', {path_class('u')}, 'i', array_position(places, u), 'target', u)))"
    # What is among the first of all pages of a URL is among the first of the page that has it first.
    df = fence(homes.selectExpr("url", f"{absolute} AS places")).selectExpr("url", f"slice({ranked}, 1, {max_links}) AS picked")
    found = explode_rows(df, "picked", "p", "url").groupBy("url", "p.target", "p.path_class").agg(F.min("p.i").alias("i"))
    of_url = Window.partitionBy("url")
    rows = found.withColumn("rank", F.row_number().over(of_url.orderBy("path_class", "i", "target")) - 1).where(f"rank < {max_links}")
    return rows.withColumn("half", F.ceil(F.count("*").over(of_url) / 2)).selectExpr(
        "url", "rank", "target", "path_class", "CASE WHEN rank < half THEN 'core' ELSE 'more' END AS section"
    )
