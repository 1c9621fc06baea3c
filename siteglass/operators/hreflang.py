"""Language alternates: entries from pages, headers and sitemaps, and the seven checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import html as H
from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import attach_by_key, explode_rows, held_by_key
from siteglass.functions.text import each, keep, let
from siteglass.operators.site_issues import MEMBER, SEVERITY, with_site

# Patterns.
HEADER_LINK = '(?i)<([^>]+)>\\s*;\\s*rel="alternate"\\s*;\\s*hreflang="([^"]+)"'
SITEMAP_PAGE = "(?is)<url>\\s*<loc>([^<]+)</loc>(.*?)</url>"
SITEMAP_LINK = '(?i)<xhtml:link\\s+rel="alternate"\\s+hreflang="([^"]+)"\\s+href="([^"]+)"\\s*/>'
LANGUAGE_CODE = "(?i)^[a-z]{2,3}(-[A-Z]{2})?$"
CJK = "[\\u4e00-\\u9fff\\u3040-\\u309f\\u30a0-\\u30ff\\uac00-\\ud7af]"


def page_entries(pages: DataFrame) -> DataFrame:
    """Entries of link tags and of the Link header (column `link_header`, may be null)."""
    tags = keep(
        H.named(H.open_tags("html"), "link"), lambda t: f"lower({H.attribute(f'{t}.attrs', 'rel')}) = 'alternate'"
    )
    from_tags = keep(
        each(
            tags,
            lambda t: f"named_struct('lang', {H.attribute(f'{t}.attrs', 'hreflang')}, 'target', {H.attribute(f'{t}.attrs', 'href')}, 'origin', 'html')",
        ),
        lambda e: f"{X.filled(f'{e}.lang')} AND {X.filled(f'{e}.target')}",
    )
    from_header = each(
        X.extract_all("coalesce(link_header, '')", HEADER_LINK),
        lambda m: f"named_struct('lang', {X.extract(m, HEADER_LINK, 2)}, 'target', {X.extract(m, HEADER_LINK, 1)}, 'origin', 'http-header')",
    )
    rows = explode_rows(pages, f"concat(coalesce({from_tags}, array()), {from_header})", "e", "url")
    return rows.selectExpr("url AS page_url", "e.lang", "e.target", "e.origin")


def sitemap_entries(files: DataFrame) -> DataFrame:
    """Entries of sitemap files (column `body`)."""
    blocks = explode_rows(files, X.extract_all("body", SITEMAP_PAGE), "block")
    pages = blocks.selectExpr(
        f"trim({X.extract('block', SITEMAP_PAGE, 1)}) AS page_url", f"{X.extract('block', SITEMAP_PAGE, 2)} AS inner_text"
    )
    rows = explode_rows(pages, X.extract_all("inner_text", SITEMAP_LINK), "m", "page_url")
    return rows.selectExpr(
        "page_url", f"{X.extract('m', SITEMAP_LINK, 1)} AS lang", f"{X.extract('m', SITEMAP_LINK, 2)} AS target", "'sitemap' AS origin"
    )


def hreflang_entries(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """page_url, lang, target, origin from all three places."""
    own = page_entries(pages)
    return own if files is None else own.unionByName(sitemap_entries(files))


def _members(df: DataFrame, kind: str) -> DataFrame:
    rows = with_site(df.selectExpr("page_url AS url").distinct())
    return rows.selectExpr("site", f"'{kind}' AS type", f"'{SEVERITY[kind]}' AS severity", "'' AS group_key", "url")


def missing_self(entries: DataFrame) -> DataFrame:
    per_page = entries.groupBy("page_url").agg(F.expr("bool_or(target = page_url AND lang <> 'x-default')").alias("ok"))
    return _members(per_page.where("NOT ok"), "hreflang-missing-self")


def missing_reciprocal(entries: DataFrame) -> DataFrame:
    """Pages whose target declares entries of its own but none back."""
    pairs = entries.where("lang <> 'x-default'").select("page_url", "target").distinct()
    declared = entries.selectExpr("page_url AS target").distinct()
    back = entries.selectExpr("page_url AS target", "target AS page_url").distinct()
    return _members(
        held_by_key(pairs, "target", declared, F.col("page_url")).join(back, ["target", "page_url"], "left_anti"), "hreflang-missing-reciprocal"
    )


def invalid_language(entries: DataFrame) -> DataFrame:
    return _members(entries.where(f"lang <> 'x-default' AND NOT {X.matches('lang', LANGUAGE_CODE)}"), "hreflang-invalid-lang")


def broken_target(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries pointing at failing, noindex or redirecting pages."""
    bad = pages.where("http_status >= 400 OR noindex OR size(redirect_chain) > 0").selectExpr("url AS target").distinct()
    return _members(held_by_key(entries, "target", bad, F.col("page_url")), "hreflang-broken-target")


def target_health(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """The first failing reason per entry: status, noindex, redirected."""
    reason = "CASE WHEN http_status >= 400 THEN 'status' WHEN noindex THEN 'noindex' WHEN size(redirect_chain) > 0 THEN 'redirected' END"
    bad = pages.selectExpr("url AS target", f"{reason} AS reason").where("reason IS NOT NULL")
    known = entries.groupBy("target").agg(F.count("*").alias("_rows")).join(bad, "target")
    found = attach_by_key(entries, known, ["target"], "_rows", F.col("page_url")).where("reason IS NOT NULL")
    return found.select("page_url", "lang", "target", "reason")


def canonical_conflict(entries: DataFrame, pages: DataFrame) -> DataFrame:
    other = pages.where("canonical <> '' AND canonical <> url").selectExpr("url AS target").distinct()
    return _members(held_by_key(entries, "target", other, F.col("page_url")), "hreflang-canonical-conflict")


def missing_default(entries: DataFrame) -> DataFrame:
    per_page = entries.groupBy("page_url").agg(F.expr("bool_or(lang = 'x-default')").alias("ok"))
    return _members(per_page.where("NOT ok"), "hreflang-missing-x-default")


def language_mismatch(pages: DataFrame) -> DataFrame:
    """Declared Chinese with under 10 % CJK characters, or English with over 30 %."""
    ratio = f"{X.count_matches('text', CJK)} / length(text)"
    verdict = let(
        f"named_struct('lang', {U.normal_language('html_lang')}, 'r', {ratio})",
        lambda v: f"(startswith({v}.lang, 'zh') AND {v}.r < 0.1D) OR (startswith({v}.lang, 'en') AND {v}.r > 0.3D)",
    )
    suspects = pages.where("html_lang <> '' AND text <> ''").where(F.expr(verdict))
    return _members(suspects.selectExpr("url AS page_url"), "hreflang-lang-mismatch")


def hreflang_members(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Issue rows of all seven checks. Without any entry the first six are empty; without language signals so is the last."""
    frames = [
        missing_self(entries), missing_reciprocal(entries), invalid_language(entries), broken_target(entries, pages),
        canonical_conflict(entries, pages), missing_default(entries), language_mismatch(pages),
    ]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*MEMBER) for f in frames])


def multilingual_gate(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Per site: whether any entry exists, and whether any language signal exists."""
    signal = with_site(pages).groupBy("site").agg(
        F.expr("bool_or(coalesce(html_lang <> '', false) OR coalesce(text <> '', false))").alias("has_language_signal")
    )
    listed = with_site(entries.selectExpr("page_url AS url")).select("site").distinct().withColumn("is_multilingual", F.lit(True))
    return signal.join(listed, "site", "full_outer").selectExpr(
        "site", "coalesce(is_multilingual, false) AS is_multilingual", "coalesce(has_language_signal, false) AS has_language_signal"
    )
