"""Page facts from raw HTML: one row-local projection chain, no shuffle.

`with_page_facts` is the wide form; operators select from it, and column
pruning removes whatever a caller does not read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import html as H
from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import explode_rows, fence
from siteglass.functions.text import Sql, each, keep, let, some
from siteglass.operators import jsonld

# Patterns that define the content measures.
DATA_POINT = f"\\d+(\\.\\d+)?[{X.BLANK}]*(%|％|亿元|万元|亿美元|万|亿|kg|ms|px)"
DATA_YEAR = f"20\\d{{2}}[{X.BLANK}]*年"
SENTENCE_END = "[。！？.!?]"
SUMMARY_MARK = "(?i)(总结|核心结论|要点|综上|一句话|tldr|key takeaway| TL;?DR)"
ANSWER_MARK = "(?i)(定义|简言之|简单来说|核心是|答案是|什么是|指的是|：|:|is\\s+a|refers\\s+to|means)"
QUESTION_HEADING = "(?i)[?？]$|^(什么是|如何|怎么|为什么|怎样|是不是|能否)"
AUTHOR_PAGE = "(?i)author|about|profile|bio|people"
AUTHORITY_HOST = "(?i)(?:^|\\.)(gov|edu|mil|gouv|gob|go\\.id|ac\\.uk)\\.?[a-z]*$|\\.(gov|edu|mil)$"
SKIPPED_LINK = "(?i)^(#|mailto:|tel:|javascript:)"

YEAR_SECONDS = 365 * 24 * 3600


def _meta(*keys: str) -> Sql:
    return "coalesce(" + ", ".join(f"nullif(try_element_at(meta, {X.lit(k)}), '')" for k in keys) + ", NULL)"


def headings_of(html: Sql) -> Sql:
    """array<struct<level, position, text>> ordered by level, then position; blank headings dropped."""
    found = (
        f"transform({H.elements(html, 'h[1-6]')}, (e, i) -> named_struct('level', cast(substring(e.name, 2, 1) AS int), "
        f"'position', i, 'text', {X.strip_tags('e.content')}))"
    )
    return f"array_sort({keep(found, lambda h: f'{h}.text <> \'\'')})"


def link_targets(anchors: Sql, base: Sql) -> Sql:
    """Distinct absolute targets of the followable anchors, in page order."""
    followed = keep(
        each(anchors, lambda a: f"{a}.href"), lambda h: f"{X.filled(h)} AND NOT {X.matches(h, SKIPPED_LINK)}"
    )
    return let(U.pieces(base), lambda b: f"array_distinct({each(followed, lambda h: U.resolve(h, b))})")


def is_internal(target: Sql, host: Sql) -> Sql:
    """On the given host, or not parseable as a URL at all."""
    return f"({U.host_of(target)} = {host} OR NOT {X.matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:')})"


def _add(df: DataFrame, columns: dict[str, Sql]) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def with_page_facts(pages: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Facts, content measures and structured-data signals of every page, row by row."""
    df = _add(pages, {"tags": H.open_tags("html"), "blocks": H.jsonld_blocks("html")})
    df = jsonld.with_signals(df)
    alternates = keep(H.named("tags", "link"), lambda t: f"lower({H.attribute(f'{t}.attrs', 'rel')}) = 'alternate'")
    df = _add(
        df,
        {
            "metas": H.meta_entries("tags"),
            "anchors": H.anchors("tags"),
            "headings": headings_of("html"),
            "text": H.body_text("html"),
            "title": H.title_of("html"),
            "canonical": H.first_link("tags", "canonical"),
            "lang": H.attribute(f"try_element_at({H.named('tags', 'html')}, 1).attrs", "lang"),
            "hreflang": keep(each(alternates, lambda t: H.attribute(f"{t}.attrs", "hreflang")), X.filled),
            "image_alts": each(H.named("tags", "img"), lambda t: H.attribute(f"{t}.attrs", "alt")),
        },
    )
    df = _add(
        df,
        {
            "meta": H.meta_map("metas"),
            "description": H.first_meta("metas", "description"),
            "robots": H.first_meta("metas", "robots"),
            "viewport": H.first_meta("metas", "viewport"),
            "targets": link_targets("anchors", "url"),
            "word_count": X.word_count("text"),
            "image_count": "size(image_alts)",
            "images_without_alt": f"size({keep('image_alts', X.is_blank)})",
            "data_points": f"{X.count_matches('text', DATA_POINT)} + {X.count_matches('text', DATA_YEAR)}",
            "cited": keep(
                "anchors",
                lambda a: f"coalesce(contains({a}.rel, 'nofollow'), false) OR coalesce({X.matches(f'{a}.href', U.ABSOLUTE)}, false)",
            ),
            "paragraphs": H.count_named("tags", "p"),
            "lists": H.count_named("tags", "ul", "ol"),
            "list_items": H.count_named("tags", "li"),
            "tables": H.count_named("tags", "table"),
            "quotes": H.count_named("tags", "blockquote"),
            "code_blocks": H.count_named("tags", "pre", "code"),
            "has_landmarks": f"{H.count_named('tags', 'main', 'article')} > 0",
            # Headings are gathered by level, so a jump is a level missing between the smallest and the largest.
            "heading_continuity": let(
                each("headings", lambda h: f"{h}.level"),
                lambda l: f"size(array_distinct({l})) = coalesce(array_max({l}) - array_min({l}) + 1, 0)",
            ),
            "head_text": "substring(text, 1, 400)",
        },
    )
    pieces = keep(f"split(text, {X.lit(SENTENCE_END + '+')}, -1)", lambda s: f"NOT {X.is_blank(s)}")
    letters = f"length({X.replaced('text', SENTENCE_END, '')})"
    questions = f"size({keep('headings', lambda h: X.matches(f'{h}.text', QUESTION_HEADING))})"
    df = _add(
        df,
        {
            "noindex": f"coalesce({X.matches('robots', '(?i)noindex')}, false)",
            "published_raw": _meta("article:published_time", "pubdate", "date"),
            "modified_raw": _meta("article:modified_time", "og:updated_time"),
            "author": _meta("author", "article:author", "og:article:author"),
            "og": H.sub_map("meta", "og:"),
            "twitter": H.sub_map("meta", "twitter:"),
            "internal_links": let(U.host_of("url"), lambda h: f"size({keep('targets', lambda t: is_internal(t, h))})"),
            "sentence_length": let(
                f"size({pieces})", lambda n: f"CASE WHEN {n} > 0 THEN {X.half_up(f'{letters} / {n}')} ELSE 0 END"
            ),
            "has_summary": f"{X.matches('head_text', SUMMARY_MARK)} OR (data_points > 0 AND length(head_text) > 80)",
            "has_faq": let(questions, lambda q: f"ld.has_faq_page OR ({q} >= 2 AND paragraphs >= {q})"),
            "structured_density": "(list_items + tables * 3) / greatest(paragraphs, 1)",
            "has_author_authority": f"ld.has_author_same_as OR ({_meta('author', 'article:author')} IS NOT NULL AND "
            f"{some('cited', lambda a: f'coalesce({X.matches(f"{a}.href", AUTHOR_PAGE)}, false)')})",
            "has_authoritative_source": some(
                "cited",
                lambda a: X.matches(
                    f"lower({X.extract(f'coalesce({a}.href, \'\')', '(?i)^https?://([^/]+)')})", AUTHORITY_HOST
                ),
            ),
            "external_citations": "size(cited)",
        },
    )
    as_of_sql = f"TIMESTAMP '{as_of:%Y-%m-%d %H:%M:%S}'"
    df = _add(
        df,
        {
            "has_direct_answer": f"has_summary OR {X.matches('head_text', ANSWER_MARK)}",
            "external_links": "size(targets) - internal_links",
            "_published": X.timestamp_of("published_raw"),
            "_modified": X.timestamp_of("modified_raw"),
        },
    )
    recent = (
        f"unix_timestamp({as_of_sql}) - unix_timestamp(_modified) <= {YEAR_SECONDS} AND _modified <= {as_of_sql}"
    )
    df = _add(
        df,
        {
            "has_date_consistency": f"CASE WHEN _published IS NOT NULL AND _modified IS NOT NULL "
            f"THEN _modified >= _published AND {recent} ELSE coalesce(ld.has_date_modified AND {recent}, false) END"
        },
    )
    return fence(df.drop("_published", "_modified"))


def page_facts(facts: DataFrame) -> DataFrame:
    """Head facts of a page; maps hold the Open Graph and card tags without their prefix."""
    return facts.selectExpr(
        "url", "title", "description", "canonical", "robots AS robots_meta", "lang",
        "coalesce(viewport <> '', false) AS has_viewport", "og", "twitter", "hreflang",
    )


def page_headings(facts: DataFrame) -> DataFrame:
    rows = explode_rows(facts, "headings", "h", "url", position="ordinal")
    return rows.selectExpr("url", "ordinal", "h.level", "h.text")


def page_links(facts: DataFrame) -> DataFrame:
    """One row per URL and distinct link target; pages that share a URL have its links once."""
    rows = explode_rows(facts, "targets", "target", "url").distinct()
    return rows.withColumn("internal", F.expr(is_internal("target", U.host_of("url"))))


def body_text(facts: DataFrame) -> DataFrame:
    return facts.select("url", "text", "word_count")


def image_alt(facts: DataFrame) -> DataFrame:
    return facts.select("url", "image_count", "images_without_alt")


CONTENT_SHAPE = [
    "paragraphs", "lists", "list_items", "tables", "quotes", "code_blocks", "data_points", "external_citations",
    "has_summary", "sentence_length", "has_direct_answer", "has_landmarks", "heading_continuity", "has_faq",
    "structured_density", "has_author_authority", "has_authoritative_source", "has_date_consistency",
]


def content_shape(facts: DataFrame) -> DataFrame:
    """The eighteen content measures of each page."""
    return facts.select("url", *CONTENT_SHAPE)
