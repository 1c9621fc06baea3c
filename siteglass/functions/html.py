"""SQL fragments for HTML tags.

One pass over the page yields every opening tag in order; all counts and
attribute reads work on that array, so a page is scanned once however many
facts are taken from it.
"""

from __future__ import annotations

from siteglass.functions import text as X
from siteglass.functions.text import Sql, each, keep, let

# Attribute text of a tag: quoted values may hold ">". Possessive, so long tags cannot overflow the matcher.
ATTRIBUTES = "((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)"
TAG = "<([a-zA-Z][a-zA-Z0-9:-]*)" + ATTRIBUTES + ">"
_NAME = "[a-zA-Z_:][a-zA-Z0-9_:.-]*"
_ATTRIBUTE = f"{_NAME}(?:\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s\"'>]+))?"


def open_tags(html: Sql) -> Sql:
    """array<struct<name, attrs>> of every opening tag, in page order."""
    return each(
        X.extract_all(html, TAG),
        lambda t: f"named_struct('name', lower({X.extract(t, '^<([a-zA-Z][a-zA-Z0-9:-]*)')}), "
        f"'attrs', {X.extract(t, '(?s)^<[a-zA-Z][a-zA-Z0-9:-]*(.*)>$')})",
    )


def named(tags: Sql, *names: str) -> Sql:
    return keep(tags, lambda t: f"{t}.name IN ({X.lits(names)})")


def count_named(tags: Sql, *names: str) -> Sql:
    return f"size({named(tags, *names)})"


def attribute(attrs: Sql, key: str) -> Sql:
    """Value of one attribute: null when absent, '' when it has no value, last one wins."""
    hits = keep(X.extract_all(attrs, _ATTRIBUTE), lambda m: X.matches(m, f"(?i)^{key}(?![a-zA-Z0-9_:.-])"))

    def unquoted(raw: Sql) -> Sql:
        return f"CASE WHEN left({raw}, 1) IN ('\"', '\\'') THEN substring({raw}, 2, length({raw}) - 2) ELSE {raw} END"

    raw = X.replaced(f"try_element_at({hits}, -1)", f"(?s)^{_NAME}\\s*=?\\s*", "")
    return X.decode_entities(let(raw, unquoted))


def element_pattern(names: str) -> str:
    """Pattern of an element: group 1 name, group 2 attributes, group 3 content up to its close or the page end."""
    return f"(?is)<({names})(?=[\\s/>]){ATTRIBUTES}>(.*?)(?:</\\1\\s*>|\\z)"


def elements(html: Sql, names: str) -> Sql:
    """array<struct<name, attrs, content>> of elements with one of the given names."""
    pattern = element_pattern(names)
    return each(
        X.extract_all(html, pattern),
        lambda m: f"named_struct('name', lower({X.extract(m, pattern, 1)}), 'attrs', {X.extract(m, pattern, 2)}, "
        f"'content', {X.extract(m, pattern, 3)})",
    )


def body_scope(html: Sql) -> Sql:
    """Content of the first body element, or the whole page when there is none."""
    after = f"split({html}, {X.lit(f'(?i)<body(?=[\\s/>]){ATTRIBUTES}>')}, 2)"
    close = X.lit("(?i)</body\\s*>")
    return let(after, lambda a: f"CASE WHEN size({a}) = 2 THEN split({a}[1], {close}, 2)[0] ELSE {a}[0] END")


def body_text(html: Sql) -> Sql:
    """Visible text of the body; comments are removed as well."""
    return X.strip_tags(X.replaced(X.drop_scripts(body_scope(html)), "(?s)<!--.*?-->", " "))


def title_of(html: Sql) -> Sql:
    return X.decode_entities(f"nullif({X.trim_blank(X.extract(html, element_pattern('title'), 3))}, '')")


def meta_entries(tags: Sql) -> Sql:
    """array<struct<name, property, content>> of the meta tags, in page order."""
    return each(
        named(tags, "meta"),
        lambda t: "named_struct("
        + ", ".join(f"'{k}', {attribute(f'{t}.attrs', k)}" for k in ("name", "property", "content"))
        + ")",
    )


def first_meta(metas: Sql, key: str) -> Sql:
    """Content of the first meta whose name or property is `key`."""
    k = X.lit(key)
    hits = keep(metas, lambda m: f"coalesce({m}.name = {k}, false) OR coalesce({m}.property = {k}, false)")
    return f"try_element_at({hits}, 1).content"


def meta_map(metas: Sql) -> Sql:
    """map of meta key to content; a repeated key keeps its last content."""
    entries = keep(
        each(
            metas,
            lambda m: f"named_struct('k', coalesce(nullif({m}.name, ''), nullif({m}.property, '')), 'v', coalesce({m}.content, ''))",
        ),
        lambda e: f"{e}.k IS NOT NULL",
    )

    def last_of(keyed: Sql) -> Sql:
        keys = f"array_distinct({each(keyed, lambda e: f'{e}.k')})"
        pairs = each(keys, lambda k: f"struct({k}, try_element_at({keep(keyed, lambda e: f'{e}.k = {k}')}, -1).v)")
        return f"map_from_entries({pairs})"

    return let(entries, last_of)


def sub_map(entries: Sql, prefix: str) -> Sql:
    """Entries whose key starts with `prefix`, with the prefix removed."""
    return (
        f"transform_keys(map_filter({entries}, (k, v) -> startswith(k, {X.lit(prefix)})), "
        f"(k, v) -> substring(k, {len(prefix) + 1}))"
    )


def first_link(tags: Sql, rel: str) -> Sql:
    """href of the first link tag with the given rel."""
    hits = keep(named(tags, "link"), lambda t: f"lower({attribute(f'{t}.attrs', 'rel')}) = {X.lit(rel)}")
    return attribute(f"try_element_at({hits}, 1).attrs", "href")


def jsonld_blocks(html: Sql) -> Sql:
    """Texts of the non-empty ld+json script blocks."""
    scripts = keep(elements(html, "script"), lambda s: X.matches(attribute(f"{s}.attrs", "type"), "(?i)ld\\+json"))
    return keep(each(scripts, lambda s: X.trim_blank(f"{s}.content")), lambda c: f"{c} <> ''")


def anchors(tags: Sql) -> Sql:
    """array<struct<href, rel>> of the anchors, missing attributes as null."""
    return each(
        named(tags, "a"),
        lambda t: f"named_struct('href', {attribute(f'{t}.attrs', 'href')}, 'rel', {attribute(f'{t}.attrs', 'rel')})",
    )
