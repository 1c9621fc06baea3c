"""Structured-data nodes of a page, walked level by level inside the row.

The walk is a fold that goes on until no level is left, so it needs no shuffle
and no join however deep the documents nest. Every node carries its path of
child positions; sorting by path gives document (depth-first) order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import html as H
from siteglass.functions import text as X
from siteglass.functions.rows import explode_rows
from siteglass.functions.text import Sql, each, keep, let

# The keys followed when collecting typed nodes.
NODE_KEYS = [
    "@graph", "mainEntity", "itemListElement", "author", "creator", "publisher", "provider", "item",
    "acceptedAnswer", "suggestedAnswer", "steps", "step", "offers", "brand", "address", "contactPoint",
]

# The keys followed when collecting page signals.
SIGNAL_KEYS = ["@graph", "author", "creator", "publisher", "mainEntity", "itemListElement"]

EMPTY_FRONTIER = "cast(array() AS array<struct<path:array<int>,in_author:boolean,v:variant>>)"
NO_TEXT = "cast(array() AS array<string>)"


def as_object(v: Sql) -> Sql:
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def as_array(v: Sql) -> Sql:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def as_text(v: Sql) -> Sql:
    """The variant's text when it is a JSON string, else null."""
    return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN try_variant_get({v}, '$', 'string') END"


def text_values(v: Sql) -> Sql:
    """A JSON string or the strings of a JSON array, as an array."""
    many = keep(each(as_array(v), as_text), lambda t: f"{t} IS NOT NULL")
    return let(as_text(v), lambda s: f"CASE WHEN {s} IS NOT NULL THEN array({s}) ELSE coalesce({many}, {NO_TEXT}) END")


def _children(n: Sql, keys: list[str]) -> Sql:
    members = (
        f"transform({as_array(f'{n}.v')}, (m, i) -> "
        f"named_struct('path', concat({n}.path, array(i)), 'in_author', {n}.in_author, 'v', m))"
    )

    def fields(obj: Sql) -> Sql:
        listed = (
            f"transform(array({X.lits(keys)}), (k, i) -> named_struct('path', concat({n}.path, array(i)), "
            f"'in_author', {n}.in_author OR k IN ('author', 'creator'), 'v', try_element_at({obj}, k)))"
        )
        return f"CASE WHEN {obj} IS NOT NULL THEN {keep(listed, lambda f: f'{f}.v IS NOT NULL')} END"

    return f"coalesce({members}, {let(as_object(f'{n}.v'), fields)}, {EMPTY_FRONTIER})"


NODE = "struct<path:array<int>,in_author:boolean,v:variant>"
FOUND = "struct<path:array<int>,in_author:boolean,v:variant,depth:int>"


def _walked(keys: list[str]) -> Sql:
    """All nodes below the `blocks` column of JSON texts, level after level until none is left: array of FOUND.

    One fold inside the row: its state is the next level and the nodes so far. A document has no more levels than opening
    brackets, and once the next level is empty the state stays as it is.
    """
    roots = (
        "filter(transform(blocks, (b, i) -> named_struct('path', array(i), 'in_author', false, 'v', try_parse_json(b))), "
        "r -> r.v IS NOT NULL)"
    )
    most = "aggregate(blocks, 0, (n, b) -> n + length(b) - length(translate(b, '{[', '')))"
    here = "transform(s.next, n -> named_struct('path', n.path, 'in_author', n.in_author, 'v', n.v, 'depth', level))"
    below = f"flatten({each('s.next', lambda n: _children(n, keys))})"
    step = f"CASE WHEN size(s.next) = 0 THEN s ELSE named_struct('next', {below}, 'found', concat(s.found, {here})) END"
    start = f"named_struct('next', cast({roots} AS array<{NODE}>), 'found', cast(array() AS array<{FOUND}>))"
    return f"aggregate(sequence(0, {most}), {start}, (s, level) -> {step}).found"


def with_nodes(df: DataFrame, depth: int | None = None) -> DataFrame:
    """Add `nodes`: array<struct<path, types, node, depth>> of typed nodes in document order (node as JSON text).

    All levels are followed; `depth` leaves out nodes below that level.
    """
    types = lambda n: text_values(f"try_element_at({as_object(f'{n}.v')}, '@type')")
    within = lambda walked: walked if depth is None else keep(walked, lambda n: f"{n}.depth <= {depth}")
    rows = each(
        within("_walked"), lambda n: f"named_struct('path', {n}.path, 'types', {types(n)}, 'node', to_json({n}.v), 'depth', {n}.depth)"
    )
    nodes = f"array_sort({keep(rows, lambda n: f'size({n}.types) > 0')})"
    return df.withColumn("_walked", F.expr(_walked(NODE_KEYS))).withColumn("nodes", F.expr(nodes)).drop("_walked")


def with_signals(df: DataFrame, depth: int | None = None) -> DataFrame:
    """Add `ld`: struct of distinct types and the seven author, publisher and date flags; `depth` as for nodes."""

    def entry(n: Sql) -> Sql:
        return let(
            as_object(f"{n}.v"),
            lambda o: f"named_struct('path', {n}.path, 'in_author', {n}.in_author, "
            f"'types', {text_values(f'try_element_at({o}, \'@type\')')}, 'keys', map_keys({o}))",
        )

    within = "_walked" if depth is None else keep("_walked", lambda n: f"{n}.depth <= {depth}")
    listed = keep(each(within, entry), lambda e: f"{e}.keys IS NOT NULL")
    df = df.withColumn("_walked", F.expr(_walked(SIGNAL_KEYS))).withColumn("_objects", F.expr(f"array_sort({listed})")).drop("_walked")

    def has(*keys: str) -> Sql:
        return f"exists(_objects, o -> arrays_overlap(o.keys, array({X.lits(keys)})))"

    types = "array_distinct(flatten(transform(_objects, o -> o.types)))"
    return df.withColumn(
        "ld",
        F.expr(
            f"named_struct('types', {types}, 'has_author', {has('author', 'creator')}, "
            f"'has_organization', {has('publisher')}, 'has_date_published', {has('datePublished')}, "
            f"'has_date_modified', {has('dateModified')}, 'has_same_as', {has('sameAs', 'identifier')}, "
            f"'has_faq_page', exists(_objects, o -> array_contains(o.types, 'FAQPage')), 'has_author_same_as', "
            "exists(_objects, o -> o.in_author AND arrays_overlap(o.keys, array('sameAs', 'identifier'))))"
        ),
    ).drop("_objects")


def with_root_types(df: DataFrame) -> DataFrame:
    """Add `root_types`: types of the block roots and of direct @graph members."""

    def types_of(v: Sql) -> Sql:
        return f"coalesce({text_values(f'try_element_at({as_object(v)}, \'@type\')')}, {NO_TEXT})"

    def graph_types(v: Sql) -> Sql:
        members = as_array(f"try_element_at({as_object(v)}, '@graph')")
        return f"coalesce(flatten({each(members, types_of)}), {NO_TEXT})"

    parsed = keep(each("blocks", lambda b: f"try_parse_json({b})"), lambda v: f"{v} IS NOT NULL")
    roots = f"flatten({each(parsed, lambda v: f'coalesce({as_array(v)}, array({v}))')})"
    listed = f"flatten({each(roots, lambda r: f'concat({types_of(r)}, {graph_types(r)})')})"
    return df.withColumn("root_types", F.expr(f"array_distinct({listed})"))


def with_blocks(pages: DataFrame) -> DataFrame:
    return pages.withColumn("blocks", F.expr(H.jsonld_blocks("html")))


def jsonld_nodes(pages: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per typed node, down to level `depth` or all: url, node_ordinal, types, node."""
    df = with_nodes(with_blocks(pages.select("url", "html")), depth)
    rows = explode_rows(df, "nodes", "n", "url", position="node_ordinal")
    return rows.selectExpr("url", "node_ordinal", "n.types", "n.node")


def jsonld_signals(pages: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per page: type list and the seven flags."""
    return with_signals(with_blocks(pages.select("url", "html")), depth).select("url", "ld.*")


def root_types(pages: DataFrame) -> DataFrame:
    """One row per page and root type."""
    df = with_root_types(with_blocks(pages.select("url", "html")))
    return explode_rows(df, "root_types", "root_type", "url")
