"""SQL fragments for text: blanks, entities, tag removal, counting, rounding.

Functions here and in the sibling modules take and return SQL expression text.
Large row-local expressions built this way reach the JVM as one parsed string
instead of thousands of calls, and nest freely inside lambdas.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

Sql = str

# Characters that count as blank in browser text (wider than Java's \s).
BLANK = "\\s\\x0B\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"

# The named entities that are decoded, in decoding order.
NAMED_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
]

_names = count()


def lit(value: str) -> Sql:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values) -> Sql:
    """Comma-separated string literals."""
    return ", ".join(lit(v) for v in values)


def _bind(template: str, value: Sql, body: Callable[[str], Sql]) -> Sql:
    name = f"v{next(_names)}"
    return template.format(value=value, name=name, body=body(name))


def let(value: Sql, body: Callable[[str], Sql]) -> Sql:
    """Evaluate `value` once per row and use it any number of times in `body`."""
    return _bind("element_at(transform(array({value}), {name} -> {body}), 1)", value, body)


def each(values: Sql, body: Callable[[str], Sql]) -> Sql:
    return _bind("transform({value}, {name} -> {body})", values, body)


def keep(values: Sql, condition: Callable[[str], Sql]) -> Sql:
    return _bind("filter({value}, {name} -> {body})", values, condition)


def some(values: Sql, condition: Callable[[str], Sql]) -> Sql:
    return _bind("exists({value}, {name} -> {body})", values, condition)


def replaced(value: Sql, pattern: str, by: str) -> Sql:
    return f"regexp_replace({value}, {lit(pattern)}, {lit(by)})"


def extract(value: Sql, pattern: str, group: int = 1) -> Sql:
    return f"regexp_extract({value}, {lit(pattern)}, {group})"


def extract_all(value: Sql, pattern: str, group: int = 0) -> Sql:
    return f"regexp_extract_all({value}, {lit(pattern)}, {group})"


def matches(value: Sql, pattern: str) -> Sql:
    return f"({value} rlike {lit(pattern)})"


def count_matches(value: Sql, pattern: str) -> Sql:
    return f"regexp_count({value}, {lit(pattern)})"


def half_up(value: Sql) -> Sql:
    """Round half up to a whole number (-2.5 becomes -2)."""
    return f"floor(({value}) + 0.5D)"


def half_up_1(value: Sql) -> Sql:
    """Round half up to one decimal."""
    return f"(floor(({value}) * 10D + 0.5D) / 10D)"


def squeeze(value: Sql) -> Sql:
    """Collapse every run of blanks to one space and trim the ends."""
    return f"trim({replaced(value, f'[{BLANK}]+', ' ')})"


def trim_blank(value: Sql) -> Sql:
    return replaced(value, f"^[{BLANK}]+|[{BLANK}]+$", "")


def is_blank(value: Sql) -> Sql:
    return f"coalesce({squeeze(value)} = '', true)"


def filled(value: Sql) -> Sql:
    """Not null and not the empty string."""
    return f"coalesce({value} <> '', false)"


def _code_point(number: Sql) -> Sql:
    return let(
        f"try_cast({number} AS BIGINT)",
        lambda n: f"decode(unhex(lpad(hex(CASE WHEN {n} <= 1114111 AND {n} NOT BETWEEN 55296 AND 57343 THEN {n} ELSE 65533 END), 8, '0')), 'UTF-32')",
    )


def _decode_numeric(value: Sql) -> Sql:
    decimals = f"array_distinct({extract_all(value, '&#([0-9]{1,9});', 1)})"
    value = f"aggregate({decimals}, {value}, (acc, d) -> replace(acc, concat('&#', d, ';'), {_code_point('d')}))"
    return let(
        value,
        lambda v: f"aggregate(array_distinct({extract_all(v, '(?i)(&#x[0-9a-f]{1,8};)', 1)}), {v}, "
        f"(acc, h) -> replace(acc, h, {_code_point('conv(substring(h, 4, length(h) - 4), 16, 10)')}))",
    )


def decode_entities(value: Sql) -> Sql:
    """Decode the six named entities and numeric ones; untouched text takes the cheap branch."""

    def all_entities(v: Sql) -> Sql:
        for entity, char in NAMED_ENTITIES:
            v = f"replace({v}, {lit(entity)}, {lit(char)})"
        return let(v, lambda n: f"CASE WHEN contains({n}, '&#') THEN {_decode_numeric(n)} ELSE {n} END")

    return let(value, lambda v: f"CASE WHEN contains({v}, '&') THEN {all_entities(v)} ELSE {v} END")


def drop_scripts(html: Sql) -> Sql:
    return replaced(replaced(html, "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " ")


def strip_tags(html: Sql) -> Sql:
    """Visible text: scripts, styles and tags removed, entities decoded, blanks squeezed."""
    return squeeze(decode_entities(replaced(drop_scripts(html), "<[^>]+>", " ")))


def word_count(text: Sql) -> Sql:
    """CJK characters plus runs of Latin letters."""
    return f"({count_matches(text, '[一-龥]')} + {count_matches(text, '[a-zA-Z]+')})"


def contains_any(value: Sql, words) -> Sql:
    return "(" + " OR ".join(f"contains({value}, {lit(w)})" for w in words) + ")"


def text_list(values: Sql, sep: str = "|") -> Sql:
    """Array of strings as one sorted text, for report columns."""
    return f"array_join(array_sort({values}), {lit(sep)})"


def timestamp_of(value: Sql) -> Sql:
    return f"try_cast({value} AS TIMESTAMP)"
