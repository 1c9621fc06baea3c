"""SQL fragments for stable keys: SHA-256 identity keys and short SHA-1 ids."""

from __future__ import annotations

from siteglass.functions.text import Sql

SEPARATOR = "\u0001"


def joined_key(*parts: Sql) -> Sql:
    """SHA-256 over the parts; a missing part counts as empty text and keeps its place."""
    texts = ", ".join(f"coalesce(cast({p} AS string), '')" for p in parts)
    return f"sha2(concat_ws('{SEPARATOR}', {texts}), 256)"


def short_id(kind: Sql, payload: Sql) -> Sql:
    """kind:xxxxxxxx where x is the head of SHA-1 over `kind|payload`."""
    return f"concat({kind}, ':', substring(sha1(concat({kind}, '|', {payload})), 1, 8))"
