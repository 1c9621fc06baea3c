"""SQL fragments for URLs: parts, resolution, normal forms, domains."""

from __future__ import annotations

from siteglass.functions import text as X
from siteglass.functions.text import Sql, let

# scheme, host, port, path, query, fragment
_URL = "^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(\\?[^#]*)?(#.*)?\\z"
_SPLIT = "\u0001".join(f"${i}" for i in range(1, 7))

# Second-level labels that make a public suffix of two labels.
SECOND_LEVEL = ["com", "co", "org", "net", "gov", "edu", "ac"]

# Path endings that are never crawled as pages.
STATIC_ENDINGS = [
    ".css", ".js", ".mjs", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".zip",
    ".webp", ".ico", ".woff", ".woff2", ".ttf", ".mp4", ".webm", ".mp3",
]

ABSOLUTE = "^(?i)https?://"


def pieces(url: Sql) -> Sql:
    """[scheme, host, port, path, query, fragment] in one pass, or the text alone when it is no URL."""
    return f"split({X.replaced(url, _URL, _SPLIT)}, '\u0001', -1)"


def _parsed(p: Sql) -> Sql:
    return f"(size({p}) = 6 AND get({p}, 1) <> '')"


def _origin(p: Sql) -> Sql:
    default = f"{p}[2] = '' OR (lower({p}[0]) = 'https' AND {p}[2] = '443') OR (lower({p}[0]) = 'http' AND {p}[2] = '80')"
    return f"concat(lower({p}[0]), '://', lower({p}[1]), CASE WHEN {default} THEN '' ELSE concat(':', {p}[2]) END)"


def _path(p: Sql) -> Sql:
    return f"CASE WHEN {p}[3] = '' THEN '/' ELSE {p}[3] END"


def host_of(url: Sql) -> Sql:
    """Lower-case host name; empty text when the URL cannot be parsed."""
    return f"lower({X.extract(url, _URL, 2)})"


def path_of(url: Sql) -> Sql:
    return let(X.extract(url, _URL, 4), lambda p: f"CASE WHEN {p} = '' THEN '/' ELSE {p} END")


def is_url(url: Sql) -> Sql:
    return f"coalesce({host_of(url)} <> '', false)"


def origin_of(url: Sql) -> Sql:
    """scheme://host[:port], or the text itself when it is not a URL."""
    return let(pieces(url), lambda p: f"CASE WHEN {_parsed(p)} THEN {_origin(p)} ELSE {p}[0] END")


def percent_encode(value: Sql, unsafe: str) -> Sql:
    """Percent-encode the characters of the class `unsafe` (and all non-ASCII) as UTF-8."""
    pattern = f"[^\\x21-\\x7e]|[{unsafe}]"
    encoded = (
        f"aggregate(array_distinct({X.extract_all(value, pattern)}), {value}, "
        "(acc, c) -> replace(acc, c, CASE WHEN c = ' ' THEN '%20' ELSE url_encode(c) END))"
    )
    return f"CASE WHEN {X.matches(value, pattern)} THEN {encoded} ELSE {value} END"


def _resolve_dots(path: Sql) -> Sql:
    folded = (
        f"aggregate(split(substring({path}, 2), '/', -1), cast(array() AS array<string>), (acc, s) -> "
        "CASE WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN s = '.' THEN acc ELSE concat(acc, array(s)) END)"
    )
    return f"CASE WHEN {X.matches(path, '/[.]{1,2}(/|$)')} THEN concat('/', array_join({folded}, '/')) ELSE {path} END"


def _printed(p: Sql) -> Sql:
    path = let(let(_path(p), _resolve_dots), lambda v: percent_encode(v, "\"<>`{}^"))
    query = percent_encode(f"{p}[4]", "\"<>'")
    return f"concat({_origin(p)}, {path}, {query}, {p}[5])"


def tidy_absolute(url: Sql) -> Sql:
    """An http(s) URL as a browser prints it: lower-case host, default port dropped, path resolved and encoded."""
    return let(url, lambda u: let(pieces(u), lambda p: f"CASE WHEN {_parsed(p)} THEN {_printed(p)} ELSE {u} END"))


def resolve(href: Sql, base: Sql) -> Sql:
    """Resolve `href` against the parsed `base` (see `pieces`)."""

    def joined(h: Sql) -> Sql:
        return (
            f"CASE WHEN {X.matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:')} OR NOT {_parsed(base)} THEN {h} "
            f"WHEN startswith({h}, '//') THEN concat(lower({base}[0]), ':', {h}) "
            f"WHEN startswith({h}, '/') THEN concat({_origin(base)}, {h}) "
            f"WHEN startswith({h}, '?') THEN concat({_origin(base)}, {_path(base)}, {h}) "
            f"WHEN startswith({h}, '#') THEN concat({_origin(base)}, {_path(base)}, {base}[4], {h}) "
            f"WHEN {h} = '' THEN concat({_origin(base)}, {_path(base)}, {base}[4]) "
            f"ELSE concat({_origin(base)}, {X.replaced(_path(base), '[^/]*$', '')}, {h}) END"
        )

    return let(
        let(X.trim_blank(href), joined),
        lambda u: f"CASE WHEN {X.matches(u, ABSOLUTE)} THEN {tidy_absolute(u)} ELSE {u} END",
    )


def absolute_url(href: Sql, base: Sql) -> Sql:
    """Resolve `href` against `base`; text that is no URL at all is returned as is."""
    return let(pieces(base), lambda b: resolve(href, b))


def registrable_domain(raw: Sql) -> Sql:
    """Last two labels of the host, three under a second-level suffix; `www.` is dropped first."""

    def tail(labels: Sql) -> Sql:
        wide = f"try_element_at({labels}, -2) IN ({X.lits(SECOND_LEVEL)})"
        cut = f"CASE WHEN size({labels}) <= 2 THEN 1 WHEN {wide} THEN size({labels}) - 2 ELSE size({labels}) - 1 END"
        return f"array_join(slice({labels}, {cut}, size({labels})), '.')"

    def domain(host: Sql) -> Sql:
        labels = f"split({host}, '[.]', -1)"
        return f"CASE WHEN {host} = '' THEN {raw} ELSE {let(labels, tail)} END"

    url = f"CASE WHEN startswith({raw}, 'http') THEN {raw} ELSE concat('https://', {raw}) END"
    return f"CASE WHEN {raw} IS NOT NULL THEN {let(X.replaced(host_of(url), '^www[.]', ''), domain)} END"


def _no_slash(path: Sql) -> Sql:
    return let(path, lambda p: f"CASE WHEN length({p}) > 1 THEN {X.replaced(p, '/$', '')} ELSE {p} END")


def _sorted_query(query: Sql) -> Sql:
    pairs = X.each(
        X.keep(f"split(substring({query}, 2), '&', -1)", lambda p: f"{p} <> ''"),
        lambda p: f"named_struct('k', substring_index({p}, '=', 1), "
        f"'v', CASE WHEN contains({p}, '=') THEN {X.replaced(p, '^[^=]*=', '')} ELSE '' END)",
    )
    listed = X.each(f"array_sort({pairs})", lambda p: f"concat({p}.k, '=', {p}.v)")
    return let(listed, lambda s: f"CASE WHEN size({s}) > 0 THEN concat('?', array_join({s}, '&')) ELSE '' END")


def _rewritten(raw: Sql, build) -> Sql:
    return let(raw, lambda u: let(pieces(u), lambda p: f"CASE WHEN {_parsed(p)} THEN {build(p)} ELSE {u} END"))


def crawl_url(raw: Sql) -> Sql:
    """Graph node form: no fragment or credentials, sorted query, no trailing slash."""
    return _rewritten(f"trim({raw})", lambda p: f"concat({_origin(p)}, {_no_slash(_path(p))}, {_sorted_query(f'{p}[4]')})")


def canonical_url(raw: Sql) -> Sql:
    """Identity form: no fragment, credentials, default port or trailing slash; query order kept."""
    return _rewritten(
        f"trim(coalesce({raw}, ''))", lambda p: f"concat({_origin(p)}, {X.replaced(_path(p), '/$', '')}, {p}[4])"
    )


def gap_url(raw: Sql) -> Sql:
    """Matching form for search rows: no query, fragment or trailing slash; lower-case host."""
    return _rewritten(f"trim({raw})", lambda p: f"concat({_origin(p)}, {_no_slash(_path(p))})")


def is_static_asset(url: Sql) -> Sql:
    path = f"CASE WHEN {is_url(url)} THEN {path_of(url)} ELSE {url} END"
    return f"lower({X.extract(path, '([.][^.]*)$')}) IN ({X.lits(STATIC_ENDINGS)})"


def same_site(url: Sql, origin: Sql, include_subdomains: bool = False) -> Sql:
    host, own = host_of(url), host_of(origin)
    under = f" OR endswith({host}, concat('.', {own}))" if include_subdomains else ""
    return f"({host} <> '' AND {own} <> '' AND ({host} = {own}{under}))"


def normal_language(code: Sql) -> Sql:
    return let(
        f"split({code}, '-', -1)",
        lambda p: f"CASE WHEN {code} = 'x-default' THEN {code} "
        f"WHEN size({p}) = 2 THEN concat(lower({p}[0]), '-', upper({p}[1])) ELSE lower({code}) END",
    )


def language_of_path(url: Sql) -> Sql:
    """Language code at the start of the path, normalised, or null."""
    code = X.extract(path_of(url), "(?i)^/([a-z]{2,3}(?:-[A-Z]{2})?)(?:/|$)")
    return let(code, lambda c: f"CASE WHEN {c} <> '' THEN {normal_language(c)} END")
