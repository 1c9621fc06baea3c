"""Observation log: validation, keys, run materialisation, version chains, latest rows and diffs.

Log rows carry id, type, subject, target, source, observed_at, run_id,
observer_version, parser_version, strategy_version, prompt_version, status,
status_reason, evidence_refs, result (JSON), signals, confidence, coverage and
write_seq (arrival order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions import keys as K
from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import explode_rows
from siteglass.functions.text import Sql, each, keep, let

# Kinds, statuses and confidences of the contract.
KINDS = [
    "rank", "geo_score", "ai_mention", "robots_policy", "llms_txt", "serp", "audit", "ai_citation", "crawl", "gsc",
    "robots", "llms", "performance",
]
HISTORY_KINDS = [k for k in KINDS if k != "performance"]
STATUSES = [
    "OBSERVED", "PARTIAL", "INDETERMINATE", "MENTIONED", "NOT_MENTIONED", "BLOCKED", "ERROR", "UNOBSERVABLE", "ok",
    "blocked", "unavailable", "error",
]
NEED_REASON = ["blocked", "unavailable", "error", "BLOCKED", "ERROR", "UNOBSERVABLE"]
CONFIDENCES = ["high", "medium", "low", "unavailable"]
COMPARABLE = ["OBSERVED", "MENTIONED", "NOT_MENTIONED"]
SCORE_DELTA = 5
RANK_DELTA = 3

REQUIRED = ["id", "type", "subject", "source", "observed_at", "observer_version", "parser_version", "status"]

# Arrival-order block that a running window handles in one piece.
SEQ_BLOCK = 1_000_000


def validate_observations(log: DataFrame) -> DataFrame:
    """Add `errors`: names of fields that break the contract; empty means valid."""
    checks = [f"CASE WHEN coalesce(cast({c} AS string), '') = '' THEN '{c}' END" for c in REQUIRED]
    checks += [
        f"CASE WHEN confidence IS NULL OR confidence NOT IN ({X.lits(CONFIDENCES)}) THEN 'confidence' END",
        "CASE WHEN coverage IS NULL OR coverage.expected IS NULL OR coverage.observed IS NULL OR coverage.ratio IS NULL THEN 'coverage' END",
        "CASE WHEN evidence_refs IS NULL THEN 'evidence_refs' END",
        f"CASE WHEN status IN ({X.lits(NEED_REASON)}) AND {X.is_blank('status_reason')} THEN 'status_reason' END",
    ]
    return log.withColumn("errors", F.expr(f"filter(array({', '.join(checks)}), e -> e IS NOT NULL)"))


def split_valid(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their errors)."""
    checked = validate_observations(log)
    return checked.where("size(errors) = 0").drop("errors"), checked.where("size(errors) > 0")


def with_keys(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "identity_key": F.expr(K.joined_key("type", "subject", "source")),
            "version_key": F.expr(K.joined_key("observer_version", "parser_version", "coalesce(strategy_version, '-')")),
        }
    )


def site_subject(url: Sql) -> Sql:
    return f"concat('site:', coalesce(nullif({_site(url)}, ''), '*'))"


def search_subject(site: Sql, query: Sql) -> Sql:
    return f"concat('search:site=', coalesce(nullif({_site(site)}, ''), '*'), '|q=', {X.squeeze(f'coalesce({query}, \'\')')})"


def answer_subject(provider: Sql, model: Sql) -> Sql:
    return f"concat('ai-slot:', coalesce(nullif({provider}, ''), 'unknown'), ':', coalesce(nullif({model}, ''), 'unknown'))"


def http_source(url: Sql) -> Sql:
    return f"concat('http:', coalesce(nullif({U.origin_of(f'trim(coalesce({url}, \'\'))')}, ''), '*'))"


def _site(url: Sql) -> Sql:
    bare = f"trim(coalesce({url}, ''))"
    return let(
        bare,
        lambda u: f"CASE WHEN {u} IN ('', '*') THEN {u} WHEN {X.matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://')} THEN {U.canonical_url(u)} "
        f"ELSE {U.canonical_url(f'concat(\'https://\', {u})')} END",
    )


def parse_subject(log: DataFrame) -> DataFrame:
    """Read site, query, provider and model back from the canonical subject."""
    search, slot = "^search:site=([^|]*)[|]q=(.*)$", "^ai-slot:([^:]*):?(.*)$"
    kind = (
        f"CASE WHEN startswith(subject, 'site:') THEN 'site' WHEN {X.matches('subject', search)} THEN 'search' "
        "WHEN startswith(subject, 'ai-slot:') THEN 'ai-slot' END"
    )
    parts = {
        "subject_kind": kind,
        "site": f"CASE {kind} WHEN 'site' THEN substring(subject, 6) WHEN 'search' THEN {X.extract('subject', search, 1)} END",
        "query": f"CASE WHEN {kind} = 'search' THEN {X.extract('subject', search, 2)} END",
        "provider": f"CASE WHEN {kind} = 'ai-slot' THEN {X.extract('subject', slot, 1)} END",
        "model": f"CASE WHEN {kind} = 'ai-slot' THEN nullif({X.extract('subject', slot, 2)}, '') END",
    }
    return log.withColumns({n: F.expr(sql) for n, sql in parts.items()})


def history(
    log: DataFrame, type: str | None = None, subject: str | None = None, source: str | None = None, run_id: str | None = None,
    status: str | None = None, since: str | None = None, until: str | None = None, latest: bool = False,
    order: str = "desc", limit: int | None = None,
) -> DataFrame:
    """Filtered history; the subject also matches `target`; without a limit all rows come back."""
    if type is not None and type not in HISTORY_KINDS:
        raise ValueError(f"unknown type {type!r}")
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    if (limit is not None and limit < 1) or order not in ("asc", "desc"):
        raise ValueError("limit must be positive and order asc or desc")
    for column, value in (("type", type), ("source", source), ("run_id", run_id), ("status", status)):
        if value is not None:
            log = log.where(F.col(column) == value)
    if subject is not None:
        log = log.where((F.col("subject") == subject) | (F.col("target") == subject))
    if since is not None:
        log = log.where(F.col("observed_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        log = log.where(F.col("observed_at") <= F.lit(until).cast("timestamp"))
    if latest:
        log = latest_per_identity(with_keys(log))
    direction = F.desc if order == "desc" else F.asc
    ordered = log.orderBy(direction("observed_at"), direction("write_seq"))
    return ordered if limit is None else ordered.limit(limit)


def keep_first(rows: DataFrame, key: str) -> DataFrame:
    """First arrival per key; rows without a key are all kept."""
    keyed = rows.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min("write_seq").alias("write_seq"))
    return keyed.join(first, [key, "write_seq"], "left_semi").unionByName(rows.where(F.col(key).isNull()))


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """Same kind, subject, source, URL, content and run kept once; an explicit key overrides; no run, no key."""
    own = K.joined_key("kind", "subject", "source", "request_url", "content_hash", "run_id")
    key = (
        f"CASE WHEN explicit_key IS NOT NULL THEN {K.joined_key(X.lit('explicit'), 'explicit_key')} WHEN run_id IS NOT NULL THEN {own} END"
    )
    return keep_first(evidence.withColumn("dedupe_key", F.expr(key)), "dedupe_key")


def idempotent_observations(log: DataFrame, key: str = "idempotency_key") -> DataFrame:
    return keep_first(log, key)


def materialize_run(log: DataFrame) -> DataFrame:
    """Within one run the last write of an identity and version wins and keeps the first id; adds `first_seq`."""
    keyed = with_keys(log)
    slot = ["identity_key", "version_key", "run_id"]
    runs = keyed.where("run_id IS NOT NULL")
    kept = runs.groupBy(*slot).agg(
        F.min_by("id", "write_seq").alias("_first_id"), F.min("write_seq").alias("first_seq"), F.max("write_seq").alias("write_seq")
    )
    last = runs.join(kept.select("write_seq", "_first_id", "first_seq"), "write_seq").withColumn("id", F.col("_first_id")).drop("_first_id")
    single = keyed.where("run_id IS NULL").withColumn("first_seq", F.col("write_seq"))
    return last.unionByName(single)


def version_chain(log: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """Add `replaces`: the id of the identity's latest earlier row when its version differs.

    The running latest is computed per arrival block and carried across blocks from one row each, so a busy
    identity is split.
    """
    row = F.struct("observed_at", "first_seq", "id", "version_key")
    df = log.withColumn("_block", F.expr(f"first_seq DIV {block}")).withColumn("_row", row)
    within = Window.partitionBy("identity_key", "_block").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("identity_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = df.groupBy("identity_key", "_block").agg(F.max("_row").alias("_last"))
    carried = per_block.withColumn("_carried", F.max("_last").over(earlier)).select("identity_key", "_block", "_carried")
    df = df.withColumn("_seen", F.max("_row").over(within)).join(carried, ["identity_key", "_block"])
    latest = F.greatest("_seen", "_carried")
    return df.withColumn("_latest", latest).withColumn(
        "replaces", F.expr("CASE WHEN _latest.version_key <> version_key THEN _latest.id END")
    ).drop("_block", "_row", "_seen", "_carried", "_latest")


def latest_per_identity(log: DataFrame) -> DataFrame:
    """Newest row per identity; equal times go to the last written. Partial maxima keep busy identities cheap."""
    newest = log.groupBy("identity_key").agg(F.max(F.struct("observed_at", "write_seq")).alias("_n"))
    return log.join(newest.selectExpr("identity_key", "_n.write_seq AS write_seq"), ["identity_key", "write_seq"], "left_semi")


PAIR_FIELDS = [
    "id", "type", "subject", "source", "observed_at", "observer_version", "parser_version", "strategy_version", "prompt_version",
    "status", "evidence_refs", "result", "signals", "coverage",
]


def latest_pair(log: DataFrame) -> DataFrame:
    """(identity_key, prev, cur): the last two rows of every identity; prev is null for a single row."""
    order = Window.partitionBy("identity_key").orderBy(F.desc("observed_at"), F.desc("write_seq"))
    # The row-number filter lets every task keep two rows per identity before the shuffle.
    top = log.withColumn("_n", F.row_number().over(order)).where("_n <= 2").withColumn("_row", F.struct(*PAIR_FIELDS))
    return top.groupBy("identity_key").agg(
        F.first(F.when(F.col("_n") == 2, F.col("_row")), ignorenulls=True).alias("prev"),
        F.first(F.when(F.col("_n") == 1, F.col("_row")), ignorenulls=True).alias("cur"),
    )


def comparability(pairs: DataFrame) -> DataFrame:
    """Add `comparable` and the first reason why not."""
    good = X.lits(COMPARABLE)
    reason = (
        "CASE WHEN prev IS NULL THEN 'missing_previous' "
        "WHEN prev.subject <> cur.subject OR prev.type <> cur.type THEN 'subject_mismatch' "
        "WHEN prev.observer_version <> cur.observer_version THEN 'observer_version_changed' "
        "WHEN prev.parser_version <> cur.parser_version THEN 'parser_version_changed' "
        "WHEN NOT (prev.prompt_version <=> cur.prompt_version) THEN 'prompt_version_changed' "
        f"WHEN prev.status NOT IN ({good}) OR cur.status NOT IN ({good}) THEN 'status_not_observed' END"
    )
    return pairs.withColumn("reason", F.expr(reason)).withColumn("comparable", F.expr("reason IS NULL"))


def _change(condition: Sql, kind: str, path: Sql, before: Sql, after: Sql, direction: Sql, delta: Sql = "NULL") -> Sql:
    return (
        f"CASE WHEN {condition} THEN named_struct('kind', '{kind}', 'path', {path}, 'previous', cast({before} AS string), "
        f"'current', cast({after} AS string), 'direction', {direction}, 'delta', cast({delta} AS double)) END"
    )


_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def _value_change(path: str) -> Sql:
    """Score change with a threshold; anything that is no number has an unknown direction."""
    def body(p: Sql) -> Sql:
        both = f"({X.matches(f'schema_of_variant({p}.a)', _NUMBER)} AND {X.matches(f'schema_of_variant({p}.b)', _NUMBER)})"
        delta = f"try_variant_get({p}.b, '$', 'double') - try_variant_get({p}.a, '$', 'double')"
        a, b = f"to_json({p}.a)", f"to_json({p}.b)"
        direction = (
            f"CASE WHEN NOT coalesce({both}, false) THEN 'unknown' WHEN abs({delta}) < {SCORE_DELTA} THEN 'neutral' "
            f"WHEN {delta} > 0 THEN 'improved' ELSE 'degraded' END"
        )
        return _change(
            f"cur.type = 'geo_score' AND NOT ({a} <=> {b})", "VALUE", f"'result.{path}'", a, b, direction,
            f"CASE WHEN coalesce({both}, false) THEN {delta} END",
        )

    get = lambda side: f"try_variant_get(_{side}, '$.{path}', 'variant')"
    return let(f"named_struct('a', {get('prev')}, 'b', {get('cur')})", body)


def _rank_change() -> Sql:
    get = lambda side: f"try_variant_get(_{side}, '$.targetRank', 'double')"
    null = lambda side: f"coalesce(is_variant_null(try_variant_get(_{side}, '$.targetRank', 'variant')), false)"

    def body(p: Sql) -> Sql:
        direction = (
            f"CASE WHEN {p}.a IS NULL THEN CASE WHEN {p}.b IS NULL THEN 'unknown' ELSE 'improved' END WHEN {p}.b IS NULL THEN 'degraded' "
            f"WHEN abs({p}.b - {p}.a) < {RANK_DELTA} THEN 'neutral' WHEN {p}.b < {p}.a THEN 'improved' ELSE 'degraded' END"
        )
        changed = f"cur.type = 'rank' AND NOT ({p}.na AND {p}.nb) AND ({p}.a IS NULL OR {p}.b IS NULL OR {p}.a <> {p}.b)"
        return _change(changed, "VALUE", "'result.targetRank'", f"cast({p}.a AS bigint)", f"cast({p}.b AS bigint)", direction, f"{p}.b - {p}.a")

    return let(f"named_struct('a', {get('prev')}, 'b', {get('cur')}, 'na', {null('prev')}, 'nb', {null('cur')})", body)


def _set_changes() -> list[Sql]:
    """Members that came or went: result-item domains of ranks, cited domains of mentions."""
    none = "cast(array() AS array<string>)"

    def members(side: str) -> Sql:
        items = f"transform(try_variant_get(_{side}, '$.items', 'array<variant>'), i -> try_variant_get(i, '$.domain', 'string'))"
        cited = f"try_variant_get(_{side}, '$.citedDomains', 'array<string>')"
        listed = f"CASE cur.type WHEN 'rank' THEN {items} WHEN 'ai_mention' THEN {cited} END"
        return f"array_distinct({keep(f'coalesce({listed}, {none})', X.filled)})"

    path = "CASE cur.type WHEN 'rank' THEN 'result.items[].domain' ELSE 'result.citedDomains' END"
    out = []
    for kind, left, right in (("ADDED", "cur", "prev"), ("REMOVED", "prev", "cur")):
        gone = f"array_sort(array_except({members(left)}, {members(right)}))"
        values = ("''", "array_join({g}, ',')") if kind == "ADDED" else ("array_join({g}, ',')", "''")
        out.append(
            let(gone, lambda g, k=kind, v=values: _change(f"size({g}) > 0", k, path, v[0].format(g=g), v[1].format(g=g), "'neutral'"))
        )
    return out


def _signal_changes() -> Sql:
    """array of EVIDENCE changes for extracted signals that were added, changed or removed."""
    names = "array_union(transform(coalesce(cur.signals, array()), s -> s.signal), transform(coalesce(prev.signals, array()), s -> s.signal))"

    def entry(n: Sql) -> Sql:
        last = lambda side: f"try_element_at(filter({side}.signals, s -> s.signal = {n}), -1).value"
        return let(
            f"named_struct('a', {last('prev')}, 'b', {last('cur')})",
            lambda p: _change(f"NOT ({p}.a <=> {p}.b)", "EVIDENCE", f"concat('extractedEvidence.', {n})", f"{p}.a", f"{p}.b", "'unknown'"),
        )

    return each(names, entry)


def _other_changes() -> list[Sql]:
    mention = (
        "CASE WHEN prev.status = 'NOT_MENTIONED' AND cur.status = 'MENTIONED' THEN 'improved' "
        "WHEN prev.status = 'MENTIONED' AND cur.status = 'NOT_MENTIONED' THEN 'degraded' ELSE 'unknown' END"
    )

    def rules(side: str) -> Sql:
        model = f"coalesce(try_variant_get(_{side}, '$.geoVersion', 'string'), try_variant_get(_{side}, '$.version', 'string'))"
        return (
            f"coalesce(nullif(try_variant_get(_{side}, '$.scoringVersion', 'string'), ''), "
            f"CASE WHEN {model} IN ('1.0.0', '2.0.0') THEN {model} END)"
        )

    refs = lambda side: f"array_join(array_sort(array_distinct(coalesce({side}.evidence_refs, array()))), ',')"
    return [
        _change("prev.status <> cur.status", "STATUS", "'status'", "prev.status", "cur.status", mention),
        _change("NOT (prev.coverage <=> cur.coverage)", "COVERAGE", "'coverage'", "to_json(prev.coverage)", "to_json(cur.coverage)", "'unknown'"),
        _change(
            "NOT (prev.strategy_version <=> cur.strategy_version)", "VERSION", "'strategyVersion'", "prev.strategy_version",
            "cur.strategy_version", "'unknown'",
        ),
        let(
            f"named_struct('a', {rules('prev')}, 'b', {rules('cur')})",
            lambda p: _change(f"cur.type = 'geo_score' AND NOT ({p}.a <=> {p}.b)", "VERSION", "'result.scoringVersion'", f"{p}.a", f"{p}.b", "'unknown'"),
        ),
        _change(f"{refs('prev')} <> {refs('cur')}", "EVIDENCE", "'evidenceRefs'", refs("prev"), refs("cur"), "'neutral'"),
    ]


def _incomparable_changes() -> Sql:
    """Status or version rows only, all with an unknown direction."""
    versions = {
        "observer_version_changed": ("observerVersion", "observer_version"),
        "parser_version_changed": ("parserVersion", "parser_version"),
        "prompt_version_changed": ("metadata.promptVersion", "prompt_version"),
    }
    changes = [
        _change(f"reason = '{r}'", "VERSION", f"'{path}'", f"prev.{c}", f"cur.{c}", "'unknown'") for r, (path, c) in versions.items()
    ]
    status = _change(
        f"prev.status <> cur.status OR reason NOT IN ({X.lits(versions)})", "STATUS", "'status'", "prev.status", "cur.status", "'unknown'"
    )
    return f"array({', '.join([status, *changes])})"


def diff_observations(pairs: DataFrame) -> DataFrame:
    """Every change between the two rows of each identity, in long form. Row-local after the pairing."""
    df = comparability(pairs).withColumns(
        {"_prev": F.expr("try_parse_json(prev.result)"), "_cur": F.expr("try_parse_json(cur.result)")}
    )
    compared = f"concat(array({', '.join([_value_change('seoScore'), _value_change('geoScore'), _rank_change(), *_set_changes(), *_other_changes()])}), {_signal_changes()})"
    changes = f"CASE WHEN prev IS NULL THEN array() WHEN comparable THEN {compared} ELSE {_incomparable_changes()} END"
    rows = explode_rows(df.withColumn("_changes", F.expr(changes)), "_changes", "c", "identity_key", "cur", "comparable", "reason")
    return rows.selectExpr(
        "identity_key", "cur.type AS type", "cur.subject AS subject", "cur.id AS current_id", "comparable", "reason",
        "c.kind", "c.path", "c.previous", "c.current", "c.direction", "c.delta",
    )


def diff_summary(pairs: DataFrame) -> DataFrame:
    """Per identity: comparability and the number of changes by direction."""
    counted = diff_observations(pairs).groupBy("identity_key").agg(
        *[F.expr(f"count_if(direction = '{d}')").alias(d) for d in ("improved", "degraded", "neutral", "unknown")]
    )
    base = comparability(pairs).selectExpr("identity_key", "cur.type AS type", "prev IS NOT NULL AS has_previous", "comparable", "reason")
    return base.join(counted, "identity_key", "left").na.fill(0, ["improved", "degraded", "neutral", "unknown"])


def confidence(ok: Sql, total: Sql) -> Sql:
    return (
        f"CASE WHEN {total} = 0 OR {ok} = 0 THEN 'unavailable' WHEN {ok} = {total} THEN 'high' "
        f"WHEN {ok} / {total} >= 0.5D THEN 'medium' ELSE 'low' END"
    )


# Collector status to observation status.
COLLECTOR_STATUS = (
    "CASE status WHEN 'ok' THEN 'OBSERVED' WHEN 'blocked' THEN 'BLOCKED' WHEN 'unavailable' THEN 'UNOBSERVABLE' "
    "WHEN 'no_results' THEN 'UNOBSERVABLE' ELSE 'ERROR' END"
)


def site_status(status: Sql, error_kind: Sql, has_body: Sql) -> Sql:
    """HTTP outcome of a page fetch as an observation status."""
    return (
        f"CASE WHEN {status} = 0 THEN CASE WHEN {error_kind} IN ('too_large', 'invalid_url') THEN 'ERROR' ELSE 'UNOBSERVABLE' END "
        f"WHEN {status} IN (401, 403, 429) THEN 'BLOCKED' WHEN {status} >= 500 THEN 'ERROR' WHEN {status} IN (404, 410) THEN 'OBSERVED' "
        f"WHEN {status} BETWEEN 200 AND 399 THEN CASE WHEN {has_body} THEN 'OBSERVED' ELSE 'PARTIAL' END ELSE 'ERROR' END"
    )


def protocol_status(status: Sql) -> Sql:
    return (
        f"CASE WHEN {status} = 0 THEN 'UNOBSERVABLE' WHEN {status} IN (401, 403, 429) THEN 'BLOCKED' WHEN {status} >= 500 THEN 'ERROR' "
        "ELSE 'OBSERVED' END"
    )


def rank_freshness(log: DataFrame, hours: int = 24) -> DataFrame:
    """Ranks are snapshots: valid for a day after they were observed."""
    return log.where("type = 'rank'").withColumn("valid_until", F.expr(f"observed_at + INTERVAL {hours} HOURS"))


_OBSERVERS = {
    "geo_score": ("site-observer@0.1.0", "audit@1.0.0"),
    "rank": ("search-observer@0.1.0", "serp@0.1.0"),
    "ai_mention": ("ai-observer@0.1.0", "ai-visibility@0.1.0"),
    "robots_policy": ("protocol-observer@0.1.0", "robots-analysis@1.0.0"),
    "llms_txt": ("protocol-observer@0.1.0", "llms-analysis@1.0.0"),
    "performance": ("crux-observer@0.1.0", "crux-api@0.1.0"),
    "gsc": ("gsc-observer@0.1.0", "gsc-searchanalytics@0.1.0"),
}


def build_observations(results: DataFrame, kind: str, subject: Sql, source: Sql, status: Sql, fields: list[str]) -> DataFrame:
    """Rows of the log from a result table of one kind; `fields` become the JSON result."""
    observer, parser = _OBSERVERS[kind]
    usable = f"({status}) IN ({X.lits(COMPARABLE)})"
    named = ", ".join(f"'{f.split('.')[-1]}', {f}" for f in fields)
    sure = "'medium'" if kind in ("rank", "ai_mention") else "'high'"
    return results.selectExpr(
        f"'{kind}' AS type", f"{subject} AS subject", f"{source} AS source", "observed_at", f"'{observer}' AS observer_version",
        f"'{parser}' AS parser_version", f"{status} AS status",
        f"to_json(named_struct({named}), map('ignoreNullFields', 'false')) AS result",
        f"CASE WHEN {usable} THEN {sure} ELSE 'unavailable' END AS confidence",
        f"named_struct('expected', 1, 'observed', cast({usable} AS int), 'ratio', cast({usable} AS double)) AS coverage",
    )
