"""Evidence log: append, tolerant read, legacy rows, import, redaction, leak check, retention, fetch rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.functions import text as X
from siteglass.functions.text import Sql
from siteglass.operators.observations import answer_subject, http_source, search_subject, site_subject
from siteglass.session import cut_lineage

# Header and query names that carry secrets.
SECRET_HEADER = (
    "(?i)authorization|proxy-authorization|cookie|set-cookie|x-api-key|api-key|apikey|x-auth-token|auth-token|access-token|"
    "refresh-token|x-csrf-token|x-xsrf-token|x-goog-api-key|x-amz-security-token|secret"
)
SECRET_NAME = "(?i)(key|token|secret|credential|password|session|passwd)"
AUTH_SCHEME = "(?i)^(bearer|basic|token)\\s+"
SECRET_PARAMETERS = "key|api_key|apikey|access_token|token|sig|signature"
REDACTED = "[REDACTED]"

# Retention class and days per evidence kind; null keeps for ever.
RETENTION_CLASS = {
    "serp_html": "serpRaw", "llm_response": "aiRaw", "page_html": "siteRaw", "robots_txt": "siteRaw", "llms_txt": "siteRaw",
    "redirect_resolve": "siteRaw",
}
RETENTION_DAYS: dict[str, int | None] = {"serpRaw": 30, "aiRaw": 90, "siteRaw": 30}

# Parsing-strategy version per engine.
STRATEGY_VERSIONS = {
    "baidu": "baidu-mu@1", "360": "so360-data-mdurl@1", "so360": "so360-data-mdurl@1", "sogou": "sogou-citeLinkClass@1",
}

LOG_SCHEMA = (
    "id string, kind string, subject string, source string, target string, request_url string, observed_at timestamp, run_id string, "
    "content_hash string, status int"
)


def append_evidence(evidence: DataFrame, path: str) -> None:
    """Append to the log, partitioned by day of observation."""
    evidence.withColumn("observed_date", F.to_date("observed_at")).write.mode("append").partitionBy("observed_date").parquet(path)


def read_evidence(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of an appended log between two times; the days are partition filters, so other days are not read."""
    rows = spark.read.parquet(path)
    for bound, compare in ((since, "__ge__"), (until, "__le__")):
        if bound is not None:
            at = F.lit(bound).cast("timestamp")
            rows = rows.where(getattr(F.col("observed_date"), compare)(at.cast("date")) & getattr(F.col("observed_at"), compare)(at))
    return rows.drop("observed_date")


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that are no valid JSON with their file) of JSON-lines files, read and parsed once."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
    read = cut_lineage(reader.json(path).select("*", F.col("_metadata.file_path").alias("file")))
    return read.where("_corrupt IS NULL").drop("_corrupt", "file"), read.where("_corrupt IS NOT NULL").selectExpr("_corrupt AS line", "file")


def parse_lines(lines: DataFrame, schema: str = LOG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.where("trim(line) <> ''").withColumn("r", F.from_json("line", f"{schema}, _corrupt string", options))
    return parsed.where("r._corrupt IS NULL").select("r.*").drop("_corrupt"), parsed.where("r._corrupt IS NOT NULL").select("line")


def evidence_history(
    evidence: DataFrame, subject: str | None = None, source: str | None = None, kind: str | None = None, run_id: str | None = None,
    body_retained: bool | None = None, since: str | None = None, until: str | None = None, order: str = "desc", limit: int | None = None,
) -> DataFrame:
    """Filtered evidence, newest first by default; the filters reach the scan."""
    for column, value in (("subject", subject), ("source", source), ("kind", kind), ("run_id", run_id), ("body_retained", body_retained)):
        if value is not None:
            evidence = evidence.where(F.col(column) == value)
    if since is not None:
        evidence = evidence.where(F.col("observed_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        evidence = evidence.where(F.col("observed_at") <= F.lit(until).cast("timestamp"))
    direction = F.desc if order == "desc" else F.asc
    ordered = evidence.orderBy(direction("observed_at"), direction("id"))
    return ordered.limit(limit) if limit else ordered


def normalize_legacy(records: DataFrame) -> DataFrame:
    """Fill subject, source and strategy of old rows from their purpose; present values are never overwritten.

    records: id, purpose, target, request_url, final_url, subject, source, provenance, engine, keyword, site_url,
    provider, model, contract_version.
    """
    legacy = "(coalesce(subject, '') = '' OR coalesce(source, '') = '' OR provenance IS NULL)"
    url = "coalesce(nullif(final_url, ''), nullif(request_url, ''), target)"
    subject = (
        f"CASE coalesce(purpose, 'audit') WHEN 'serp' THEN {search_subject('site_url', 'keyword')} "
        f"WHEN 'ai-visibility' THEN {answer_subject('coalesce(provider, target)', 'model')} "
        f"ELSE {site_subject(f'coalesce(nullif(target, \'\'), {url})')} END"
    )
    source = (
        "CASE coalesce(purpose, 'audit') WHEN 'serp' THEN concat('search-engine:', coalesce(nullif(coalesce(engine, target), ''), 'unknown')) "
        f"WHEN 'ai-visibility' THEN concat('provider:', coalesce(nullif(coalesce(provider, target), ''), 'unknown')) ELSE {http_source(url)} END"
    )
    strategies = ", ".join(f"'{k}', '{v}'" for k, v in STRATEGY_VERSIONS.items())
    # An old row is derived as a whole, like a row that never had the new fields.
    return records.withColumns(
        {
            "legacy": F.expr(legacy),
            "subject": F.expr(f"CASE WHEN {legacy} THEN {subject} ELSE subject END"),
            "source": F.expr(f"CASE WHEN {legacy} THEN {source} ELSE source END"),
            "strategy_version": F.expr(f"CASE WHEN {legacy} AND purpose = 'serp' THEN try_element_at(map({strategies}), engine) END"),
            "migrated_from": F.expr(f"CASE WHEN {legacy} THEN coalesce(contract_version, 'legacy') END"),
        }
    )


def import_missing(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose id is not stored yet, each id once."""
    return incoming.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


#: Header values longer than LONG_HEADER are stored as their first SHOWN characters; fixed values of the log's format.
LONG_HEADER, SHOWN = 120, 40


def redact_headers(headers: Sql, longest: int = LONG_HEADER, shown: int = SHOWN) -> Sql:
    """Secret header values replaced, auth schemes kept; values over `longest` characters keep the first `shown` and a mark."""
    value = (
        f"CASE WHEN {X.matches('k', SECRET_HEADER)} OR {X.matches('k', SECRET_NAME)} THEN '{REDACTED}' "
        f"WHEN {X.matches('v', AUTH_SCHEME)} THEN concat(split(v, '\\\\s+', 2)[0], ' {REDACTED}') "
        f"WHEN length(v) > {longest} THEN concat(substring(v, 1, {shown}), '…[truncated ', length(v) - {shown}, ']') ELSE coalesce(v, '') END"
    )
    return f"transform_values(map_filter({headers}, (k, v) -> trim(k) <> ''), (k, v) -> {value})"


def redact_url(url: Sql) -> Sql:
    """Values of secret query parameters masked (percent-encoded as a URL prints them)."""
    secret = f"(?i)([?&](?:[^=&#]*(?:key|token|secret|credential|password|session|passwd)[^=&#]*|{SECRET_PARAMETERS})=)[^&#]*"
    return X.replaced(url, secret, "$1%5BREDACTED%5D")


def leak_check(evidence: DataFrame, forbidden: list[str], least: int = 8) -> DataFrame:
    """Ids of rows whose headers still contain a forbidden literal of at least `least` characters (shorter ones match too much)."""
    words = [w for w in forbidden if len(w) >= least]
    hit = " OR ".join(f"contains(v, {X.lit(w)}) OR contains(k, {X.lit(w)})" for w in words) or "false"
    return evidence.where(F.expr(f"size(map_filter(headers, (k, v) -> {hit})) > 0")).select("id")


def retention_plan(evidence: DataFrame, as_of: str, days: dict[str, int | None] = RETENTION_DAYS) -> DataFrame:
    """Rows past their retention time, listed and not deleted: id, kind, retention_class, expires_at, body_ref."""
    classes = ", ".join(f"'{k}', '{v}'" for k, v in RETENTION_CLASS.items())
    ttl = " ".join(f"WHEN '{c}' THEN {d}" for c, d in days.items() if d is not None)
    df = evidence.withColumn("retention_class", F.expr(f"coalesce(try_element_at(map({classes}), kind), 'siteRaw')"))
    df = df.withColumn("expires_at", F.expr(f"observed_at + make_dt_interval(CASE retention_class {ttl} END)"))
    return df.where(F.col("expires_at") <= F.lit(as_of).cast("timestamp")).select(
        "id", "kind", "retention_class", "observed_at", "expires_at", "body_ref"
    )


def evidence_rows(fetches: DataFrame, keep_body: bool = False) -> DataFrame:
    """Fetch-log rows as evidence: redacted URLs and headers, content hash, identity; the body only when asked for.

    fetches: id, kind, request_url, final_url, headers, status, body, observed_at, run_id, elapsed_ms.
    """
    retained = f"{str(keep_body).lower()} AND length(coalesce(body, '')) > 0"
    url = "coalesce(nullif(final_url, ''), request_url)"
    return fetches.selectExpr(
        "id", "kind", f"{site_subject(url)} AS subject", f"{http_source(url)} AS source", f"{redact_url('request_url')} AS request_url",
        f"{redact_url('final_url')} AS final_url", f"{redact_headers('headers')} AS headers", "status",
        "substring(sha2(coalesce(body, ''), 256), 1, 32) AS content_hash", "octet_length(coalesce(body, '')) AS byte_length",
        f"{retained} AS body_retained", f"CASE WHEN {retained} THEN body END AS body", "observed_at", "run_id", "elapsed_ms",
    )
