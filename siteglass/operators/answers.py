"""AI answers: signal, status, citations, mentions, visibility and citation changes.

Answers carry query, model, answer, http_status, brand, competitors, observed_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import attach_written, explode_rows
from siteglass.functions.text import Sql, each, let

# Patterns of refusals, links and domains.
REFUSALS = [
    "我(?:暂时)?(?:无法|不能|没办法)(?:提供|回答|推荐|给出|确认|确定|访问|获取|联网|查询)",
    "(?:暂时)?(?:无法|不能)(?:提供|回答|推荐|给出|确定|访问|获取)",
    "(?:抱歉|对不起|不好意思)[，,、]?\\s*我(?:无法|不能|没有|也不)",
    "没有(?:相关|足够|任何)(?:的)?(?:信息|资料|数据|内容)",
    "(?i)(?:cannot|can't|unable to|not able to)\\s+(?:provide|answer|recommend|access|assist|help)",
    "(?i)(?:i'?m sorry|sorry)[,.]?\\s*(?:but\\s+)?i\\s+(?:can'?t|cannot|am unable|am not able)",
]
SHORT_ANSWER = 12
MARKDOWN_LINK = "\\[([^\\]]+)\\]\\((https?://[^\\s)]+)\\)"
BARE_LINK = "(?:https?://|www\\.)[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+(?:/[^\\s)\\]>]*)?"
LINK_HOST = "https?://([a-zA-Z0-9.-]+)"
BARE_DOMAIN = "(?i)\\b([a-z0-9-]+\\.(?:com|cn|net|org|com\\.cn|io|dev|ai|so|hk))\\b"
BLOCKED_STATUS = "(401, 402, 403, 429)"
USABLE = "citations_status IN ('ok', 'OBSERVED')"


def signal(text: Sql) -> Sql:
    """empty, too_short, refusal, or null for a usable answer."""
    refusal = " OR ".join(X.matches("{t}", p) for p in REFUSALS)
    return let(
        X.trim_blank(f"coalesce({text}, '')"),
        lambda t: f"CASE WHEN {t} = '' THEN 'empty' WHEN length({t}) < {SHORT_ANSWER} THEN 'too_short' "
        f"WHEN {refusal.replace('{t}', t)} THEN 'refusal' END",
    )


def answer_signal(answers: DataFrame) -> DataFrame:
    return answers.withColumn("low_signal", F.expr(signal("answer")))


def answer_status(answers: DataFrame) -> DataFrame:
    """Add `status`. A null http_status means no call was made; a null answer with 200 cannot be parsed."""
    mentioned = "brand <> '' AND contains(lower(answer), lower(brand))"
    status = (
        "CASE WHEN http_status IS NULL THEN 'UNOBSERVABLE' WHEN http_status = 0 THEN 'ERROR' "
        f"WHEN http_status IN {BLOCKED_STATUS} THEN 'BLOCKED' WHEN http_status NOT BETWEEN 200 AND 299 THEN 'ERROR' "
        "WHEN coalesce(answer, '') = '' THEN 'UNOBSERVABLE' WHEN low_signal IS NOT NULL THEN 'INDETERMINATE' "
        f"WHEN {mentioned} THEN 'MENTIONED' ELSE 'NOT_MENTIONED' END"
    )
    return answer_signal(answers).withColumn("status", F.expr(status))


def mention_context(answers: DataFrame) -> DataFrame:
    """Up to 50 characters either side of the first mention, line breaks as blanks."""
    def cut(at: Sql) -> Sql:
        start = f"greatest({at} - 50, 1)"
        return f"CASE WHEN {at} > 0 THEN replace(substring(answer, {start}, {at} - {start} + length(brand) + 50), '\\n', ' ') END"

    found = answers.where("contains(lower(answer), lower(brand))")
    return found.withColumn("context", F.expr(let("instr(lower(answer), lower(brand))", cut)))


def competitors_mentioned(answers: DataFrame) -> DataFrame:
    return answers.withColumn(
        "competitors_mentioned", F.expr("filter(competitors, c -> contains(lower(answer), lower(c)))")
    )


def _trimmed(url: Sql) -> Sql:
    fixed = f"CASE WHEN startswith({url}, 'www.') THEN concat('https://', {url}) ELSE {url} END"
    for ending in (")", "]", ".", "。"):
        fixed = let(fixed, lambda u, e=ending: f"CASE WHEN endswith({u}, '{e}') THEN left({u}, length({u}) - 1) ELSE {u} END")
    return fixed


def with_citations(answers: DataFrame) -> DataFrame:
    """Add `citations`: distinct URLs, markdown links first, with title and character offset; and `citations_status`."""

    def located(pattern: str, entry) -> Sql:
        # Offsets come from the lengths of the pieces between matches, so repeated links keep their own place.
        found, gaps = X.extract_all("answer", pattern), f"split(answer, {X.lit(pattern)}, -1)"
        at = (
            "aggregate(slice(g, 1, i + 1), 0, (acc, p) -> acc + length(p)) + aggregate(slice(m, 1, i), 0, (acc, p) -> acc + length(p))"
        )
        rows = f"transform(x.m, (u, i) -> {entry('u', at.replace('slice(g', 'slice(x.g').replace('slice(m', 'slice(x.m'))})"
        return f"element_at(transform(array(named_struct('m', {found}, 'g', {gaps})), x -> {rows}), 1)"

    linked = located(
        MARKDOWN_LINK,
        lambda u, at: f"named_struct('url', {X.extract(u, MARKDOWN_LINK, 2)}, 'title', {X.extract(u, MARKDOWN_LINK, 1)}, 'position', {at})",
    )
    bare = located(BARE_LINK, lambda u, at: f"named_struct('url', {_trimmed(u)}, 'title', cast(NULL AS string), 'position', {at})")
    df = answers.withColumn("_cited", F.expr(f"coalesce(concat({linked}, {bare}), array())"))
    first = "filter(transform(_cited, (c, i) -> CASE WHEN NOT exists(slice(_cited, 1, i), o -> o.url = c.url) THEN c END), c -> c IS NOT NULL)"
    # Who asks for the status alone does not have the links listed.
    linked = f"coalesce({X.matches('answer', MARKDOWN_LINK)} OR {X.matches('answer', BARE_LINK)}, false)"
    return df.withColumn("citations", F.expr(first)).withColumn(
        "citations_status", F.expr(f"CASE WHEN {linked} THEN 'ok' ELSE 'unavailable' END")
    ).drop("_cited")


def answer_citations(cited: DataFrame, *keys: str) -> DataFrame:
    rows = explode_rows(cited, "citations", "c", *keys, position="ordinal")
    return rows.select(*keys, "ordinal", "c.url", "c.title", "c.position")


def answer_domains(answers: DataFrame, *keys: str) -> DataFrame:
    """Hosts of links (without www.) and bare domains named in an answer, once each."""
    hosts = each(X.extract_all("answer", LINK_HOST, 1), lambda h: X.replaced(h, "^www\\.", ""))
    bare = each(X.extract_all("answer", BARE_DOMAIN, 1), lambda d: f"lower({d})")
    return explode_rows(answers, f"array_union({hosts}, {bare})", "domain", *keys)


STATUS_COUNTS = {
    "attempted": "true",
    "successful": "status IN ('MENTIONED', 'NOT_MENTIONED', 'INDETERMINATE')",
    "determinable": "status IN ('MENTIONED', 'NOT_MENTIONED')",
    "indeterminate": "status = 'INDETERMINATE'",
    "mentioned": "status = 'MENTIONED'",
    "not_mentioned": "status = 'NOT_MENTIONED'",
    "blocked": "status = 'BLOCKED'",
    "error": "status = 'ERROR'",
    "unobservable": "status = 'UNOBSERVABLE'",
}


def status_summary(statuses: DataFrame, *by: str) -> DataFrame:
    return statuses.groupBy(*by).agg(*[F.expr(f"count_if({c})").alias(n) for n, c in STATUS_COUNTS.items()])


def visibility_score(summary: DataFrame) -> DataFrame:
    """Mentioned share of determinable answers, 0-100; 0 when none is determinable."""
    score = f"CASE WHEN determinable = 0 THEN 0 ELSE {X.half_up('mentioned / determinable * 100')} END"
    return summary.withColumn("visibility_score", F.expr(score))


def visibility_report(statuses: DataFrame, *by: str) -> DataFrame:
    """Configured, observed, failed and unobservable answers with the score, per brand and topic."""
    return visibility_score(status_summary(statuses, *by)).selectExpr(
        *by, "attempted - unobservable AS configured", "determinable AS observed", "mentioned", "blocked + error AS failed",
        "unobservable", "visibility_score",
    )


def top_cited_domains(domains: DataFrame, k: int = 10) -> DataFrame:
    return domains.groupBy("domain").agg(F.count("*").alias("answers")).orderBy(F.desc("answers"), "domain").limit(k)


def domain_ranking(cited: DataFrame) -> DataFrame:
    """Usable records citing each registrable domain, once per record."""
    domains = f"array_distinct(filter({each('citations', lambda c: U.registrable_domain(f'{c}.url'))}, d -> d <> ''))"
    rows = explode_rows(cited.where(USABLE), domains, "domain")
    return rows.groupBy("domain").agg(F.count("*").alias("records"))


def competitor_frequency(records: DataFrame) -> DataFrame:
    rows = explode_rows(records.where(USABLE), "competitors_mentioned", "competitor")
    return rows.groupBy("competitor").agg(F.count("*").alias("records"))


def citation_gap(ranking: DataFrame, own_domain: str) -> DataFrame:
    """Domains cited by at least two records, the own one left out."""
    return ranking.where("records >= 2").where(F.expr(f"domain <> {U.registrable_domain(X.lit(own_domain))}"))


#: Rows of one query and model up to which they are one block of time, and the blocks that a busier one is cut into.
ONE_BLOCK = 100_000
BLOCKS = 256


def citation_diff(previous: DataFrame, current: DataFrame, one_block: int = ONE_BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """Each current record against the latest earlier stored record of the same query and model.

    The as-of lookup is a window per (query, model, block of time). The blocks of a busy key are cut at quantiles of its own
    times, so they hold about as many rows each whatever the days; the last stored record of earlier blocks is carried in
    from one row per block.
    """
    keep = ["query", "model", "observed_at", "mentioned", "citations", "citations_status"]
    record = F.struct("observed_at", "mentioned", "citations", "citations_status")
    both = previous.select(*keep).withColumn("_cur", F.lit(False)).unionByName(current.select(*keep).withColumn("_cur", F.lit(True)))
    both = both.withColumns({"_us": F.unix_micros("observed_at"), "_stored": F.when(~F.col("_cur"), record)})
    key = ["query", "model"]
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    busy = both.groupBy(*key).agg(F.count("*").alias("_rows"), F.percentile_approx("_us", shares, 10 * blocks).alias("_cuts"))
    both = attach_written(both, busy.where(F.col("_rows") > one_block).drop("_rows"), key)
    both = both.withColumn("_block", F.expr("coalesce(size(filter(_cuts, c -> c <= _us)), 0)")).drop("_cuts")
    within = Window.partitionBy(*key, "_block").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    per_block = both.groupBy(*key, "_block").agg(F.max_by("_stored", F.when(~F.col("_cur"), F.col("_us"))).alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select(*key, "_block", "_carried")
    same_block = both.withColumn("_prev", F.last("_stored", ignorenulls=True).over(within)).where("_cur")
    joined = attach_written(same_block, carried, [*key, "_block"], "inner").withColumn("_prev", F.coalesce("_prev", "_carried"))
    mention = (
        "CASE WHEN _prev IS NULL THEN NULL WHEN _prev.mentioned = mentioned THEN 'unchanged' WHEN mentioned THEN 'added' ELSE 'lost' END"
    )
    urls = lambda c: f"transform({c}, c -> c.url)"
    missing = "cast(array() AS array<string>)"
    return joined.selectExpr(
        *key, "observed_at", "_prev IS NOT NULL AS has_previous", f"{mention} AS mention",
        f"coalesce(array_except({urls('citations')}, {urls('_prev.citations')}), {missing}) AS citations_added",
        f"coalesce(array_except({urls('_prev.citations')}, {urls('citations')}), {missing}) AS citations_lost",
        "_prev.citations_status AS prev_citations_status", "citations_status",
    )


def citation_report(previous: DataFrame, current: DataFrame, own_domain: str) -> DataFrame:
    """Long report: domain ranking, gaps, competitor mentions, and changes against the latest stored records."""
    ranking = domain_ranking(current)
    part = lambda df, name, key, value: df.selectExpr(f"'{name}' AS section", f"{key} AS item", f"{value} AS records")
    changes = citation_diff(previous, current).groupBy("mention").agg(F.count("*").alias("n"))
    return (
        part(ranking, "domain", "domain", "records")
        .unionByName(part(citation_gap(ranking, own_domain), "gap", "domain", "records"))
        .unionByName(part(competitor_frequency(current), "competitor", "competitor", "records"))
        .unionByName(part(changes, "change", "coalesce(mention, 'no history')", "n"))
    )


def model_drift(answers: DataFrame) -> DataFrame:
    """Whether the served model differs from the requested one."""
    return answers.withColumn("drift", F.expr("coalesce(served_model <> '' AND served_model <> model, false)"))
