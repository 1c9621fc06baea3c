"""Findings from checks, severity counts, protocol findings and regression gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Check id to issue ids (when the value is empty / when the check failed / otherwise) and fix id.
FINDING_RULES = [
    # check, issue when failed, issue when value empty, issue otherwise, fix
    ("fetch", "fetch/unreachable", None, "fetch/unreachable", None),
    ("http", "http/error", None, "http/redirect", None),
    ("title", None, "title/missing", "title/length", None),
    ("desc", None, "desc/missing", "desc/length", None),
    ("canonical", None, None, "canonical/missing", "canonical"),
    ("robots", None, None, "robots/noindex", None),
    ("h1", None, None, "h1/structure", None),
    ("alt", "alt/mostly-missing", None, "alt/partly-missing", "alt-empty"),
    ("viewport", None, None, "viewport/missing", "viewport"),
    ("lang", None, None, "lang/missing", "lang"),
    ("jsonld", None, None, "jsonld/missing", None),
    ("og", None, None, "og/incomplete", "og-skeleton"),
]

# Crawlers that must not be blocked.
MUST_ALLOW = ["GPTBot", "ClaudeBot", "PerplexityBot"]


@dataclass(frozen=True)
class GateLimits:
    max_drop: int = 5
    geo_floor: int = 40
    max_new_blockers: int = 0
    max_new_majors: int = 2


def severity_of(level: Column, weight: Column) -> Column:
    return F.when(weight >= 100, "blocker").when(level == "fail", "major").otherwise("minor")


def findings(checks: DataFrame) -> DataFrame:
    """Non-passing checks as issues, with the automatic fix where one exists."""
    issue = fix = None
    for check, failed, empty, other, fix_id in FINDING_RULES:
        here = F.col("check_id") == check
        name = F.lit(other)
        if empty:
            name = F.when(F.col("value") == "", empty).otherwise(name)
        if failed:
            name = F.when(F.col("level") == "fail", failed).otherwise(name)
        issue = F.when(here, name) if issue is None else issue.when(here, name)
        fix = F.when(here, F.lit(fix_id)) if fix is None else fix.when(here, F.lit(fix_id))
    issue = issue.otherwise(F.concat_ws("/", "check_id", "level"))
    return checks.where(F.col("level") != "pass").select(
        "url", "check_id", issue.alias("issue_id"),
        severity_of(F.col("level"), F.col("weight")).alias("severity"), fix.alias("fix_id"),
    )


def finding_severity(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocker, major and minor counts per page; failing means any blocker or major."""

    def count(level: str) -> Column:
        return F.count_if(F.col("severity") == level)

    counted = found.groupBy("url").agg(
        count("blocker").alias("blockers"), count("major").alias("majors"), count("minor").alias("minors")
    )
    zero = F.lit(0).cast("bigint")
    counts = [F.coalesce(F.col(n), zero).alias(n) for n in ("blockers", "majors", "minors")]
    return (
        pages.select("url").distinct().join(counted, "url", "left").select("url", *counts)
        .withColumn("failing", (F.col("blockers") > 0) | (F.col("majors") > 0))
    )


def fixable_rollup(found: DataFrame) -> DataFrame:
    """Per automatic fix: findings it covers and pages it touches."""
    return found.where(F.col("fix_id").isNotNull()).groupBy("fix_id").agg(
        F.count("*").alias("findings"), F.count_distinct("url").alias("pages")
    )


def protocol_findings(protocol: DataFrame) -> DataFrame:
    """Issues of a site's robots and guide files.

    Input: site, robots_exists, blocked (array of agents), guide_exists, guide_fails.
    """
    blocked = F.filter("blocked", lambda a: a.isin(MUST_ALLOW))
    robots = F.when(F.size(blocked) > 0, F.struct(F.lit("robots/ai-blocked").alias("i"), F.lit("major").alias("s"))).when(
        ~F.col("robots_exists"), F.struct(F.lit("robots/missing").alias("i"), F.lit("minor").alias("s"))
    )
    guide = F.when(~F.col("guide_exists"), F.struct(F.lit("llms/missing").alias("i"), F.lit("minor").alias("s"))).when(
        F.col("guide_fails") > 0, F.struct(F.lit("llms/invalid").alias("i"), F.lit("minor").alias("s"))
    )
    issues = F.filter(F.array(robots, guide), lambda x: x.isNotNull())
    return protocol.select("site", F.explode(issues).alias("x")).select(
        "site", F.col("x.i").alias("issue_id"), F.col("x.s").alias("severity")
    )


def regression_gate(
    scores: DataFrame, found: DataFrame, base_scores: DataFrame, base_found: DataFrame, limits: GateLimits = GateLimits(), part: str | None = None
) -> DataFrame:
    """Pass or fail per subject against its baseline.

    scores: subject, seo_score, geo_score; found: subject, issue_id, severity.
    A subject without a baseline is only held to the score floor. With `part`, a column of both scores that tells the
    pages of a subject apart, every page is held to its own scores and to the findings of its subject.
    """
    keys = ["subject"] if part is None else ["subject", part]
    base_issues = base_found.select("subject", "issue_id").distinct()
    new = (
        found.join(base_issues, ["subject", "issue_id"], "left_anti")
        .groupBy("subject")
        .agg(
            F.count_if(F.col("severity") == "blocker").alias("new_blockers"),
            F.count_if(F.col("severity") == "major").alias("new_majors"),
        )
    )
    base = base_scores.select(
        *keys, F.col("seo_score").alias("base_seo"), F.col("geo_score").alias("base_geo"), F.lit(True).alias("has_base")
    )
    joined = scores.join(base, keys, "left").join(new, "subject", "left")
    known = F.coalesce(F.col("has_base"), F.lit(False))
    zero = F.lit(0).cast("bigint")

    def if_base(value: Column) -> Column:
        return F.when(known, value)

    joined = joined.select(
        *keys,
        known.alias("has_baseline"),
        if_base(F.col("seo_score") - F.col("base_seo")).alias("seo_delta"),
        if_base(F.col("geo_score") - F.col("base_geo")).alias("geo_delta"),
        if_base(F.coalesce(F.col("new_blockers"), zero)).alias("new_blockers"),
        if_base(F.coalesce(F.col("new_majors"), zero)).alias("new_majors"),
        F.col("geo_score"),
    )
    reasons = F.array(
        F.when(F.col("geo_score") < limits.geo_floor, "geo-floor"),
        F.when(F.col("new_blockers") > limits.max_new_blockers, "new-blockers"),
        F.when(F.col("new_majors") > limits.max_new_majors, "new-majors"),
        F.when(-F.col("geo_delta") > limits.max_drop, "geo-drop"),
        F.when(-F.col("seo_delta") > limits.max_drop, "seo-drop"),
    )
    return joined.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).withColumn(
        "decision", F.when(F.size("reasons") > 0, "fail").otherwise("pass")
    )


def history_gate(summary: DataFrame) -> DataFrame:
    """Fail when the latest comparable pair got worse anywhere; incomparable pairs pass with a reason.

    Input: identity_key, has_previous, comparable, degraded.
    """
    worse = F.col("comparable") & (F.col("degraded") > 0)
    return summary.select(
        "identity_key",
        F.when(worse, "fail").otherwise("pass").alias("decision"),
        F.when(worse, "degraded").when(~F.col("comparable"), "incomparable").otherwise("none").alias("reason"),
    )
