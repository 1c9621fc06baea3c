"""Search-performance rows: opportunities, period changes, totals and roll-ups.

Rows carry keys (array), clicks, impressions, ctr, position.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import urls as U


@dataclass(frozen=True)
class SearchLimits:
    low_ctr_impressions: int = 100
    low_ctr: float = 0.02
    rank_from: float = 4
    rank_to: float = 20
    rank_impressions: int = 50
    diff_impressions: int = 20
    diff_rank: float = 3
    diff_clicks: int = 10


DEFAULTS = SearchLimits()
MEASURES = ["clicks", "impressions", "ctr", "position"]
KEY = "array_join(keys, ' | ')"


def _kind(rows: DataFrame, kind: str, key: str = KEY) -> DataFrame:
    return rows.selectExpr(f"'{kind}' AS kind", f"{key} AS key", *MEASURES)


def high_impression_low_ctr(rows: DataFrame, limits: SearchLimits = DEFAULTS) -> DataFrame:
    return _kind(rows.where(f"impressions >= {limits.low_ctr_impressions} AND ctr < {limits.low_ctr}D"), "high-impression-low-ctr")


def ranking_opportunity(rows: DataFrame, limits: SearchLimits = DEFAULTS) -> DataFrame:
    found = rows.where(f"position BETWEEN {limits.rank_from} AND {limits.rank_to} AND impressions >= {limits.rank_impressions}")
    return _kind(found, "ranking-opportunity")


def content_gap(rows: DataFrame, crawled: DataFrame) -> DataFrame:
    """Searched URLs that no crawled page matches, compared without query, fragment and trailing slash."""
    known = crawled.select(F.expr(U.gap_url("url")).alias("_gap")).distinct()
    shown = rows.where("size(keys) > 0 AND impressions > 0").withColumn("_gap", F.expr(U.gap_url("get(keys, 0)")))
    return _kind(shown.join(known, "_gap", "left_anti"), "content-gap", "get(keys, 0)")


def search_opportunities(rows: DataFrame, crawled: DataFrame | None = None, limits: SearchLimits = DEFAULTS) -> DataFrame:
    out = high_impression_low_ctr(rows, limits).unionByName(ranking_opportunity(rows, limits))
    return out if crawled is None else out.unionByName(content_gap(rows, crawled))


def opportunity_counts(opportunities: DataFrame) -> DataFrame:
    """One row with the count of each kind, zero included."""
    kinds = {"high_impression_low_ctr": "high-impression-low-ctr", "ranking_opportunity": "ranking-opportunity", "content_gap": "content-gap"}
    return opportunities.agg(*[F.expr(f"count_if(kind = '{k}')").alias(n) for n, k in kinds.items()])


def period_diff(before: DataFrame, after: DataFrame, limits: SearchLimits = DEFAULTS) -> DataFrame:
    """Keys improved, declined, new or lost between two periods; small or steady keys are left out."""
    a = before.selectExpr(f"{KEY} AS key", "clicks AS c0", "impressions AS i0", "position AS p0", "true AS _a")
    b = after.selectExpr(f"{KEY} AS key", "clicks AS c1", "impressions AS i1", "position AS p1", "true AS _b")
    change = (
        f"CASE WHEN _a IS NULL THEN 'new' WHEN _b IS NULL THEN 'lost' "
        f"WHEN i0 < {limits.diff_impressions} AND i1 < {limits.diff_impressions} THEN NULL "
        f"WHEN p1 - p0 <= -{limits.diff_rank} OR c1 - c0 >= {limits.diff_clicks} THEN 'improved' "
        f"WHEN p1 - p0 >= {limits.diff_rank} OR c1 - c0 <= -{limits.diff_clicks} THEN 'declined' END"
    )
    joined = a.join(b, "key", "full_outer").selectExpr(
        "key", f"{change} AS change", "c1 - c0 AS clicks_delta", "i1 - i0 AS impressions_delta", "p1 - p0 AS position_delta"
    )
    return joined.where("change IS NOT NULL")


def by_impact(diff: DataFrame) -> DataFrame:
    return diff.orderBy(F.desc(F.abs("clicks_delta")), F.desc(F.abs("impressions_delta")), "key")


def search_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Clicks, impressions, click rate and impression-weighted position."""
    summed = rows.groupBy(*by).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.sum(F.col("position") * F.col("impressions")).alias("_weighted"),
    )
    return summed.selectExpr(
        *by, "coalesce(clicks, 0) AS clicks", "coalesce(impressions, 0) AS impressions",
        "CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0D END AS ctr",
        "CASE WHEN impressions > 0 THEN _weighted / impressions ELSE 0D END AS position",
    )


def top_search_rows(rows: DataFrame, k: int = 100) -> DataFrame:
    """The k rows with most impressions; ties by key."""
    return rows.withColumn("key", F.expr(KEY)).orderBy(F.desc("impressions"), "key").limit(k).select("key", *MEASURES)


def search_rollup(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Totals per chosen dimensions (query by default)."""
    return search_totals(rows, *(dimensions or ("query",)))


def search_rollups(rows: DataFrame, dimensions: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """Totals of several sets of dimensions in one pass; `level` is the grouping id, a bit per dimension that is summed over."""
    grouped = rows.groupingSets([[F.col(c) for c in chosen] for chosen in sets], *[F.col(c) for c in dimensions]).agg(
        F.grouping_id(*dimensions).alias("level"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.sum(F.col("position") * F.col("impressions")).alias("_weighted"),
    )
    return grouped.selectExpr(
        *dimensions, "level", "coalesce(clicks, 0) AS clicks", "coalesce(impressions, 0) AS impressions",
        "CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0D END AS ctr",
        "CASE WHEN impressions > 0 THEN _weighted / impressions ELSE 0D END AS position",
    )


def default_period(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """The last 28 days including today."""
    return as_of - dt.timedelta(days=27), as_of
