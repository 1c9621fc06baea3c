"""Observations of every kind from the tables that hold their results, and answers read back from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import urls as U
from siteglass.operators import observations as O
from siteglass.session import cut_lineage

RECORD = (
    "query string, model string, mentioned boolean, citations array<struct<url:string,title:string,position:int>>, "
    "citations_status string, competitors_mentioned array<string>"
)


def rank_observations(pages: DataFrame) -> DataFrame:
    """One per result page. pages: site, query, engine, status (of the collector), target_rank, items, observed_at."""
    rows = pages.withColumns({"targetRank": F.col("target_rank"), "status": F.expr(O.COLLECTOR_STATUS)})
    return O.build_observations(
        rows, "rank", O.search_subject("site", "query"), "concat('search-engine:', engine)", "status", ["query", "engine", "targetRank", "items"]
    )


def answer_observations(answers: DataFrame) -> DataFrame:
    """One per answer. answers: provider, status and the columns of RECORD, observed_at."""
    fields = ["query", "model", "mentioned", "citations", "citations_status", "competitors_mentioned"]
    return O.build_observations(answers, "ai_mention", O.answer_subject("provider", "model"), "concat('provider:', provider)", "status", fields)


def answer_records(log: DataFrame) -> DataFrame:
    """The answers of a log's mention observations, as they were before they were stored."""
    rows = log.where("type = 'ai_mention'").select("observed_at", F.from_json("result", RECORD).alias("r"))
    return rows.select("observed_at", "r.*")


def robots_observations(protocol: DataFrame) -> DataFrame:
    """One per site. protocol: site, openness, blocked, http_status, observed_at."""
    return O.build_observations(
        protocol, "robots_policy", O.site_subject("site"), O.http_source("site"), O.protocol_status("http_status"), ["openness", "blocked"]
    )


def guide_observations(guides: DataFrame) -> DataFrame:
    """One per site. guides: site, guide_exists, score, failed_items, http_status, observed_at."""
    return O.build_observations(
        guides, "llms_txt", O.site_subject("site"), O.http_source("site"), O.protocol_status("http_status"), ["guide_exists", "score", "failed_items"]
    )


def vital_observations(overall: DataFrame, status: str = "'OBSERVED'") -> DataFrame:
    """One per target. overall: target, overall, poor, needs_improvement, observed_at."""
    return O.build_observations(
        overall, "performance", O.site_subject("target"), O.http_source("target"), status, ["overall", "poor", "needs_improvement"]
    )


def search_observations(totals: DataFrame, status: str = "'OBSERVED'") -> DataFrame:
    """One per page of a search property. totals: key (URL), clicks, impressions, ctr, position, observed_at."""
    return O.build_observations(
        totals, "gsc", O.site_subject("key"), f"concat('gsc:', {U.origin_of('key')})", status, ["clicks", "impressions", "ctr", "position"]
    )


def stored_halves(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers before and now, both written to the form of the log and read back."""
    written = cut_lineage(answer_observations(previous).withColumn("now", F.lit(False)).unionByName(answer_observations(current).withColumn("now", F.lit(True))))
    return answer_records(written.where("NOT now")), answer_records(written.where("now"))
