"""Result pages of search engines: item cleaning, deduplication, ranks, positions, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions import text as X
from siteglass.functions import urls as U

# Engines as (id, domain, market group, own properties, results per page).
ENGINES = [
    ("baidu", "baidu.com", "cn", ["baike.baidu.com", "tieba.baidu.com", "zhidao.baidu.com"], 50),
    ("sogou", "sogou.com", "cn", ["baike.sogou.com", "wenwen.sogou.com"], 10),
    ("so360", "so.com", "cn", ["baike.so.com", "wenda.so.com"], 10),
    ("shenma", "sm.cn", "cn", [], 10),
    ("toutiao", "toutiao.com", "cn", [], 10),
    ("google", "google.com", "global", [], 10),
    ("bing", "bing.com", "global", [], 10),
]
WRAPPER_PATH = "^/(link|jump|redirect|transfer|go\\b)"
WRAPPER_QUERY = "(?i)[?&](url|m|to|target|redirect|u)="

# Endings accepted whatever their length.
KNOWN_ENDINGS = [
    "com", "cn", "net", "org", "edu", "gov", "mil", "int", "biz", "info", "name", "top", "xyz", "vip", "club", "shop",
    "site", "online", "store", "app", "tech", "dev", "ai", "io", "co", "me", "tv", "cc", "pro", "ltd", "group", "wiki",
    "hk", "tw", "mo", "jp", "kr", "sg", "my", "th", "vn", "in", "au", "nz", "uk", "us", "ca", "de", "fr", "nl", "it",
    "es", "ru", "ua", "br", "mx",
]


def engine_table(spark) -> DataFrame:
    """The fixed engine dimension (seven rows)."""
    return spark.createDataFrame(ENGINES, "engine string, engine_domain string, market string, own_hosts array<string>, page_size int")


def engine_selection(engines: DataFrame, group: str = "cn", chosen: list[str] | None = None) -> DataFrame:
    """Engines of a group (cn, global, all), or of an explicit list; unknown ids are ignored."""
    if chosen:
        return engines.where(F.col("engine").isin(chosen))
    return engines if group == "all" else engines.where(F.col("market") == group)


def valid_host(domain: str) -> str:
    last = f"lower(substring_index({domain}, '.', -1))"
    return f"(contains({domain}, '.') AND ({last} IN ({X.lits(KNOWN_ENDINGS)}) OR {X.matches(last, '^[a-z]{2,6}$')}))"


def serp_item_clean(items: DataFrame, engines: DataFrame) -> DataFrame:
    """Drop an engine's own results unless they are redirect wrappers, and invalid hosts; mark owned and wrapped items."""
    df = items.join(F.broadcast(engines), "engine").withColumn("domain", F.expr(U.registrable_domain("url")))
    own_host = f"{U.is_url('url')} AND domain = engine_domain"
    wrapped = f"{own_host} AND ({X.matches(f'lower({U.path_of('url')})', WRAPPER_PATH)} OR {X.matches('url', WRAPPER_QUERY)})"
    df = df.withColumn("redirect_wrapper", F.expr(wrapped)).where("domain <> engine_domain OR redirect_wrapper").where(F.expr(valid_host("domain")))
    return df.withColumns(
        {"owned": F.expr("exists(own_hosts, h -> contains(domain, h))"), "resolved": F.expr("NOT redirect_wrapper")}
    ).drop("engine_domain", "market", "own_hosts", "page_size")


def resolved_domains(items: DataFrame, redirects: DataFrame, first: int | None = None) -> DataFrame:
    """Replace wrapped items by their stored redirect target, when it leads to another domain; with `first` only so many of each result page."""
    wrapped = items.where("redirect_wrapper")
    if first is not None:
        order = Window.partitionBy("query", "engine").orderBy("position")
        wrapped = wrapped.withColumn("_n", F.row_number().over(order)).where(f"_n <= {first}")
    targets = redirects.select("url", F.col("final_url")).withColumn("_target_domain", F.expr(U.registrable_domain("final_url")))
    found = wrapped.join(targets, "url").where("_target_domain <> domain")
    found = found.select("query", "engine", "position", "final_url", "_target_domain")
    joined = items.join(found, ["query", "engine", "position"], "left")
    return joined.withColumns(
        {
            "url": F.expr("coalesce(final_url, url)"), "domain": F.expr("coalesce(_target_domain, domain)"),
            "resolved": F.expr("resolved OR final_url IS NOT NULL"),
            "redirect_wrapper": F.expr("redirect_wrapper AND final_url IS NULL"),
        }
    ).drop("final_url", "_target_domain")


def serp_positions(items: DataFrame) -> DataFrame:
    """Absolute position from page number, page size and order within the page."""
    order = Window.partitionBy("query", "engine", "page").orderBy("ordinal")
    return items.withColumn("position", F.col("page") * F.col("page_size") + F.row_number().over(order))


def serp_dedup(items: DataFrame) -> DataFrame:
    """First item per domain within one result page; its position is kept."""
    rest = [c for c in items.columns if c not in ("query", "engine", "domain", "position")]
    best = items.groupBy("query", "engine", "domain").agg(F.min(F.struct("position", *rest)).alias("b"))
    return best.select("query", "engine", "domain", "b.*")


def target_rank(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Best position of each query's target domain per engine, null when absent. targets: query, target."""
    own = targets.select("query", F.expr(U.registrable_domain("target")).alias("target"))
    ranked = items.join(own, "query").groupBy("query", "engine").agg(
        F.expr("min(CASE WHEN domain = target THEN position END)").alias("target_rank"), F.count("*").alias("items")
    )
    return ranked


def rank_summary(pages: DataFrame) -> DataFrame:
    """Per query over engines. pages: query, engine, status, target_rank, items."""
    ok = "status = 'ok'"
    return pages.groupBy("query").agg(
        F.expr(f"count_if({ok})").alias("ok_engines"), F.expr(f"count_if(NOT {ok})").alias("blocked_engines"),
        F.expr(X.half_up_1(f"avg(CASE WHEN {ok} THEN target_rank END)")).alias("average_rank"),
        F.expr(f"min(CASE WHEN {ok} THEN target_rank END)").alias("best_rank"), F.sum("items").alias("total_items"),
    )
