"""Scans: page snapshots and the shapes other operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.functions import urls as U

PAGE_SCHEMA = (
    "url string, final_url string, http_status int, redirect_chain array<string>, html string, "
    "click_depth int, blocked_reason string"
)


def page_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Stored crawl output; the explicit schema keeps the scan to the columns a query reads."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


HOST_BUCKETS = 256


def _bucket(host: Column, host_buckets: int) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(host_buckets)).cast("int")


def write_page_snapshot(pages: DataFrame, path: str, host_buckets: int = HOST_BUCKETS) -> None:
    """Store a snapshot partitioned by a hash of the host, so a site query reads one bucket and no bucket is one site's own."""
    bucket = _bucket(F.expr(U.host_of("url")), host_buckets)
    pages.withColumn("host_bucket", bucket).write.mode("append").partitionBy("host_bucket").parquet(path)


def site_snapshot(spark: SparkSession, path: str, host: str, host_buckets: int = HOST_BUCKETS) -> DataFrame:
    """The pages of one host of a stored snapshot: the host's bucket is a partition filter, so no other is read."""
    stored = spark.read.schema(f"{PAGE_SCHEMA}, host_bucket int").parquet(path)
    own = stored.where((F.col("host_bucket") == _bucket(F.lit(host), host_buckets)) & (F.expr(U.host_of("url")) == host))
    return own.drop("host_bucket")


def as_snapshot(pages: DataFrame, status: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bare (url, html) pages as a snapshot: fetched with `status`, no redirects, not blocked; `keep` are columns carried along."""
    return pages.select(
        *keep,
        F.col("url"),
        F.col("url").alias("final_url"),
        F.lit(status).alias("http_status"),
        F.array().cast("array<string>").alias("redirect_chain"),
        F.col("html"),
        F.lit(0).alias("click_depth"),
        F.lit(None).cast("string").alias("blocked_reason"),
    )
