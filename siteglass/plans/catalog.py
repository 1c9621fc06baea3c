"""Registry of runnable queries: each reads the given tables and has, where SQL can say it, a reference statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteglass.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """The tables of one scale folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` under `name`."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and statements; importing the modules fills the registry."""
    from siteglass.plans import (  # noqa: F401
        answer_queries,
        compare_queries,
        log_queries,
        observer_queries,
        page_queries,
        search_queries,
        site_queries,
        stream_queries,
        structured_queries,
    )

    return QUERIES, SQL
