"""Exact histogram of encoded lengths, and the totals, quantiles and truncated totals that its suffix sums give.

Each task encodes its documents and adds up (length, documents) pairs per batch, so the shuffle carries one row per
distinct length and task, however many documents share a length. Suffix sums run within blocks of lengths and over
block totals, so no task orders all lengths.

Defined cases: null and empty texts have length 0; repeated rows count each; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.llm.common import slices, whole_text
from siteglass.llm.subword import encoder

BLOCK = 1024


def length_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(length, docs): how many documents encode to each number of ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, bounds = encoder(tokenizer).encode(part.column("text"))
                lengths, docs = np.unique(np.diff(bounds), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(docs, pa.int64())], names=["length", "docs"])

    partial = docs.select(whole_text().alias("text")).mapInArrow(count, "length long, docs long")
    return partial.groupBy("length").agg(F.sum("docs").alias("docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Per length: documents and ids at least this long, all documents and ids, and the ids left if texts are cut here."""
    rows = counts.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.expr(f"length div {BLOCK}").alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    return rows.join(blocks, "block").select(
        "length",
        "docs",
        "tokens",
        (F.sum("docs").over(inside) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("later_tokens")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    ).withColumn(
        "truncated_tokens", F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    )


def limit_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: all ids, ids left after cutting, documents cut and ids lost; one pass, any limit."""
    cut = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.sum("tokens").alias("all_tokens"),
            F.sum(F.least("length", F.lit(limit)) * F.col("docs")).alias("truncated_tokens"),
            F.sum(F.when(F.col("length") > limit, F.col("docs")).otherwise(0)).alias("docs_cut"),
        ).alias(f"limit_{limit}")
        for limit in limits
    ]
    return histogram.agg(F.array(*cut).alias("totals")).select(F.inline("totals"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length that at least this share of the documents does not exceed."""
    up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("docs")
    found = [
        F.struct(F.lit(share).alias("share"), F.min(F.when(up_to >= F.lit(share) * F.col("all_docs"), F.col("length"))).alias("length"))
        for share in shares
    ]
    return histogram.agg(F.array(*found).alias("found")).select(F.inline("found"))


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The histogram of all documents with its suffix sums."""
    return with_suffix_sums(length_counts(docs, tokenizer))
