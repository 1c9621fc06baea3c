"""Helpers shared by the operators: stored intermediate tables, skew-safe attaching, byte-bounded Arrow slices."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.functions.rows import attach_by_key
from siteglass.session import shared_folder, stored  # noqa: F401

def importable_by_workers(spark) -> None:
    """Let Python workers import this package from where the driver has it; a cluster may ship it with --py-files instead."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def whole_text(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def attach(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """Left join of `rows` with `keyed` (one row per key; `count` is its number of rows) in which no task gets a heavy key."""
    return attach_by_key(rows, keyed, [key], count, spread)


def set_apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct `others`, so that no name meets one of an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None)).alias("others"))


def put_back(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table that was `set_apart`, in their order."""
    return docs.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"others.`{c}`") for c in columns])


BITS = 22
BUCKET_BITS = 15  # bits of one bitmap value


def _slot(code: Column) -> tuple[Column, Column]:
    slot = code.bitwiseAND((1 << BITS) - 1)
    return F.shiftright(slot, BUCKET_BITS), slot.bitwiseAND((1 << BUCKET_BITS) - 1)


def bitmap_of(codes: DataFrame, code: str) -> DataFrame:
    """A bitmap of 2^22 bits (512 KB, whatever the input's size) with the bits of the hash codes in column `code`."""
    bucket, place = _slot(F.col(code))
    return codes.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))


def with_bit(rows: DataFrame, code: str, bitmap: DataFrame, name: str) -> DataFrame:
    """`rows` with a boolean column: false only if no hash code in the bitmap equals this row's (null: false)."""
    bucket, place = _slot(F.col(code))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place.bitwiseAND(7).cast("int")).bitwiseAND(1)
    marked = rows.withColumn("_bucket", bucket).join(F.broadcast(bitmap), "_bucket", "left")
    return marked.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bits")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows with about `most_bytes` of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def sample_documents(docs: DataFrame, ids: DataFrame, most: int, chars: int) -> list[tuple[int, str]]:
    """(doc_id, text) of at most `most` documents named by column doc_id of `ids`, for fitting a model on the driver.

    The choice is by hash of doc_id, so it depends on no order; ids are chosen first, and only the first `chars`
    characters of the chosen texts are fetched. Both bounds are documented parameters of the models.
    """
    chosen = ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.substring(whole_text(), 1, chars)).alias("text"))
    rows = texts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return [(r.doc_id, r.text) for r in rows]
