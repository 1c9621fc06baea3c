"""Exact duplicates by progressive refinement: length, then a hash of the first characters, then a hash of everything.

Each step counts classes of the rows that survived the step before and keeps the classes with more than one row. Which
rows survive is told to the next scan by a bitmap of the surviving classes, a fixed 512 KB that is broadcast whatever
the input's size: a row outside it cannot have an equal. Texts are never shuffled; the last step, over (id, digest)
rows, alone decides equality, so a shared bit only costs one more digest. DataFrame functions only.

Defined cases: null text equals empty text; of equal texts the largest doc_id stays, a null doc_id ranking below all
others; of rows that repeat a doc_id and its text one stays; an empty table gives no rows; other columns are carried.
`docs` should be a stored table, as rows are told apart by their place in its scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import attach, bitmap_of, put_back, set_apart, stored, whole_text, with_bit

PREFIX = 64


def _in_shared_class(rows: DataFrame, code: Column, survived: Column, name: str) -> DataFrame:
    """`rows` with a boolean column `name`: the row survived so far and shares `code` with another such row, or may."""
    coded = rows.withColumn("_code", F.when(survived, code))
    shared = coded.where("_code IS NOT NULL").groupBy("_code").agg(F.count("*").alias("n")).where("n > 1")
    return with_bit(coded, "_code", bitmap_of(shared, "_code"), name).drop("_code")


def with_content_hash(docs: DataFrame) -> DataFrame:
    """`docs` with _place and content_hash: a digest of the whole text where length and prefix have an equal, else null."""
    text = whole_text()
    rows = docs.withColumn("_place", F.monotonically_increasing_id())
    length = F.octet_length(text)
    rows = _in_shared_class(rows, F.xxhash64(length), F.lit(True), "_by_length")
    rows = _in_shared_class(rows, F.xxhash64(length, F.substring(text, 1, PREFIX)), F.col("_by_length"), "_by_prefix")
    return rows.withColumn("content_hash", F.when(F.col("_by_prefix"), F.sha2(text, 256))).drop("_by_length", "_by_prefix")


def equal_groups(hashed: DataFrame) -> DataFrame:
    """Groups of two rows or more: content_hash, keep (doc_id and place of the row that stays), group_size."""
    return (
        hashed.where("content_hash IS NOT NULL")
        .groupBy("content_hash")
        .agg(F.max(F.struct("doc_id", "_place")).alias("keep"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` of with_content_hash with keep_id, group_size and kept."""
    alone = F.col("group_size").isNull()
    return attach(rows, groups, "content_hash", "group_size", F.col("_place")).select(
        *[c for c in rows.columns if c not in ("_place", "content_hash")],
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep._place") == F.col("_place"))).alias("kept"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    hashed = with_content_hash(docs.select("doc_id", "text"))
    rows = stored(
        hashed.select("doc_id", "_place", "content_hash", F.coalesce("content_hash", F.sha2(whole_text(), 256)).alias("text_sha256")),
        "digests",
    )
    return with_groups(rows, stored(equal_groups(rows), "groups"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their columns, whatever their names."""
    hashed = with_content_hash(set_apart(docs))
    groups = stored(equal_groups(hashed.select("doc_id", "_place", "content_hash")), "groups")
    return put_back(with_groups(hashed, groups).where("kept"), docs.columns)
