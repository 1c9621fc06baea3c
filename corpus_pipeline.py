"""From raw documents to packed training sequences, each stage written and read again by the next.

Stage functions take (spark, docs, folder). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteglass.llm.common import importable_by_workers, stored
from siteglass.session import configure


def _prepared(spark: SparkSession) -> None:
    importable_by_workers(configure(spark))


def drop_bad_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the compression classifier rejects go; it learns from the labels' learning fold."""
    from siteglass.llm.zstd_quality import good_documents

    _prepared(spark)
    return good_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    from siteglass.llm.exact_dedup import without_duplicates

    _prepared(spark)
    return without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more stays."""
    from siteglass.llm.trie_join import one_of_each_component

    _prepared(spark)
    return one_of_each_component(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are masked in place; all documents stay."""
    from siteglass.llm.crf_secrets import fit, without_secrets

    _prepared(spark)
    return without_secrets(docs, fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2,048 ids."""
    import public_tokenizers

    from siteglass.llm.best_fit import pack_documents

    _prepared(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_classifier", drop_bad_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

# The classifier, the field and the tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
