"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteglass.llm.common import importable_by_workers
from siteglass.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register a function of (table, spark, folder)."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            importable_by_workers(configure(spark))
            return build(spark.read.parquet(f"{folder}/{table}.parquet"), spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op2_exact_dedup",
    sql="""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op2_exact_dedup(docs, spark, folder):
    from siteglass.llm.exact_dedup import exact_duplicates

    return exact_duplicates(docs)


@query("op6_best_fit_packing")
def op6_best_fit_packing(docs, spark, folder):
    from siteglass.llm.best_fit import pack_documents

    return pack_documents(docs, _vocabulary("byte_bpe_50k.json"), end_id=0)


@query("op10_length_histogram")
def op10_length_histogram(docs, spark, folder):
    from siteglass.llm.length_histogram import length_histogram

    return length_histogram(docs, _vocabulary("byte_bpe_50k.json"))


@query("op8_prefix_bpe")
def op8_prefix_bpe(docs, spark, folder):
    import public_tokenizers

    from siteglass.llm.bpe_prefix import encode_and_decode

    return encode_and_decode(docs, _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_repair_shards")
def op1_repair_shards(docs, spark, folder):
    from siteglass.llm.repair import encode_to_files

    return encode_to_files(docs, _vocabulary("word_bpe_49k.json"), end_id=1)


@query("op3_trie_jaccard")
def op3_trie_jaccard(docs, spark, folder):
    from siteglass.llm.trie_join import similarity_components

    return similarity_components(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op5_zstd_quality")
def op5_zstd_quality(docs, spark, folder):
    from siteglass.llm.zstd_quality import quality_scores

    return quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet"))


@query("op7_license_index")
def op7_license_index(docs, spark, folder):
    from siteglass.llm.license_index import license_labels

    return license_labels(docs)


@query("op9_rp_forest", table="embeddings")
def op9_rp_forest(vectors, spark, folder):
    from siteglass.llm.rp_forest import nearest

    return nearest(vectors, every=20, k=20)


@query("op4_crf_secrets")
def op4_crf_secrets(docs, spark, folder):
    from siteglass.llm.crf_secrets import scan_secrets

    return scan_secrets(docs)


@query("op11_kneser_ney_toxicity")
def op11_kneser_ney_toxicity(docs, spark, folder):
    from siteglass.llm.toxic_kneser_ney import toxicity_scores

    return toxicity_scores(docs, spark.read.parquet(f"{folder}/labels.parquet"))


@query(
    "op12_bond_hard_negatives",
    table="embeddings",
    sql="""
    WITH whole AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), scores AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
               CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 3""",
)
def op12_bond_hard_negatives(vectors, spark, folder):
    from pyspark.sql import functions as F

    from siteglass.llm.bond import hard_negatives

    return hard_negatives(vectors, F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))


@query("op13_shifted_cholesky_whitening", table="embeddings")
def op13_shifted_cholesky_whitening(vectors, spark, folder):
    from siteglass.llm.shifted_qr import whiten

    return whiten(vectors)
