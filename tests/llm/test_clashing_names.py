"""Columns whose names the operators use themselves go through the pipeline's stages unchanged; calibration by counted shares."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from siteglass.llm import exact_dedup, trie_join, zstd_quality

NAMES = ["content_hash", "keep_id", "group_size", "kept", "keep", "_place", "_code", "others", "_by_length", "key", "n", "label", "score", "_score", "a.b"]
TEXT = "one two three four five six seven eight nine ten"


def docs(spark):
    rows = [(1, TEXT), (2, TEXT), (3, TEXT + " eleven"), (4, None), (5, ""), (6, "apart from all the others here"), (None, TEXT)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("doc_id", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in NAMES], "text")


def kept(frame):
    rows = frame.collect()
    assert all(r[n] == (None if r.doc_id is None else f"{n}-{r.doc_id}") for r in rows for n in NAMES)
    return sorted((r.doc_id for r in rows), key=str)


def test_exact_copies(spark):
    found = exact_dedup.without_duplicates(docs(spark))
    assert found.columns == docs(spark).columns and kept(found) == [2, 3, 5, 6]


def test_near_copies(spark):
    found = trie_join.one_of_each_component(docs(spark), words=5, percent=80)
    assert found.columns == docs(spark).columns and kept(found) == [1, 4, 5, 6]
    assert trie_join.similarity_components(docs(spark)).count() == 7


def test_quality(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (6, 1)], "doc_id long, quality int")
    found = zstd_quality.good_documents(docs(spark), labels)
    assert found.columns == docs(spark).columns and kept(found) == sorted([1, 2, 3, 4, 5, 6, None], key=str)


def test_calibration_does_not_depend_on_the_sample(spark):
    draw = np.random.default_rng(1)
    words = [["good", "clear", "text", "about", "rivers"], ["$$$", "buy", "now", "%%%", "free"]]
    rows, labels = [], []
    for i in range(1200):
        bad = int(draw.random() < 0.15)
        mixed = draw.choice(words[bad] + words[1 - bad][: 2 + int(draw.random() < 0.4) * 3], 40)
        rows.append((i, " ".join(mixed)))
        labels.append((i, 1 - bad))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    learnt = [q for i, q in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    share = sum(learnt) / len(learnt)
    for sample in (300, 1500):
        model = zstd_quality.fit(frame, marks, sample=sample)
        mean = zstd_quality.with_score(frame.where(zstd_quality.held_out()), model).agg(F.avg("score")).first()[0]
        assert abs(mean - share) < 0.02, (sample, mean, share)
