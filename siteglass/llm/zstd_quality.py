"""Quality score from compression: one zstandard dictionary of good text, one of bad, and which of them compresses better.

Texts are compressed in short runs of bytes, whole texts, with either dictionary; the normalised difference of the two
sizes is turned into a probability by a logistic curve. Labels come only from the learning fold, from a bounded sample
per class: one half trains the dictionaries, the other half fits the curve, in which each class weighs its share of all
labels. Scoring is row-local.

Defined cases: null and empty texts have difference 0 and get the curve's value there; rows without doc_id are never
held out; labels other than 0 and 1, and labels of unknown documents, are ignored; with no label of one class every
score is the share of good labels (one half without labels); repeated rows get equal scores; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siteglass.llm.common import put_back, sample_documents, set_apart, slices, whole_text

SAMPLE_DOCS = 1500  # labelled documents of each class at most
SAMPLE_CHARS = 16_384  # of each
SAMPLE_RUN = 256
DICTIONARY_BYTES = 64 << 10
TRAINING_BYTES = 1 << 20
RUN = 512
LEVEL = 3


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def build_dictionary(texts: list[str], run: int = SAMPLE_RUN) -> bytes:
    """A trained dictionary over runs of the texts, taken round by round; too little text is used as it is."""
    data = [t.encode() for t in texts]
    runs, size, at = [], 0, 0
    while size < TRAINING_BYTES and any(len(d) > at for d in data):
        for d in data:
            if len(d) > at and size < TRAINING_BYTES:
                runs.append(d[at : at + run])
                size += len(runs[-1])
        at += run
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, size // 8)), runs, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(runs)[-DICTIONARY_BYTES:]


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    slope: float
    bias: float


@lru_cache(maxsize=4)
def _compressors(bad: bytes, good: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    made = []
    for content in (bad, good):
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        made.append(
            zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
        )
    return tuple(made)


def size_difference(text: str, bad: bytes, good: bytes) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / both; above 0 for text like the good sample."""
    data = text.encode()
    if not data:
        return 0.0
    by_bad, by_good = _compressors(bad, good)
    with_bad = with_good = 0
    for at in range(0, len(data), RUN):
        part = data[at : at + RUN]
        with_bad += len(by_bad.compress(part))
        with_good += len(by_good.compress(part))
    return (with_bad - with_good) / (with_bad + with_good)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the curve for weighted cases, by Newton's method with a slight pull to 0 (so separable classes end too)."""
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    weights = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -40, 40)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        weights -= np.linalg.solve(hessian, design.T @ (weight * (p - y)) + 1e-2 * weights)
    return float(weights[0] / scale), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Dictionaries and curve from the learning fold of `labels` (doc_id, quality)."""
    learn = labels.where(~held_out() & F.col("quality").isin(0, 1))
    texts = {q: [t for _, t in sample_documents(docs, learn.where(F.col("quality") == q), sample, chars)] for q in (0, 1)}
    if not texts[0] or not texts[1]:
        share = 0.5 if not texts[0] and not texts[1] else float(bool(texts[1]))
        return Model(b"", b"", 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    halves = {q: (found[::2], found[1::2] or found) for q, found in texts.items()}
    bad, good = build_dictionary(halves[0][0]), build_dictionary(halves[1][0])
    rest = [(t, q) for q in (0, 1) for t in halves[q][1]]
    x = np.array([size_difference(t, bad, good) for t, _ in rest])
    # Each class weighs what it has of all labels, however many of them the sample took.
    labelled = dict(learn.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("quality").agg(F.count_distinct("doc_id")).collect())
    share = {q: labelled[q] / sum(labelled.values()) for q in (0, 1)}
    weight = np.array([len(rest) * share[q] / len(halves[q][1]) for _, q in rest])
    slope, bias = _logistic(x, np.array([q for _, q in rest], float), weight)
    return Model(bad, good, slope, bias)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with a double column `name`, which `docs` must not have yet."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                x = [size_difference(t or "", model.bad, model.good) if model.slope else 0.0 for t in texts]
                p = 1 / (1 + np.exp(-np.clip(model.slope * np.array(x) + model.bias, -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, name])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels)
    scored = with_score(docs.select("doc_id", whole_text().alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are predicted good, with their columns."""
    return put_back(with_score(set_apart(docs), fit(docs, labels)).where("score >= 0.5"), docs.columns)
