"""Hard negatives by a vertical scan: vectors kept by dimension, and each anchor reads the dimensions that matter to it first.

Rows are dealt to blocks by the hash of vec_id and stored dimension by dimension, with the least and largest value of each
dimension in the block. A task takes one block and one chunk of anchors. For each anchor it adds up products in the order of
the anchor's descending magnitudes, a few dimensions at a time; least and largest values bound what the other dimensions can
still add, and rows that cannot be among the answers any more leave the candidates. The few rows that stay are known exactly.

Two scans: the first finds each anchor's nearest rows of its own label. They give windows of scores, [ps / 2, 0.95 ps]; in the
second a candidate stays while its bounds meet a window and fewer than the wanted rows are surely above it inside that window.

Scores are whole numbers and are added exactly, in double precision where every sum stays below 2^53, else as 64-bit integers.

Defined cases: rows with null vec_id or label, a null or empty vector, or a null or non-finite component take no part, nor do
vectors of another dimension than most; zero vectors do. Rows are known by vec_id: repeated rows count once, and of several
rows with one vec_id the one with the smallest label and vector counts. Ties go to the smaller vec_id. An anchor without
positives, or whose windows hold no row, gives no rows; so does an empty table. Other columns are ignored. A table in which a
score could pass 2^63 stops with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteglass.llm.common import stored

BLOCK_ROWS = 4096
CHUNK_ANCHORS = 256
STEPS = (4, 4, 8, 16)  # dimensions read at once, the last number again and again
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
OUT = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_vectors(vectors: DataFrame, label: Column, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, label, x): the rows that take part, with components floor(scale * component)."""
    rows = vectors.select(
        F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col(column).cast("array<double>").alias("x")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0")
    rows = rows.where("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("x") == (sizes[0]["size"] if sizes else 0))
    rows = rows.withColumn("x", F.transform("x", lambda c: F.floor(c * scale)))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.*")


def _dealt(parts: int, name: str = "vec_id") -> Column:
    return F.pmod(F.xxhash64(name), F.lit(parts))


def _packed(rows: DataFrame, parts: int, key: str) -> DataFrame:
    """One row per value of the dealt `key`: ids in order, labels and the matrix, dimension after dimension."""

    def pack(value: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        matrix = group.column("x").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        own = [value[0], *[group.column(c).to_numpy().tobytes() for c in ("vec_id", "label")], np.ascontiguousarray(matrix.T).tobytes()]
        return pa.table({name: [v] for name, v in zip((key, "ids", "labels", "matrix"), own)})

    keyed = rows.withColumn(key, _dealt(parts)).repartition(min(parts, 10_000), key)
    return keyed.groupBy(key).applyInArrow(pack, f"{key} long, ids binary, labels binary, matrix binary")


class Block:
    """Vectors by dimension, with the bounds of each dimension."""

    def __init__(self, ids: bytes, labels: bytes, matrix: bytes, exact: type):
        self.ids = np.frombuffer(ids, np.int64)
        self.labels = np.frombuffer(labels, np.int64)
        self.matrix = np.frombuffer(matrix, np.int64).reshape(-1, len(self.ids)).astype(exact)
        self.least, self.most = self.matrix.min(1), self.matrix.max(1)

    def scan(self, vector: np.ndarray, candidates: np.ndarray, left) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, scores) that are left when all dimensions are read; left(low, high) marks those that may stay."""
        order = np.argsort(-np.abs(vector), kind="stable")
        by_least, by_most = vector * self.least, vector * self.most
        low, high = np.minimum(by_least, by_most)[order], np.maximum(by_least, by_most)[order]
        rest_low, rest_high = low[::-1].cumsum()[::-1], high[::-1].cumsum()[::-1]
        sums = np.zeros(len(candidates), self.matrix.dtype)
        at = step = 0
        while at < len(order) and len(candidates):
            to = min(len(order), at + STEPS[min(step, len(STEPS) - 1)])
            read = order[at:to]
            rows = self.matrix[read] if len(candidates) == len(self.ids) else self.matrix[np.ix_(read, candidates)]
            sums = sums + vector[read] @ rows
            at, step = to, step + 1
            under, over = (rest_low[at], rest_high[at]) if at < len(order) else (0, 0)
            stay = left(sums + under, sums + over)
            if not stay.all():
                candidates, sums = candidates[stay], sums[stay]
        return candidates, sums


def among_largest(k: int):
    """Which rows may be among the k largest."""

    def left(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, -k)[-k] if len(low) > k else np.ones(len(low), bool)

    return left


def among_windows(windows: list[tuple[int, int]], k: int):
    """Which rows may be among the k largest of a window [from, to]."""

    def left(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for begin, end in windows:
            meets = (high >= begin) & (low <= end)
            surely = low[(low >= begin) & (high <= end)]
            stay |= meets & (high >= np.partition(surely, -k)[-k]) if len(surely) > k else meets
        return stay

    return left


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest_of_label(block: Block, ids, labels, vectors, positives: int) -> list[tuple]:
    out = []
    for anchor, label, vector in zip(ids.tolist(), labels, vectors):
        own = np.flatnonzero((block.labels == label) & (block.ids != anchor))
        rows, scores = block.scan(vector, own, among_largest(positives))
        out += [(anchor, 0, int(block.ids[rows[i]]), int(scores[i])) for i in _best(block.ids[rows], scores, positives)]
    return out


def nearest_in_windows(block: Block, ids, labels, vectors, windows: list[dict], negatives: int) -> list[tuple]:
    wanted: dict[int, list[dict]] = {}
    for w in windows:
        wanted.setdefault(w["anchor"], []).append(w)
    out = []
    for anchor, label, vector in zip(ids.tolist(), labels, vectors):
        if anchor not in wanted:
            continue
        bounds = [(w["begin"], w["end"]) for w in wanted[anchor]]
        rows, scores = block.scan(vector, np.flatnonzero(block.labels != label), among_windows(bounds, negatives))
        for w, (begin, end) in zip(wanted[anchor], bounds):
            inside = np.flatnonzero((scores >= begin) & (scores <= end))
            best = inside[_best(block.ids[rows[inside]], scores[inside], negatives)]
            out += [(anchor, w["place"], int(block.ids[rows[i]]), int(scores[i])) for i in best]
    return out


def _scan(blocks: DataFrame, chunks: DataFrame, chunk_count: int, exact: type, search) -> DataFrame:
    """All blocks against all chunks: (anchor, window, vec_id, score) of what `search` finds in each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (row for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist()):
                block = Block(r["ids"], r["labels"], r["matrix"], exact)
                ids, labels = np.frombuffer(r["anchor_ids"], np.int64), np.frombuffer(r["anchor_labels"], np.int64)
                vectors = np.frombuffer(r["anchor_matrix"], np.int64).reshape(-1, len(ids)).T.astype(exact)
                columns = list(zip(*search(block, ids, labels, vectors, r["windows"]))) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, OUT)], schema=OUT)

    asked = chunks.select("chunk", *[F.col(c).alias(f"anchor_{c}") for c in ("ids", "labels", "matrix")], "windows")
    cells = blocks.withColumn("chunk", F.explode(F.expr(f"sequence(0L, {chunk_count - 1}L)"))).join(asked, "chunk")
    return cells.mapInArrow(run, "anchor long, window int, vec_id long, score long")


def hard_negatives(
    vectors: DataFrame, label: Column, every: int = 50, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256, block_rows: int = BLOCK_ROWS, chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """The first `negatives` rows of another label for each anchor (vec_id divisible by `every`) and each of its positives.

    Positives are the first `positives` other rows of the anchor's label. A negative's score lies between `low` and `high`
    percent of the positive's score (0 <= low < high). Higher inner products come first.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, label, scale), "whole_vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    asked = anchors.count()
    if not asked:
        return spark.createDataFrame([], RESULT)
    zero = F.lit(0).cast("long")
    total, largest, width = rows.agg(
        F.count("*"), F.max(F.aggregate("x", zero, lambda m, c: F.greatest(m, F.abs(c)))), F.max(F.size("x"))
    ).first()
    if 100 * width * largest**2 >= 2**63:
        raise ValueError("inner products of these vectors do not fit 64-bit integers")
    exact = np.float64 if width * largest**2 < 2**53 else np.int64

    chunk_count = -(-asked // chunk_anchors)
    blocks = stored(_packed(rows, -(-total // block_rows), "block"), "blocks")
    chunks = stored(_packed(anchors, chunk_count, "chunk"), "chunks")
    no_windows = F.array().cast("array<struct<anchor:long,place:int,begin:long,end:long>>")
    first = _scan(
        blocks, chunks.withColumn("windows", no_windows), chunk_count, exact,
        lambda block, ids, labels, vectors, _: nearest_of_label(block, ids, labels, vectors, positives),
    )
    of_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = first.withColumn("place", F.row_number().over(of_anchor)).where(F.col("place") <= positives)
    near = stored(near.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = near.where("positive_score >= 0").select(
        _dealt(chunk_count, "anchor").alias("chunk"),
        F.struct("anchor", "place", F.expr(f"({low} * positive_score + 99) div 100").alias("begin"), F.expr(f"{high} * positive_score div 100").alias("end")).alias("w"),
    )
    of_chunk = windows.groupBy("chunk").agg(F.collect_list("w").alias("windows"))
    second = _scan(
        blocks, chunks.join(of_chunk, "chunk"), chunk_count, exact,
        lambda block, ids, labels, vectors, wanted: nearest_in_windows(block, ids, labels, vectors, wanted, negatives),
    )
    of_window = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    found = second.withColumn("rank", F.row_number().over(of_window)).where(F.col("rank") <= negatives)
    found = found.select("anchor", F.col("window").alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor", "place"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
