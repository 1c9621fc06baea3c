"""Whitening components by shifted CholeskyQR over distributed Gram passes.

Vectors become whole numbers x, and each distinct x counts once in the fit. Their number n and sums S are exact, and rows are
centred as (n * x - S) / n before anything is multiplied. A pass multiplies the centred rows by what the passes before found
and adds up the Gram matrix of the result: each task adds its own rows, then the tasks' matrices are added row by row. The first
Gram matrix gets a small shift of its diagonal, so that its Cholesky factor exists; after a triangular solve by that factor the
columns are nearly orthogonal, and two more passes make them so to double precision. The composed triangular factor R has the
singular values and right singular vectors of the centred rows: these are the components.

Only Gram matrices and factors reach the driver: dimension squared numbers, whatever the number of rows.

Defined cases: rows with a null or empty vector or a null or non-finite component go, as do vectors of another dimension than
most; rows with null vec_id, repeated rows and rows with equal vectors stay and get equal numbers. Directions without variance
(constant dimensions, fewer distinct vectors than dimensions) give no components, so a row has at most as many as the fit list
has rank; without any the result is empty. Of equal eigenvalues any basis comes. `deviation` is null where it does not fit 64
bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import stored

COMPONENTS = 16
PASSES = 3
RANK = 1e-9  # least singular value that counts, as a share of the largest
SUMMED_TOGETHER = 64  # matrices of so many groups of tasks are added first
ROWS = 8192
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, scale: int, offset: int, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that stay, x = floor(scale * component) + offset."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("x")).where("size(x) > 0")
    rows = rows.where("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("x") == (sizes[0]["size"] if sizes else 0))
    return rows.withColumn("x", F.transform("x", lambda c: F.floor(c * scale) + F.lit(offset).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the matrices that `part` makes of some rows' vectors x."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = part(_matrix(batch.column("x").slice(at, ROWS)))
                total = found if total is None else total + found
        if total is not None:
            values = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], names=["line", "values"])

    def add(group: pa.Table) -> pa.Table:
        line = group.column("line")[0].as_py()
        values = _matrix(group.column("values").combine_chunks()).sum(0)
        return pa.table({"line": pa.array([line], pa.int32()), "values": pa.array([values], pa.list_(pa.float64()))})

    shape = "line int, values array<double>"
    parts = rows.select("x").mapInArrow(own, shape).withColumn("salt", F.spark_partition_id() % SUMMED_TOGETHER)
    some = parts.groupBy("line", "salt").applyInArrow(lambda group: add(group), shape)
    lines = some.groupBy("line").applyInArrow(lambda group: add(group), shape).orderBy("line").collect()
    return np.array([r["values"] for r in lines])


def shifted_cholesky(gram: np.ndarray, rows: int, shift: bool) -> np.ndarray:
    """Upper triangular factor of `gram`; the shifted one exists for every Gram matrix in double precision."""
    width = len(gram)
    if not shift:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    least = 11 * (rows * width + width * (width + 1)) * np.finfo(float).eps / 2 * max(np.trace(gram), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + least * np.eye(width)).T
        except np.linalg.LinAlgError:
            least *= 100


def components_of(fit: DataFrame, n: int, sums: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, eigenvalues) of the covariance of the distinct rows `fit`, by falling eigenvalue."""
    width = len(sums)
    factor, whole = np.eye(width), np.eye(width)
    for number in range(passes):
        solve = np.linalg.inv(whole)  # of a triangular matrix
        gram = summed(fit, lambda x: (q := (n * x - sums) / n @ solve).T @ q)  # noqa: B023
        if not gram.any():
            return np.eye(width), np.zeros(width)
        if number == passes - 1:
            # The last factor is a root of the Gram matrix, which has one also where directions without variance are left.
            values, turn = np.linalg.eigh(gram)
            factor = np.sqrt(np.maximum(values, 0))[:, None] * turn.T
        else:
            factor = shifted_cholesky(gram, n, shift=not number)
        whole = factor @ whole
    _, singular, right = np.linalg.svd(whole)
    return right.T, singular**2 / n


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, offset: int = 1_000_000, column: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, scale, offset, column), "whole_vectors")
    fit = stored(rows.select("x").distinct(), "fit")
    n, width = fit.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    places = fit.select(F.posexplode("x").alias("place", "c")).groupBy("place").agg(F.sum("c").alias("s")).orderBy("place").collect()
    sums = np.array([r["s"] for r in places], np.int64)
    vectors_of, values = components_of(fit, n, sums)
    rank = int((values > RANK**2 * values[0]).sum()) if values[0] > 0 else 0
    kept = min(components, rank)
    if not kept:
        return spark.createDataFrame([], RESULT)
    project = vectors_of[:, :kept] / np.sqrt(values[:kept])
    explained = (values[:kept] / values.sum()).tolist()

    def moments(x: np.ndarray) -> np.ndarray:
        white = (n * x - sums) / n @ project
        return np.concatenate([white.T @ white, white.sum(0)[None]])

    found = summed(fit, moments) / n
    error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(kept)).max())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                far = n * _matrix(batch.column("x")) - sums
                if width * float(np.abs(far).max(initial=0)) ** 2 < 2**62:
                    deviation = (far * far).sum(1).tolist()
                else:
                    exact = [sum(int(v) ** 2 for v in line) for line in far]
                    deviation = [d if d < 2**63 else None for d in exact]
                white = pa.array(list(far / n @ project), pa.list_(pa.float64()))
                arrays = [batch.column("vec_id"), pa.array(deviation, pa.int64()), white]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "deviation", "white"])

    answers = rows.mapInArrow(answer, "vec_id long, deviation long, white array<double>")
    share = F.array(*[F.lit(e) for e in explained])
    return answers.select("vec_id", "deviation", F.posexplode("white").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
