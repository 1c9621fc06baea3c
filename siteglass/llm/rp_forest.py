"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and kept by every task; every vector is then put into one leaf of each tree.
A query walks all trees with one priority queue ordered by the largest margin on the way, and visits as many leaves as
reached the wanted recall against brute force on the sample. Leaves are joined with their visits in blocks of bounded
size, and the candidates are ranked by their exact inner product in double precision. The first leaves of each query
give a score that k others reach; from all further leaves only candidates that reach it too are passed on.

Largest inner product becomes nearest neighbour by one more coordinate that makes all vectors equally long. Equal
vectors are searched and stored once with the k + 1 smallest ids: the others of them cannot be among any k nearest, as
ties go to smaller ids. Queries with equal vectors are searched once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without vec_id or vectors of another dimension than most; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.llm.common import attach, stored

TREES = 4
LEAF_ROWS = 1024
SAMPLE_BYTES = 16 << 20  # of vectors in double precision that the trees are fitted on
SAMPLE_QUERIES = 256
RECALL = 0.95
FIRST_VISITS = 8
BLOCK_MEMBERS = 4096
BLOCK_QUERIES = 4096
SEED = 20240229


@dataclass
class Tree:
    """Inner node i: direction i, threshold i, children (2 per node; -1 - leaf for a leaf)."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64) if len(self.thresholds) else np.full(len(vectors), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", vectors[inner], self.directions[node]) >= self.thresholds[node]
            at[inner] = self.children[node, right.astype(int)]
        return -1 - at


def grow(vectors: np.ndarray, leaf_rows: int, draw: np.random.Generator) -> Tree:
    """Split by a random direction at the median until at most `leaf_rows` rows of the sample are left."""
    directions, thresholds, children, leaves = [], [], [], 0
    stack = [(np.arange(len(vectors)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        link = None
        if len(rows) > leaf_rows:
            direction = draw.standard_normal(vectors.shape[1])
            direction /= np.linalg.norm(direction)
            place = vectors[rows] @ direction
            threshold = float(np.median(place))
            right = place >= threshold
            if right.any() and not right.all():
                link = len(thresholds)
                directions.append(direction)
                thresholds.append(threshold)
                children.append([0, 0])
                stack += [(rows[~right], link, 0), (rows[right], link, 1)]
        if link is None:
            link, leaves = -1 - leaves, leaves + 1
        if parent >= 0:
            children[parent][side] = link
    width = vectors.shape[1]
    return Tree(np.array(directions).reshape(-1, width), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), leaves)


@dataclass
class Forest:
    trees: list[Tree]
    norm: float  # length of every vector with its added coordinate
    visits: int = 1

    @cached_property
    def leaves(self) -> int:
        return sum(t.leaves for t in self.trees)

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Stored vectors with the coordinate that makes them equally long."""
        rest = np.sqrt(np.maximum(0, self.norm**2 - np.einsum("ij,ij->i", vectors, vectors)))
        return np.concatenate([vectors, rest[:, None]], 1)

    def search(self, query: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the first `visits` leaves of all trees, least margin first."""
        query = np.append(query, 0.0)
        margins = [t.directions @ query - t.thresholds for t in self.trees]
        queue = [(0.0, i, 0 if len(t.thresholds) else -1) for i, t in enumerate(self.trees)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < visits:
            bound, tree, node = heapq.heappop(queue)
            while node >= 0:
                margin = float(margins[tree][node])
                left, right = self.trees[tree].children[node].tolist()
                near, far = (right, left) if margin >= 0 else (left, right)
                heapq.heappush(queue, (max(bound, abs(margin)), tree, far))
                node = near
            found.append((tree, -1 - node))
        return found


def fit_forest(sample: np.ndarray, total: int, norm: float, k: int, trees: int = TREES, recall: float = RECALL) -> Forest:
    """Trees over the sample with leaves of about LEAF_ROWS of all rows, and the visits that reach `recall` on the sample."""
    draw = np.random.default_rng(SEED)
    forest = Forest([], norm)
    placed = forest.placed(sample)
    leaf_rows = max(8, LEAF_ROWS * len(sample) // max(1, total))
    forest.trees = [grow(placed, leaf_rows, draw) for _ in range(trees)]
    forest.visits = forest.leaves
    queries = draw.permutation(len(sample))[:SAMPLE_QUERIES]
    if len(sample) <= k + 1:
        return forest
    products = sample[queries] @ sample.T
    products[np.arange(len(queries)), queries] = -np.inf
    nearest = np.argpartition(-products, k, axis=1)[:, :k]
    leaf = np.stack([t.leaf_of(placed) for t in forest.trees])
    needed = []  # for each near row of each query, the visit that finds it first
    for q, near in zip(queries, nearest):
        order = np.full((trees, max(t.leaves for t in forest.trees)), forest.leaves, np.int64)
        for visit, (tree, at) in enumerate(forest.search(sample[q], forest.leaves), 1):
            order[tree, at] = visit
        needed.append(order[np.arange(trees)[:, None], leaf[:, near]].min(0))
    forest.visits = int(np.quantile(np.concatenate(needed), recall, method="higher"))
    return forest


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, embedding in double precision) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND size(embedding) > 0").where(
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    )
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["size"] if sizes else 0))


def _top(near: DataFrame, most: int) -> DataFrame:
    """The `most` best rows of (query, vec_id, score) for each query, each vec_id once, with their place."""
    once = near.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    ordered = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= most)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`."""
    rows = usable(vectors, column)
    spark = vectors.sparkSession
    # Repeated rows once, then equal vectors once: the number of ids, and the k + 1 smallest (limited before the shuffle).
    rows = rows.distinct()
    few = Window.partitionBy("embedding").orderBy("vec_id")
    small = rows.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1)
    listed = small.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    counted = rows.groupBy("embedding").agg(F.count("*").alias("rows"))
    reps = stored(listed.join(counted, "embedding").select("embedding", "rows", "ids", F.element_at("ids", 1).alias("rep")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = stored(attach(asked, reps.select("embedding", "rows", "rep"), "embedding", "rows", F.col("query_id")).select("query_id", "rep"), "queries")
    searched = reps.join(asked.select("rep").distinct(), "rep", "left_semi")

    total, norm, width = reps.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("embedding"))).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    size = max(1024, SAMPLE_BYTES // (8 * width))
    sample = reps.select("embedding", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(size).select("embedding").toArrow()
    forest = fit_forest(_matrix(sample.column(0).combine_chunks()), total, float(np.sqrt(norm)), k)
    per_leaf = max(1, total * len(forest.trees) // forest.leaves)
    member_blocks = max(1, -(-per_leaf // BLOCK_MEMBERS))
    query_blocks = max(1, -(-(searched.count() * forest.visits // forest.leaves) // BLOCK_QUERIES))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = forest.placed(_matrix(batch.column("embedding")))
            for tree, grown in enumerate(forest.trees):
                leaf = pa.array(grown.leaf_of(placed), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), tree), pa.int64()), leaf, *batch.columns], names=["tree", "leaf", "rep", "ids", "embedding"])

    def visits(batches: Iterator[pa.RecordBatch], begin: int, end: int) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [forest.search(query, end)[begin:] for query in _matrix(batch.column("embedding"))]
                which = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                pairs = np.array([p for f in found for p in f], np.int64).reshape(-1, 2)
                taken = batch.take(which)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), *taken.columns], names=["tree", "leaf", "query", "embedding", "bound"])

    def best(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "ids": [], "score": []}
        if block.num_rows and asked.num_rows:
            own, queries = _matrix(block.column("embedding").combine_chunks()), _matrix(asked.column("embedding").combine_chunks())
            reps, names, ids = block.column("rep").to_numpy(), asked.column("query").to_pylist(), block.column("ids").to_pylist()
            bounds = asked.column("bound").to_numpy()
            for at in range(0, len(queries), 512):
                products = queries[at : at + 512] @ own.T
                for i, row in enumerate(products):
                    least = np.partition(row, -(k + 1))[-(k + 1)] if len(row) > k + 1 else -np.inf
                    least = max(least, bounds[at + i])
                    near = np.flatnonzero(row >= least - 1e-9 * abs(least) if np.isfinite(least) else row == row)
                    exact = np.einsum("j,ij->i", queries[at + i], own[near])
                    order = np.lexsort((reps[near], -exact))[: k + 1]
                    for j in order.tolist():
                        out["query"].append(names[at + i])
                        out["ids"].append(ids[near[j]])
                        out["score"].append(float(exact[j]))
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]))

    double = "array<double>"
    stored_leaves = reps.select("rep", "ids", "embedding").mapInArrow(members, f"tree long, leaf long, rep long, ids array<long>, embedding {double}")
    blocks = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    stored_leaves = stored_leaves.withColumn("mb", F.pmod(F.xxhash64("rep"), F.lit(member_blocks)).cast("int")).withColumn("qb", F.explode(blocks(query_blocks)))
    by = ["tree", "leaf", "mb", "qb"]

    def candidates(asked: DataFrame, begin: int, end: int) -> DataFrame:
        """The k + 1 best (query, vec_id, score, place) of the visits numbered begin to end."""
        shape = f"tree long, leaf long, query long, embedding {double}, bound double"
        leaves = asked.select("rep", "embedding", "bound").mapInArrow(lambda batches: visits(batches, begin, end), shape)
        leaves = leaves.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("mb", F.explode(blocks(member_blocks)))
        found = stored_leaves.groupBy(*by).cogroup(leaves.groupBy(*by)).applyInArrow(best, "query long, ids array<long>, score double")
        return _top(found.select("query", F.explode("ids").alias("vec_id"), "score"), k + 1)

    first = min(forest.visits, FIRST_VISITS)
    near = stored(candidates(searched.withColumn("bound", F.lit(float("-inf"))), 0, first), "first_near")
    if first < forest.visits:
        bounds = near.where(F.col("place") == k + 1).select(F.col("query").alias("rep"), F.col("score").alias("bound"))
        bounded = searched.join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        near = near.drop("place").union(candidates(bounded, first, forest.visits).drop("place"))
    top = _top(near.select("query", "vec_id", "score"), k + 1)
    lists = top.groupBy("query").agg(F.collect_list(F.struct("score", "vec_id")).alias("near")).withColumnRenamed("query", "rep")
    lists = stored(lists.join(asked.groupBy("rep").agg(F.count("*").alias("askers")), "rep"), "near")
    answers = attach(asked, lists, "rep", "askers", F.col("query_id")).select("query_id", F.explode("near").alias("n")).select("query_id", "n.*")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = answers.where("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
