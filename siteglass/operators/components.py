"""Connected components by alternating star contraction.

Each round links every node's larger neighbours to its smallest neighbour, then
its smaller neighbours likewise, so the number of rounds grows with the
logarithm of the longest chain. A node's neighbours are only ever reduced with
`min`, never collected, the rows of a hub are dealt over many tasks, and each
round is written to the shared folder, after which its shuffle files are freed
and the round before is removed.
A table of few edges is written in few files, so rounds over it stay small; in
one of many edges neither a file, nor a task that reads or is sent edges, gets
more than a bounded number, so a task's memory does not grow with the graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siteglass.functions.rows import attach_by_key
from siteglass.session import discard, stored


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) to (v, smallest neighbour of u, or u itself)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    return attach_by_key(pairs, least, ["u"], "degree", F.col("v")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("center"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    down = _star(both).where("u > center").select("u", "v").distinct()  # u lies above its center, and that not below v
    small = _star(down)
    links = small.select("u", "v").union(small.select(F.col("center").alias("u"), "v"))
    return links.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()


#: Edges that a written file has at least where there are fewer files than partitions, and those that it has at most.
FILE_EDGES, MOST_EDGES = 100_000, 1_000_000
TASK_BYTES = "8m"  # of written or shuffled edges; one takes 8 to 16 bytes


@contextmanager
def _bounded_tasks(spark: SparkSession, edges: int) -> Iterator[None]:
    """While a round over so many edges runs: shuffles in as many partitions as they need, and no task of many megabytes."""
    settings = {
        "spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * edges // MOST_EDGES)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
        "spark.sql.files.maxPartitionBytes": TASK_BYTES,
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _written(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """`edges` (of which there are at most `most`) written, with their number and digest, which are counted as they are written."""
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("edges"), F.bit_xor(F.xxhash64("u", "v")).alias("digest"))
    if most is not None:
        counted = counted.coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, most // FILE_EDGES))
    written = stored(counted, "edges", MOST_EDGES)
    return written, (seen.get["edges"], seen.get["digest"])


def _rounds(edges: DataFrame, left: str, right: str, rounds: int) -> tuple[DataFrame, bool]:
    """The edges after so many rounds, and whether they have settled."""
    # Edges that repeat go with the first round; a shuffle of its own for them would not know how many they are.
    current, state = _written(edges.selectExpr(f"greatest({left}, {right}) AS u", f"least({left}, {right}) AS v").where("u <> v"))
    for _ in range(rounds):
        before = state
        with _bounded_tasks(edges.sparkSession, before[0]):
            following, state = _written(_round(current), 2 * before[0])
        discard(current)
        current = following
        if state == before:
            return current, True
    return current, False


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is named by its smallest node."""
    current, settled = _rounds(edges, left, right, max_rounds)
    if not settled:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined_nodes(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 2) -> DataFrame:
    """(node, label) for every node of an edge after a few rounds: nodes of one label are connected, but a component may have several labels."""
    current, _ = _rounds(edges, left, right, rounds)
    own = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return own.union(current.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
