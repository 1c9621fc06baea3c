"""Streams over the event log, each beside the statement of its batch twin.

The events arrive in slices of their numbers: a slice is written, and the stream takes it as one batch and stops, so every
slice also continues from the checkpoint of the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteglass.plans.catalog import Tables, query
from siteglass.plans.log_queries import LOG, log
from siteglass.session import ensure_checkpoint_dir
from siteglass.streaming import change_feed, ingest, merge_table

SLICES = 4


def by_slices(t: Tables, rows: DataFrame, run: Callable[[DataFrame, str], StreamingQuery], slices: int = SLICES) -> str:
    """Feed `rows` to run(stream, folder) in slices of write_seq; the folder of the stream's files."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("write_seq"), F.max("write_seq")).first()
    place = F.floor((F.col("write_seq") - (low or 0)) * slices / ((high or 0) - (low or 0) + 1))
    for i in range(slices):
        rows.where(place == i).write.parquet(f"{folder}/in/slice={i}")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in/slice=*")
        run(stream, folder).awaitTermination()
    return folder


# One row per key and run; rows without a run all pass.
@query("stream_ingest", LOG + """
SELECT run_id, count(DISTINCT (type, subject, source)) AS rows FROM o WHERE run_id IS NOT NULL GROUP BY run_id
UNION ALL SELECT NULL, count(*) FROM o WHERE run_id IS NULL HAVING count(*) > 0""")
def _(t):
    evidence = log(t).selectExpr(
        "id", "type AS kind", "subject", "source", "'u' AS request_url", "'c' AS content_hash", "run_id", "cast(NULL AS string) AS explicit_key",
        "cast(observed_at AS timestamp) AS observed_at", "write_seq",
    )

    def run(stream, folder):
        writer = ingest.evidence_ingest(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        return writer.option("path", f"{folder}/out").trigger(availableNow=True).start()

    folder = by_slices(t, evidence, run)
    return t.spark.read.schema(evidence.schema).parquet(f"{folder}/out").groupBy("run_id").agg(F.count("*").alias("rows"))


@query("stream_latest", LOG + "SELECT identity_key, id FROM n WHERE rn = 1")
def _(t):
    folder = by_slices(t, log(t), lambda stream, folder: merge_table.start_latest(stream, f"{folder}/latest", f"{folder}/checkpoint"))
    return merge_table.LatestTable(t.spark, f"{folder}/latest").read().select("identity_key", "id")


#: Every row beside the row before it, in place of the latest pair.
ALL_PAIRS = LOG.replace("AND p.rn = 2 WHERE c.rn = 1", "AND p.rn = c.rn + 1").replace("SELECT identity_key, '", "SELECT id, identity_key, '")


@query("stream_change_feed", ALL_PAIRS + "SELECT id AS current_id, identity_key, kind, path, direction, delta FROM change")
def _(t):
    def run(stream, folder):
        return change_feed.start_change_feed(stream, f"{folder}/pairs", f"{folder}/feed", f"{folder}/late", f"{folder}/checkpoint")

    folder = by_slices(t, log(t), run)
    shape = "identity_key string, current_id string, kind string, path string, direction string, delta double"
    return t.spark.read.schema(shape).parquet(f"{folder}/feed").select("current_id", "identity_key", "kind", "path", "direction", "delta")


@query("stream_split", LOG + """
SELECT id, (value > 100) OR (status IN ('BLOCKED', 'UNOBSERVABLE') AND NOT (value > 200 AND event_id % 2 = 0)) AS quarantined FROM o""")
def _(t):
    def run(stream, folder):
        return ingest.start_split(stream, f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint")

    folder = by_slices(t, log(t), run)
    read = lambda name, bad: t.spark.read.schema("id string").parquet(f"{folder}/{name}").select("id", F.lit(bad).alias("quarantined"))
    return read("good", False).unionByName(read("bad", True))
