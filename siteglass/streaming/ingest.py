"""Structured Streaming jobs over the evidence and observation logs.

Each job has a batch twin in `operators.observations`; tests hold both to the
same result. Sinks write per micro-batch under the batch id and overwrite their
own output on a replay. The change feed and the table of latest rows have modules
of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteglass.operators import observations as O
from siteglass.session import cut_lineage


def evidence_ingest(evidence: DataFrame, delay: str = "1 day") -> DataFrame:
    """Idempotent evidence stream: one row per dedupe key within the watermark; rows without a key all pass."""
    own = O.K.joined_key("kind", "subject", "source", "request_url", "content_hash", "run_id")
    key = (
        f"CASE WHEN explicit_key IS NOT NULL THEN {O.K.joined_key('\'explicit\'', 'explicit_key')} "
        f"WHEN run_id IS NOT NULL THEN {own} ELSE concat('row:', id) END"
    )
    keyed = evidence.withColumn("stream_key", F.expr(key)).withWatermark("observed_at", delay)
    return keyed.dropDuplicatesWithinWatermark(["stream_key"]).drop("stream_key")


def split_step(batch: DataFrame, batch_id: int, good_path: str, quarantine_path: str) -> None:
    """One micro-batch of the validation split."""
    checked = cut_lineage(O.validate_observations(batch))
    checked.where("size(errors) = 0").drop("errors").write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
    checked.where("size(errors) > 0").write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")


def start(stream: DataFrame, step, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run `step(batch, batch_id)` for every micro-batch."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_split(stream: DataFrame, good_path: str, quarantine_path: str, checkpoint: str) -> StreamingQuery:
    return start(stream, lambda b, i: split_step(b, i, good_path, quarantine_path), checkpoint)
