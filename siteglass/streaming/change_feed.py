"""Change feed as a state machine per identity.

Each identity keeps one value of state, its latest row, in the RocksDB state store. The rows of a micro-batch are taken in time
order: a newer row is paired with the row before it and becomes the state, a row that is older than the state is late, and the
state's own row seen again is dropped. So a batch reads and writes the state of its own identities only. Rows pass through the
processor as JSON text; pairs are compared afterwards by the same row-local expressions as in batch.

The batch's pairs are written once under the batch id, and changes and late rows are made from the written pairs. A batch that
runs again after a failure starts from the same version of the state and overwrites its own output, so it changes nothing.

With `idle`, a timer on event time drops the state of an identity that had no row for so long once the watermark passes; its next
row then counts as a first one. Rows that arrive later than the watermark's delay do not reach the processor in that mode.
A micro-batch's rows of one identity are sorted in one task; the trigger's file or row limit bounds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from siteglass.operators import observations as O
from siteglass.session import importable_by_workers

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMES = dict.fromkeys(("timestampFormat", "timestampNTZFormat"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
OUTPUT = "identity_key string, late boolean, prev string, cur string"
_UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(duration: str) -> int:
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", duration)
    if not found:
        raise ValueError(f"not a duration: {duration!r}")
    return int(found[1]) * _UNITS[found[2]]


class LatestRow(StatefulProcessor):
    """One identity: its latest row, and a timer while it is idle."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, seq long, row string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, seq, row = self.latest.get() if self.latest.exists() else (None, None, None)
        moved = False
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            if at is None or (r["at"], r["seq"]) > (at, seq):
                yield Row(identity_key=key[0], late=False, prev=row, cur=r["row"])
                at, seq, row, moved = r["at"], r["seq"], r["row"], True
            elif (r["at"], r["seq"]) < (at, seq):
                yield Row(identity_key=key[0], late=True, prev=None, cur=r["row"])
        if moved:
            self.latest.update((at, seq, row))
            if self.idle_ms is not None:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(at // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def row_pairs(log: DataFrame, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(identity_key, late, prev, cur) of a stream of log rows; prev and cur are the JSON of all their columns."""
    importable_by_workers(log.sparkSession)
    keyed = O.with_keys(log)
    rows = keyed.select(
        "identity_key", "observed_at", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"), F.col("write_seq").alias("seq"),
        F.to_json(F.struct(*keyed.columns), TIMES).alias("row"),
    )
    if idle is not None:
        rows = rows.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", delay)
    processor = LatestRow(None if idle is None else _milliseconds(idle))
    return rows.groupBy("identity_key").transformWithState(processor, OUTPUT, "Append", "None" if idle is None else "EventTime")


def _read_back(pairs: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(pairs of rows, late rows)."""
    row = lambda side: F.from_json(side, schema, TIMES)
    kept = lambda side: F.when(F.col(side).isNotNull(), F.struct(*[row(side)[c].alias(c) for c in O.PAIR_FIELDS]))
    found = pairs.where("NOT late").select("identity_key", kept("prev").alias("prev"), kept("cur").alias("cur"))
    return found, pairs.where("late").select(row("cur").alias("row")).select("row.*")


def feed_step(batch: DataFrame, batch_id: int, schema: StructType, pairs_path: str, feed_path: str, late_path: str) -> None:
    """Write one micro-batch's pairs, and from them its changes and late rows."""
    written = f"{pairs_path}/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(written)
    pairs, late = _read_back(batch.sparkSession.read.schema(OUTPUT).parquet(written), schema)
    O.diff_observations(pairs).write.mode("overwrite").parquet(f"{feed_path}/batch_id={batch_id}")
    late.write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")


def start_change_feed(
    stream: DataFrame, pairs_path: str, feed_path: str, late_path: str, checkpoint: str, idle: str | None = None,
    delay: str = "0 seconds", available_now: bool = True,
) -> StreamingQuery:
    """Run the feed over a stream of log rows; the state lives under `checkpoint`."""
    spark = stream.sparkSession
    schema = O.with_keys(stream).schema
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # read when the query starts and kept with its checkpoint
    try:
        step = lambda batch, i: feed_step(batch, i, schema, pairs_path, feed_path, late_path)
        writer = row_pairs(stream, idle, delay).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)
