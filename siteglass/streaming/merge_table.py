"""Table of latest rows per identity, merged when it is read.

A batch appends one folder of delta files, partitioned by a bucket of the identity, and writes as much as it holds. What the
table is made of stands in a manifest: for each folder the buckets of it that count, with their measured bytes. A new version of
the manifest is written aside and renamed into place, so a reader sees one whole version, before, during and after a failure;
folders that no manifest names are left by writers that did not finish. A batch number that the manifest holds is not written
again.

Reading unites the folders' counting buckets and keeps the latest row of each identity. Compaction does the same for those
buckets whose deltas have grown to a share of their base, or to a number of folders, and writes them as a new base; other buckets
stay as they are. So each row is written a bounded number of times while the table grows.

One writer at a time; a second one fails at the rename and can try again. The number of buckets is chosen when the table is made.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siteglass.operators import observations as O
from siteglass.streaming.ingest import start

BUCKETS = 64
GROWN_SHARE = 0.5  # deltas of a bucket, as a share of its base, that make it due
MOST_DELTAS = 16
VERSION_DIGITS = 12


class LostRace(RuntimeError):
    """Another writer made this version of the table."""


@dataclass
class Manifest:
    """One version: `bases` and `deltas` map a folder to the bytes of each of its buckets that count."""

    version: int
    buckets: int
    schema: str
    batches: int = -1  # highest batch number held; batches come in order
    bases: dict[str, dict[str, int]] = field(default_factory=dict)
    deltas: dict[str, dict[str, int]] = field(default_factory=dict)

    def columns(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))

    def due(self) -> list[int]:
        """Buckets whose deltas are to be merged."""
        base: dict[str, int] = {}
        delta: dict[str, list[int]] = {}
        for sizes in self.bases.values():
            base |= sizes
        for sizes in self.deltas.values():
            for bucket, size in sizes.items():
                delta.setdefault(bucket, []).append(size)
        return sorted(int(b) for b, sizes in delta.items() if len(sizes) >= MOST_DELTAS or sum(sizes) >= GROWN_SHARE * base.get(b, 0))


class LatestTable:
    """A table of latest observations at `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.new_buckets = spark, path.rstrip("/"), buckets
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list:
        at = self._paths(f"{self.path}/{folder}")
        return list(self._files.listStatus(at)) if self._files.exists(at) else []

    def manifest(self) -> Manifest | None:
        """The newest whole version."""
        names = [s.getPath().getName() for s in self._listed("manifests")]
        names = sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))
        if not names:
            return None
        stream = self._files.open(self._paths(f"{self.path}/manifests/{names[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _commit(self, manifest: Manifest) -> None:
        name = f"{manifest.version:0{VERSION_DIGITS}d}.json"
        aside = self._paths(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self._files.create(aside)
        try:
            stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        finally:
            stream.close()
        target = self._paths(f"{self.path}/manifests/{name}")
        if self._files.exists(target) or not self._files.rename(aside, target):
            self._files.delete(aside, False)
            raise LostRace(f"version {manifest.version} of {self.path} exists")

    def _write(self, rows: DataFrame, kind: str) -> tuple[str, dict[str, int]]:
        """A new folder of `rows` by bucket: its name and the bytes of each bucket."""
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        sizes = {}
        for s in self._listed(folder):
            name = s.getPath().getName()
            if name.startswith("bucket="):
                sizes[name.removeprefix("bucket=")] = self._files.getContentSummary(s.getPath()).getLength()
        return folder, sizes

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows of the counting buckets; several per identity."""
        wanted = None if buckets is None else {str(b) for b in buckets}
        frames = []
        for folder, sizes in {**manifest.bases, **manifest.deltas}.items():
            held = [int(b) for b in sizes if wanted is None or b in wanted]
            if held:
                rows = self.spark.read.schema(manifest.columns()).parquet(f"{self.path}/{folder}")
                frames.append(rows.where(F.col("bucket").isin(held)))
        return reduce(DataFrame.unionByName, frames) if frames else None

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        return O.latest_per_identity(rows.dropDuplicates(["identity_key", "write_seq"]))

    def read(self) -> DataFrame:
        """The latest row of each identity, of the newest version."""
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        rows = self._rows(manifest)
        return self._latest(rows) if rows is not None else self.spark.createDataFrame([], manifest.columns())

    def append(self, batch: DataFrame, number: int) -> bool:
        """Add the rows of batch `number` of an observation log; False if the table already holds it."""
        held = self.manifest()
        if held is not None and number <= held.batches:
            return False
        count = held.buckets if held else self.new_buckets
        keyed = O.with_keys(batch).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(identity_key), {count}) AS int)"))
        folder, sizes = self._write(self._latest(keyed), "delta")
        manifest = held or Manifest(-1, count, keyed.schema.json())
        deltas = {**manifest.deltas, **({folder: sizes} if sizes else {})}
        self._commit(Manifest(manifest.version + 1, count, manifest.schema, number, manifest.bases, deltas))
        return True

    def compact(self) -> list[int]:
        """Merge the buckets that are due into a new base; which those were."""
        held = self.manifest()
        due = held.due() if held else []
        if due:
            folder, sizes = self._write(self._latest(self._rows(held, due)), "base")
            merged = {str(b) for b in due}
            rest = [{f: left for f, s in part.items() if (left := {b: n for b, n in s.items() if b not in merged})} for part in (held.bases, held.deltas)]
            self._commit(Manifest(held.version + 1, held.buckets, held.schema, held.batches, {**rest[0], folder: sizes}, rest[1]))
        return due

    def vacuum(self, versions: int = 2) -> list[str]:
        """Delete folders that none of the last `versions` versions names, and older manifests. No writer may be at work."""
        names = sorted(s.getPath().getName() for s in self._listed("manifests") if s.getPath().getName().endswith(".json"))
        named: set[str] = set()
        for name in names[-versions:]:
            stream = self._files.open(self._paths(f"{self.path}/manifests/{name}"))
            try:
                text = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            named |= {*text["bases"], *text["deltas"]}
        gone = [f for s in self._listed("data") if (f := f"data/{s.getPath().getName()}") not in named]
        for item in [*gone, *[f"manifests/{n}" for n in names[:-versions]]]:
            self._files.delete(self._paths(f"{self.path}/{item}"), True)
        return gone


def start_latest(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Fold a stream of log rows into the table at `path`."""

    def step(batch: DataFrame, number: int) -> None:
        table = LatestTable(batch.sparkSession, path, buckets)
        table.append(batch, number)
        table.compact()

    return start(stream, step, checkpoint)
