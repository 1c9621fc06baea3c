"""Streams against their batch twins, replays, crashes and rows out of order."""

import pytest
from pyspark.sql import functions as F

from siteglass.operators import observations as O
from siteglass.sources import carriers as C
from siteglass.streaming import change_feed as CF
from siteglass.streaming import ingest as S
from siteglass.streaming import merge_table as M

COLUMNS = ["identity_key", "current_id", "kind", "path", "direction"]


@pytest.fixture(scope="module")
def log(spark, folder):
    return C.observations(spark.read.parquet(f"{folder}/events.parquet")).persist()


def sliced(log, parts):
    total = log.count()
    return [log.where(f"write_seq >= {i * total // parts} AND write_seq < {(i + 1) * total // parts}") for i in range(parts)]


def stream_of(spark, slices, path):
    """Write the slices as files and read them one per micro-batch."""
    for rows in slices:
        rows.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def latest(rows):
    return {(r.identity_key, r.id) for r in rows.select("identity_key", "id").collect()}


def test_latest_equals_batch(spark, log, tmp_path):
    stream = stream_of(spark, sliced(log, 3), tmp_path / "in")
    M.start_latest(stream, str(tmp_path / "latest"), str(tmp_path / "cp"), buckets=8).awaitTermination()
    assert latest(M.LatestTable(spark, str(tmp_path / "latest")).read()) == latest(O.latest_per_identity(O.with_keys(log)))


def test_a_batch_writes_its_own_rows_and_a_replay_nothing(spark, log, tmp_path):
    table = M.LatestTable(spark, str(tmp_path / "t"), buckets=8)
    assert table.manifest() is None
    assert table.append(log, 0)
    one = log.limit(1)
    assert table.append(one, 1) and not table.append(one, 1) and not table.append(log, 0)
    deltas = list(table.manifest().deltas.values())
    assert len(deltas) == 2 and sum(deltas[1].values()) * 5 < sum(deltas[0].values()) and len(deltas[1]) == 1
    assert latest(table.read()) == latest(O.latest_per_identity(O.with_keys(log)))


def test_compaction_merges_only_what_has_grown(spark, log, tmp_path):
    table = M.LatestTable(spark, str(tmp_path / "t"), buckets=4)
    table.append(log, 0)
    assert table.compact() == [0, 1, 2, 3]  # a first delta has no base
    assert table.compact() == []
    newer = log.limit(1).withColumn("observed_at", F.expr("observed_at + INTERVAL 900 DAYS")).withColumn("id", F.lit("newer"))
    for i in range(1, M.MOST_DELTAS + 1):
        table.append(newer.withColumn("write_seq", F.lit(10**9 + i)), i)
    held = table.manifest()
    due = table.compact()
    assert len(due) == 1 and len(held.deltas) == M.MOST_DELTAS and not table.manifest().deltas
    assert sum(str(due[0]) in sizes for sizes in table.manifest().bases.values()) == 1
    rows = table.read()
    assert rows.where("id = 'newer'").count() == 1 and rows.count() == len(latest(O.latest_per_identity(O.with_keys(log))))
    before = latest(rows)
    assert table.vacuum(1) and latest(table.read()) == before


def test_a_reader_sees_one_whole_version_when_a_writer_fails(spark, log, tmp_path, monkeypatch):
    table = M.LatestTable(spark, str(tmp_path / "t"), buckets=4)
    first, second = sliced(log, 2)
    table.append(first, 0)
    before = latest(table.read())
    opened = table.read()

    def fails(_):
        raise OSError("lost")

    monkeypatch.setattr(table, "_commit", fails)
    for step in (lambda: table.append(second, 1), table.compact):
        with pytest.raises(OSError):
            step()
    monkeypatch.undo()
    assert latest(table.read()) == before  # folders without a manifest are not read
    table.append(second, 1)
    table.compact()
    assert latest(opened) == before  # the version it was opened with
    assert latest(table.read()) == latest(O.latest_per_identity(O.with_keys(log)))
    stale = table.manifest()
    with pytest.raises(M.LostRace):
        table._commit(stale)


def written(spark, path):
    return sorted(map(str, spark.read.parquet(path).drop("batch_id").collect()))


def run_feed(spark, slices, base, **options):
    stream = stream_of(spark, slices, base / "in")
    paths = [str(base / n) for n in ("pairs", "feed", "late", "cp")]
    CF.start_change_feed(stream, *paths, **options).awaitTermination()
    return paths


def test_change_feed_covers_the_latest_pairs(spark, log, tmp_path):
    paths = run_feed(spark, sliced(log, 3), tmp_path)
    feed = spark.read.parquet(paths[1])
    want = O.diff_observations(O.latest_pair(O.with_keys(log))).select(*COLUMNS)
    assert want.count() > 0
    assert want.exceptAll(feed.select(*COLUMNS)).count() == 0
    assert spark.read.parquet(paths[2]).count() == 0


def test_late_rows_are_set_aside_and_replays_change_nothing(spark, log, tmp_path):
    slices = sliced(log, 3)
    stale = slices[0].limit(50).withColumn("observed_at", F.expr("observed_at - INTERVAL 400 DAYS")).withColumn("write_seq", F.col("write_seq") + 10**6)
    shown = slices[1].limit(20)  # the same rows again: neither late nor a change, unless something newer came in between
    slices[2] = slices[2].unionByName(stale).unionByName(shown)
    paths = run_feed(spark, slices, tmp_path)
    late = spark.read.parquet(paths[2])
    assert late.where("write_seq >= 1000000").count() == 50
    assert set(late.columns) >= set(log.columns)
    whole = O.diff_observations(O.latest_pair(O.with_keys(log))).select(*COLUMNS)
    assert whole.exceptAll(spark.read.parquet(paths[1]).select(*COLUMNS)).count() == 0
    first = [written(spark, p) for p in paths[1:3]]
    schema = O.with_keys(log).schema
    for batch in (2, 0, 1):  # each batch's step again, on what the processor had given it
        pairs = spark.createDataFrame(spark.read.parquet(f"{paths[0]}/batch_id={batch}").collect(), CF.OUTPUT)
        CF.feed_step(pairs, batch, schema, *paths[:3])
    assert [written(spark, p) for p in paths[1:3]] == first


def test_a_batch_that_failed_half_way_runs_again_from_the_same_state(spark, log, tmp_path, monkeypatch):
    slices = sliced(log, 3)
    want = [written(spark, p) for p in run_feed(spark, slices, tmp_path / "whole")[1:3]]
    step, failed = CF.feed_step, []

    def once(batch, number, *rest):
        step(batch, number, *rest)
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("lost after the batch was written")

    monkeypatch.setattr(CF, "feed_step", once)
    base = tmp_path / "broken"
    stream = stream_of(spark, slices, base / "in")
    paths = [str(base / n) for n in ("pairs", "feed", "late", "cp")]
    with pytest.raises(Exception, match="lost after"):
        CF.start_change_feed(stream, *paths).awaitTermination()
    CF.start_change_feed(stream, *paths).awaitTermination()
    assert failed and [written(spark, p) for p in paths[1:3]] == want


def test_idle_identities_expire(spark, log, tmp_path):
    first = log.limit(40).withColumn("observed_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, write_seq)"))
    other = log.orderBy(F.desc("write_seq")).limit(1).withColumn("subject", F.lit("other")).withColumn("observed_at", F.expr("timestamp_ntz'2024-03-01'"))
    again = first.withColumn("observed_at", F.expr("observed_at + INTERVAL 62 DAYS")).withColumn("id", F.concat(F.lit("again-"), "id"))
    firsts = {}
    for idle in (None, "30 days"):
        paths = run_feed(spark, [first, other, other.withColumn("observed_at", F.expr("timestamp_ntz'2024-03-01 12:00:00'")), again], tmp_path / str(idle), idle=idle)
        pairs = spark.read.parquet(paths[0]).where("NOT late AND cur LIKE '%again-%'")
        firsts[idle] = pairs.where("prev IS NULL OR prev NOT LIKE '%again-%'").select("identity_key", F.col("prev").isNull().alias("is_first")).collect()
    assert firsts[None] and not any(r.is_first for r in firsts[None])
    assert len(firsts["30 days"]) == len(firsts[None]) and all(r.is_first for r in firsts["30 days"])
    with pytest.raises(ValueError):
        CF.row_pairs(log, idle="soon")


def test_validation_split(spark, log, tmp_path):
    stream = stream_of(spark, sliced(log, 3), tmp_path / "in")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    S.start_split(stream, good, bad, str(tmp_path / "cp")).awaitTermination()
    want_good, want_bad = O.split_valid(log)
    assert spark.read.parquet(good).count() == want_good.count()
    assert spark.read.parquet(bad).count() == want_bad.count() > 0


def test_evidence_ingest_equals_batch(spark, tmp_path):
    rows = [
        ("e1", "page_html", "s", "h", "u", "c", "r1", None, "2024-01-01 00:00:00", 1),
        ("e2", "page_html", "s", "h", "u", "c", "r1", None, "2024-01-01 00:01:00", 2),
        ("e3", "page_html", "s", "h", "u", "c", None, None, "2024-01-01 00:02:00", 3),
        ("e4", "page_html", "s", "h", "u", "c", None, None, "2024-01-01 00:03:00", 4),
        ("e5", "page_html", "s", "h", "u", "d", "r2", "k", "2024-01-01 00:04:00", 5),
        ("e6", "page_html", "s", "h", "u", "e", "r3", "k", "2024-01-01 00:05:00", 6),
    ]
    schema = (
        "id string, kind string, subject string, source string, request_url string, content_hash string, run_id string, "
        "explicit_key string, at string, write_seq long"
    )
    df = spark.createDataFrame(rows, schema).withColumn("observed_at", F.to_timestamp("at")).drop("at")
    for r in rows:
        df.where(F.col("id") == r[0]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        S.evidence_ingest(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect())
    want = sorted(r.id for r in O.dedupe_evidence(df).select("id").collect())
    assert len(got) == len(want) == 4
    assert {"e3", "e4"} <= set(got)
