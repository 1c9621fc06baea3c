"""Readers of stored folders: which files a site or a day reads, and logs with bad lines."""

from pyspark.sql import functions as F

from siteglass.operators import crawl_graph as G
from siteglass.sources import evidence_log as E
from siteglass.sources import tables as T


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_a_site_reads_its_own_bucket(spark, tmp_path):
    pages = spark.range(300).select(F.format_string("https://h%d.example/p%d", F.col("id") % 40, "id").alias("url"), F.lit("<p>x</p>").alias("html"))
    T.write_page_snapshot(T.as_snapshot(pages), str(tmp_path / "s"))
    found = T.site_snapshot(spark, str(tmp_path / "s"), "h7.example")
    want = [f"https://h7.example/p{i}" for i in range(300) if i % 40 == 7]
    assert sorted(r.url for r in found.collect()) == sorted(want)
    filters = next(line for line in plan(found).splitlines() if "PartitionFilters" in line)
    assert "host_bucket" in filters and "xxhash64" not in filters
    files = {r.f for r in found.select(F.input_file_name().alias("f")).collect()}
    assert len({f.split("host_bucket=")[1].split("/")[0] for f in files}) == 1
    assert T.site_snapshot(spark, str(tmp_path / "s"), "unknown.example").count() == 0


def test_days_are_partition_filters(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int) * 6)").alias("observed_at"))
    for part in (0, 1):
        E.append_evidence(rows.where(F.col("id").cast("int") % 2 == part), str(tmp_path / "log"))
    found = E.read_evidence(spark, str(tmp_path / "log"), since="2024-01-10 06:00:00", until="2024-01-11 12:00:00")
    assert sorted(int(r.id) for r in found.collect()) == list(range(37, 43))
    filters = next(line for line in plan(found).splitlines() if "PartitionFilters" in line)
    assert filters.count("observed_date") >= 2
    assert E.read_evidence(spark, str(tmp_path / "log")).count() == 200 and found.columns == ["id", "observed_at"]


def test_bad_lines_come_with_their_file(spark, tmp_path):
    for name, lines in {"a": ['{"id": "1", "status": 200}', '{"id": "2', ""], "b": ['{"id": "3"}', "no json", '{"id": "4", "unknown": 1}']}.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(lines))
    good, bad = E.read_log(spark, str(tmp_path / "in"))
    assert {(r.id, r.status) for r in good.collect()} == {("1", 200), ("3", None), ("4", None)}
    assert {(r.line, r.file[-7:]) for r in bad.collect()} == {('{"id": "2', "a.jsonl"), ("no json", "b.jsonl")}


def test_kept_and_cut_rows(spark):
    pages = spark.createDataFrame([("s", f"u{i}", i % 3) for i in range(10)] + [("t", "v", 5), (None, "w", 0)], "site string, url string, click_depth int")
    found = {(r.site, r.url): r.kept for r in G.crawl_rows(pages, 4).collect()}
    assert {u for (s, u), kept in found.items() if s == "s" and kept} == {"u0", "u3", "u6", "u9"} and found["t", "v"]
    assert len(found) == 12
