"""What is costly for a row is worked out once for it, and by all cores when a small file holds all rows."""

from pyspark.sql import functions as F

from siteglass.operators import crawl_graph as G
from siteglass.operators import protocol_files as R
from siteglass.operators import query_intelligence as M
from siteglass.plans import compare_queries, log_queries
from siteglass.plans.catalog import Tables
from siteglass.sources import carriers as C


def counted(df, column):
    """`df` with a column that counts the rows it is read for."""
    reads = df.sparkSession.sparkContext.accumulator(0)

    def read(value):
        reads.add(1)
        return value

    return df.withColumn(column, F.udf(read, "string")(column)), reads


def test_intent_lowers_a_text_once(spark):
    queries = spark.createDataFrame([("Buy LOGIN",), (" how to order ",), ("x",), (None,)], "query string")
    found = M.query_intent(queries)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    got = {r["query"]: (r.intent, r.confidence) for r in found.collect()}
    assert got == {
        "Buy LOGIN": ("navigational", "high"), " how to order ": ("transactional", "high"), "x": ("informational", "low"), None: ("informational", "low"),
    }


def test_sitemap_files_are_read_once(spark):
    index = lambda i: f"<sitemapindex ><sitemap><loc>f{i + 1}</loc></sitemap></sitemapindex>"
    rows = [(f"f{i}", index(i)) for i in range(4)] + [("f4", "<urlset><url><loc>p</loc></url></urlset>")]
    files, reads = counted(spark.createDataFrame(rows, "url string, body string"), "body")
    declared = spark.createDataFrame([("s", "f0")], "site string, url string")
    assert [tuple(r) for r in R.sitemap_closure(declared.select("site"), declared, files).collect()] == [("s", "p")]
    assert reads.value == 5


def test_click_depth_reads_its_links_once(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "source string, target string")
    edges, reads = counted(links, "target")
    found = G.click_depth(edges, spark.createDataFrame([("0",)], "url string"))
    assert sorted((r.url, r.depth) for r in found.collect()) == [(str(i), i) for i in range(7)]
    assert reads.value == 6


def test_one_file_is_dealt_to_all_cores(spark, folder):
    t = Tables(spark, folder)
    cores = spark.sparkContext.defaultParallelism
    assert t.customer.rdd.getNumPartitions() < cores
    for rows in (C.robots_files(t.customer), C.sitemap_files(t.part), log_queries.log(t)):
        assert rows.rdd.getNumPartitions() >= cores


def test_schema_facts_are_worked_out_once(spark, folder):
    gaps = compare_queries.schema_gaps(Tables(spark, folder))
    assert "parquet" not in gaps._jdf.queryExecution().optimizedPlan().toString()


def test_counting_opportunities_does_not_write_them(spark, folder):
    rows = compare_queries.generated(Tables(spark, folder))
    assert len(rows.inputFiles()) > 0  # not a written copy: what a query does not need is left out of its plan
