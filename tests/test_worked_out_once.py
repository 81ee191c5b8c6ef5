"""Rules that are heavy for each row stand once in a plan, and tables of few bytes are dealt to all cores."""

import duckdb
from pyspark.sql import functions as F

from sparrowlens import plans
from sparrowlens.functions import extract, searches, text
from sparrowlens.operators import identity
from sparrowlens.sources.views import Views

RESULTS = "row_key long, role string, company_name string, place long, title string, snippet string, url string, link_type string, signals array<string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_emails(spark):
    pages = spark.range(3).select(F.concat(F.lit('<a href="mailto:A@x.example">m</a> b@y.example a@X.example, c [at] z.example c@z.example '), "id").alias("html"))
    df = pages.select(F.inline(extract.page_emails(F.col("html"))))
    assert plan(df).count("mailto:") == 2  # once in the page, once in the rule
    assert [tuple(r) for r in df.limit(3).collect()] == [("a@x.example", "MAILTO"), ("b@y.example", "VISIBLE_TEXT"), ("c@z.example", "VISIBLE_TEXT")]


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = Views(spark, str(tmp_path)).spread("part", "p_partkey")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.agg(F.sum("p_partkey")).first()[0] == 499500


def test_identity_candidates(spark):
    rows = spark.createDataFrame([(1, "CEO", "Acme", 1, "Ann Lee - CEO at Acme", "", "https://x.example", None, [])], RESULTS)
    df = identity.identity_candidates(rows.distinct())
    assert plan(df).count("Org Chart") == 5  # title (two ways), snippet, profile's title and address
    assert [r.full_name for r in df.collect()] == ["Ann Lee"]


def test_roadmap_items(spark):
    df = spark.createDataFrame([("1. **Ranking for x**\n   y",)], "t string").select(F.inline(searches.roadmap_items(F.col("t"))))
    assert plan(df).count(r"\*\*(.+?)\*\*") == 1 and df.first().title == searches.INSTEAD


def test_phrases(spark):
    df = spark.createDataFrame([("Long velvet curtain",), (None,), ("",)], "q string").select(text.phrases(F.col("q")).alias("p"))
    assert plan(df).count("[^a-z0-9]+") == 1
    assert [r.p for r in df.collect()] == [["velvet curtain", "long velvet", "curtain", "velvet"], None, []]


def test_only_phrases_that_are_asked_for_are_counted(spark, tmp_path):
    part = [(k, name, "STANDARD") for k, name in enumerate(["silver kettle", "copper kettle", "silver teapot", "walnut board", "copper teapot", "steel board", "walnut spoon"])]
    orders = [(k,) for k in range(14)]
    lines = [(k, n, (k + n) % 7, 1, 1.0, 1.0, 0.05 * n) for k in range(14) if k % 5 for n in range(2)]
    for name, rows, schema in (("part", part, "p_partkey long, p_name string, p_type string"), ("orders", orders, "o_orderkey long"), ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double")):
        df = spark.createDataFrame(rows, schema)
        (df.withColumn("l_shipdate", F.lit("1995-01-01").cast("date")) if name == "lineitem" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    df = plans.queries()["proof_of_stock"](spark, str(tmp_path))
    assert "LeftSemi" in plan(df)
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(plans.oracle_sql()["proof_of_stock"]).fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and want
