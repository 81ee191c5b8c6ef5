"""Ladders, merged people, proof of stock, slugs and deliveries on small literal tables."""

from sparrowlens.operators import audit, contacts, reports
from sparrowlens.sources import files
from sparrowlens.streaming import events


def test_ladders(spark):
    texts = ["ring", "blue ring", "blue gold ring", "blue gold ring small", "red ring", "mat", "mat soft"]
    queries = spark.createDataFrame([(i, t, "MULTI_ATTRIBUTE") for i, t in enumerate(texts)] + [(20, "ring", "MULTI_ATTRIBUTE"), (21, "ring mat soft", "TYPO")], "query_id long, query string, category string")
    scores = {0: 0.9, 1: 0.8, 2: 0.5, 3: 0.5}
    results = spark.createDataFrame([(q, r, s if r <= 3 else 0.0) for q, s in scores.items() for r in (1, 2, 3, 4)], "query_id long, original_rank int, relevance_score double")
    got = {tuple(r.queries): (r.rungs, r.break_query) for r in reports.ladders(queries, results).collect()}
    assert got == {("ring", "blue ring", "blue gold ring", "blue gold ring small"): (4, "blue gold ring"), ("blue ring", "blue gold ring", "blue gold ring small"): (3, "blue gold ring")}
    assert reports.ladders(queries.where("false"), results).collect() == []


def test_merged_people(spark):
    found = [("r", "CEO", 1, "Ann Lee", None, 40), ("r", "CEO", 2, "ann  lee", "https://l/ann", 55), ("r", "CEO", 3, "Ann Maria Lee", "x", 10), ("r", "CEO", 4, "Bo", "x", 99), ("r", "CEO", 5, None, "x", 99), ("s", "CEO", 1, "Cy Kim", "https://l/cy", 1)]
    site = [("r", "CEO", 1, "Lee Ann", []), ("r", "CEO", 2, "Dora Hill", ["CEO"]), ("r", "CEO", 3, "Eve Moss", ["HEAD_OF_GROWTH"]), ("r", "CEO", 4, "Eve Moss", [])]
    got = reports.merged_people(
        spark.createDataFrame(found, "row_key string, role string, ord int, full_name string, link string, rank_score int"),
        spark.createDataFrame(site, "row_key string, role string, ord int, full_name string, hints array<string>"),
        spark.createDataFrame([("r", "CEO", "https://l/ann"), ("r", "CEO", "https://other")], "row_key string, role string, url string"),
    )
    assert sorted(map(tuple, got.collect())) == [("r", "CEO", 0, "Ann Lee", "https://l/ann", 55, 3, 1, 1), ("r", "CEO", 1, "Dora Hill", "", 0, 0, 1, 0), ("s", "CEO", 0, "Cy Kim", "https://l/cy", 1, 1, 0, 0)]


def test_proof_of_stock(spark):
    judged = [(1, "velvet curtain", 0), (2, "long velvet curtain grey", 3), (3, "curtain rod", 2), (4, "nothing alike", 0)]
    results = [(2, "Velvet curtain, grey", 1), (2, "Other", 2), (3, "Rod for curtain", 1)]
    args = spark.createDataFrame(judged, "query_id long, query string, n_results long"), spark.createDataFrame(results, "query_id long, title string, original_rank int")
    assert [tuple(r) for r in audit.proof_of_stock(*args).collect()] == [(1, "velvet curtain", "long velvet curtain grey", "Velvet curtain, grey")]
    assert audit.proof_of_stock(*args, most=0).collect() == []


def test_slugs_try_all_numbers(spark):
    from pyspark.sql import functions as F

    companies = spark.createDataFrame([("acme",), ("zoo",), ("known",)], "company string")
    tried = {r.slug for r in spark.range(8).select(F.concat(F.lit("acme-"), (F.pmod(F.xxhash64(F.lit("acme"), F.col("id").cast("int")), F.lit(9000)) + 1000).cast("string")).alias("slug")).collect()}
    registry = spark.createDataFrame([("other", s) for s in tried] + [("known", "known-1"), ("known", "")], "company string, slug string")
    got = {r.company: r.slug for r in files.report_slugs(companies, registry).collect()}
    assert got["known"] == "known-1" and got["acme"].startswith("acme-") and got["acme"] not in tried and got["zoo"].startswith("zoo-")


def test_import_and_repeated_deliveries(spark):
    rows = spark.createDataFrame([(1, " Ann ", "a@x", None, "odd", " ACME "), (2, "", "a@x", None, "active", None), (3, "Bo", " ", None, "active", None), (4, "Cy", "c@x", None, "", "nowhere")], "row int, name string, email string, role string, status string, company_name string")
    companies = spark.createDataFrame([(1, "Acme"), (7, "acme ")], "id long, name string")
    got = {r.row: r for r in contacts.import_contacts(rows, companies).collect()}
    assert (got[1].company_id, got[1].status, got[1].error, got[1].imported) == (7, "active", None, True)
    assert not got[2].imported and got[3].error == 'Row 3 ("Bo"): Missing required field "email". Skipped.' and got[4].imported and "nowhere" in got[4].error and got[4].status is None
    again = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "delivery_id string, n int").selectExpr("*", "timestamp'2024-01-01' as ts")
    assert events.deduplicated(again).count() == 2


def test_posts(spark, tmp_path):
    import pytest

    (tmp_path / "old.md").write_text('---\ntitle: "Old: one"\nexcerpt: e\ndate: 2023-01-02\ntags: [a]\n---\nText\n---\nmore')
    (tmp_path / "new.mdx").write_text("---\r\ntitle: 'New'\r\nexcerpt: e\r\ndate: 2024-05-01\r\n---\r\n# Head")
    (tmp_path / "other.txt").write_text("no post")
    got = files.read_posts(spark, str(tmp_path)).collect()
    assert [(r.slug, r.front["title"], r.front["date"], r.content) for r in got] == [("new", "New", "2024-05-01", "# Head"), ("old", "Old: one", "2023-01-02", "Text\n---\nmore")]
    (tmp_path / "bad.md").write_text("---\ntitle: x\n---\n")
    with pytest.raises(Exception, match="post bad lacks excerpt, date"):
        files.read_posts(spark, str(tmp_path)).collect()
