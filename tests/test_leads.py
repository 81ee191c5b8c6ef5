import pytest
from pyspark.sql import functions as F

from sparrowlens.functions import web
from sparrowlens.operators import results, scoring
from sparrowlens.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_plausible_names(spark):
    cases = {"Jane Doe": "PLAUSIBLE", "Acme Shop": "IMPLAUSIBLE", "Post by Acme": "IMPLAUSIBLE", "jane doe": "IMPLAUSIBLE", "": "IMPLAUSIBLE", None: "IMPLAUSIBLE", "Leadership Team": "IMPLAUSIBLE", "Müller Straße": "PLAUSIBLE"}
    rows = spark.createDataFrame([(k,) for k in cases], "name string")
    score, status = scoring.plausibility(F.col("name"), F.lit("Acme Goods"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert {r["name"]: r["s"] for r in rows.select("name", status.alias("s")).collect()} == cases
    score, _ = scoring.plausibility(F.lit("Jane Doe"), F.lit("Acme"), F.lit("https://www.linkedin.com/in/jane-doe"), F.lit("STRONG"))
    assert value(spark, score) == 50 + 25 + 10 + 20 + 15 + 10


def test_candidates_are_ranked(spark):
    candidates = spark.createDataFrame(
        [(1, "CEO", 1, "Jane Doe", "https://x.example/in/jane", "Jane Doe - CEO - Acme", "", "", ["role-evidence"]), (1, "CEO", 2, "Doe", None, None, "Former recruiter", None, None), (2, "CEO", 1, "A B", None, "", "", "", [])],
        "row_key int, role string, ord int, full_name string, link string, source_title string, source_snippet string, source_url string, signals array<string>",
    )
    tasks = spark.createDataFrame([(1, "Acme", "https://www.acme-goods.example", "EU", None)], "row_key int, company_name string, website_url string, region string, country string")
    people = spark.createDataFrame([(1, " jane  DOE ")], "row_key int, full_name string")
    links = spark.createDataFrame([(1, "https://x.example/in/jane")], "row_key int, url string")
    got = [(r.ord, r.rank_score, r.place) for r in scoring.candidate_ranks(candidates, tasks, people, links).orderBy("place").collect()]
    assert got == [(1, 40 + 20 + 25 + 8 + 8, 1), (2, -25 - 15 - 30, 2)]


def test_first_write_rule_counts(spark):
    schema = "row_key int, role string, field string, status string, value string, old_value string, column_exists boolean"
    rows = [(1, "CEO", "CEO_EMAIL", "APPROVED", "a", None, True), (2, "CEO", "CEO_EMAIL", "APPROVED", "a", "b", True), (3, "CEO", "CEO_EMAIL", "REVIEW", "a", "b", True), (4, "CEO", "CEO_EMAIL", "BLOCKED", None, None, True), (5, "CEO", "CEO_EMAIL", "BLOCKED", "a", None, True), (6, "CEO", "CEO_LINK", "APPROVED", "a", None, False), (7, "CEO", "CEO_LINK", "APPROVED", None, None, False)]
    got = {r.row_key: r.action for r in scoring.write_actions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "WRITE_CELL", 2: "SKIP_EXISTING_VALUE", 3: "SKIP_NOT_APPROVED", 4: "SKIP_EMPTY_VALUE", 5: "SKIP_BLOCKED", 6: "SKIP_COLUMN_MISSING"}


def test_pages(spark):
    assert value(spark, web.response_class(F.lit("<p>Just a moment...</p>"))) == "cloudflare" and value(spark, web.response_class(F.lit(None).cast("string"))) == "empty"
    assert value(spark, web.page_type(F.lit("https://x.example/ueber/team"), F.lit(""))) == "TEAM" and value(spark, web.page_type(F.lit("https://x.example/a"), F.lit("Kontakt"))) == "CONTACT"
    assert value(spark, web.price(F.lit("only 14,60 € today"))) == "14,60 €" and value(spark, web.price(F.lit("free"))) is None
    assert value(spark, web.link_type(F.lit("https://www.linkedin.com/in/a"))) == "PERSON_PROFILE" and value(spark, web.link_type(F.lit("https://x.example"))) is None
    lang = lambda html, url: value(spark, web.primary_language(F.lit(html), F.lit(url)))
    assert lang('<html lang="sv-SE"><p>x</p>', "https://x.example/") == "Swedish"
    assert lang('<html lang="en"><meta property="og:locale" content="de_DE">', "https://x.example/") == "German"
    assert lang('<html lang="en"><link rel="alternate" hreflang="en"><link rel="alternate" hreflang="fr-fr">', "https://x.example/") == "French"
    assert lang("<html>", "https://x.example/nl/a") == "Dutch" and lang("<html>", "https://x.cz/") == "Czech" and lang("<html>", "https://x.example/") == "English"
    assert lang("<p>" + "ab" * 150 + "æøæøæøæø</p>", "https://x.example/") == "Danish"


def test_junk_results_and_twins(spark):
    titles = ["Blue wool scarf", "Sale", "12345678", "Show more products", "Results for scarf", None, "Red wool scarf"]
    rows = spark.createDataFrame([(1, t, i) for i, t in enumerate(titles, 1)], "query_id int, title string, original_rank int")
    assert [(r.title, r.rank) for r in results.clean_results(rows).orderBy("rank").collect()] == [("Blue wool scarf", 1), ("Red wool scarf", 2)]
    judged = spark.createDataFrame([(1, "crème", "SYNONYM", 3, "OTHER", 0.9), (2, "creme", "SYNONYM", 0, "OTHER", None), (3, "naïve", "TYPO", 3, "OTHER", 0.9), (4, "café", "SYNONYM", 3, "OTHER", 0.1)], "query_id int, query string, category string, n_results int, failure_mode string, top_score double")
    got = {r.accented: (r.bucket, r.stripped, r.twin_bucket) for r in results.accent_twins(judged).collect()}
    assert got == {"crème": ("working", "creme", "revenue_risk"), "café": ("catastrophic", "cafe", None)}


def test_review_files(spark, tmp_path):
    header = " reviewId ," + ",".join(files.REVIEW_COLUMNS[1:])
    lines = [header, 'r1,w,3,"A, ""B""",CEO,b,HIGH,n,l,e, approve ', "", "r2,w,x,A,CEO,b,HIGH,n,l,e,", "r3,w,4rows,A,CEO,b,HIGH,n,l,e,", ",w,4,A,CEO,b,HIGH,n,l,e,", ",,,,,,,,,,APPROVE", "r4,w,4,A,CEO,b,HIGH,n,l,e,maybe"]
    (tmp_path / "d.csv").write_text("\n".join(lines) + "\n")
    good, bad = files.review_decisions(files.read_csv(spark, str(tmp_path / "d.csv")), ["APPROVE", "REJECT"])
    assert sorted((r.reviewId, r.rowIndex, r.company, r.humanDecision) for r in good.collect()) == [("r1", 3, 'A, "B"', "APPROVE"), ("r3", 4, "A", "SKIP")]
    assert sorted(r.error for r in bad.collect()) == ["invalid humanDecision", "invalid rowIndex", "missing reviewId"]
    with pytest.raises(ValueError):
        files.review_decisions(spark.createDataFrame([("a",)], "reviewId string"), [])
    rows = spark.createDataFrame([(1, ["a", "b"], 'q"x')], "id int, tags array<string>, note string")
    files.write_csv(rows, str(tmp_path / "out"), ["note", "id", "tags"])
    back = files.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["note", "id", "tags"] and tuple(back.first()) == ('q"x', "1", "a; b")


def test_slugs_are_kept_or_free(spark):
    companies = spark.createDataFrame([("a",), ("b",), ("b",)], "company string")
    none = spark.createDataFrame([], "company string, slug string")
    first = {r.company: r.slug for r in files.report_slugs(companies, none).collect()}
    taken = spark.createDataFrame([("a", "a-1234"), ("c", first["b"])], "company string, slug string")
    again = {r.company: r.slug for r in files.report_slugs(companies, taken).collect()}
    assert again["a"] == "a-1234" and again["b"].startswith("b-") and again["b"] != first["b"]
