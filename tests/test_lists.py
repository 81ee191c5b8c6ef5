"""Follow-ups, variables, kept addresses, child lists, lookups, themes and cached answers with nulls, ties and nothing."""

from pyspark.sql import functions as F

from sparrowlens.operators import contacts, enrichment, outreach, reports, review
from sparrowlens.sources import files


def test_follow_ups(spark):
    schema = "reviewId string, source_file string, role string, humanDecision string, notes string, candidateName string, candidateLinkedin string, candidateEmail string, approved array<string>"
    rows = [("a", "EU x.xlsx", "CEO", "APPROVE_CANDIDATE", " ok ", "Ann", None, " ", ["NAME", "LINKEDIN", "EMAIL"]), ("b", None, "CEO", "APPROVE_ROLE_ONLY", None, "Bob", "l", "e", ["NAME"]), ("c", "US", "HEAD_OF_GROWTH", "D", "", "n", "link", "e", ["LINKEDIN"]), ("d", "US", None, "D", "", "n", "link", "e", ["NAME"]), ("e", "US", "CEO", "D", "", "n", "l", "e", []), ("f", "US", "CEO", "D", "", "n", "l", "e", None)]
    got = sorted(map(tuple, review.follow_up_actions(spark.createDataFrame(rows, schema)).collect()))
    assert [(r[0], r[3], r[4], r[5], r[8]) for r in got] == [
        ("a", "CEO / MD Name", "WRITE_CELL", "Ann", ["reviewId: a", "decision: APPROVE_CANDIDATE", "ok"]),
        ("b", "CEO / Founder Name", "WRITE_CELL", "Bob", ["reviewId: b", "decision: APPROVE_ROLE_ONLY"]),
        ("c", "HEAD_OF_GROWTH_LINKEDIN", "SKIP_COLUMN_MISSING", "link", ["Manually approved: D"]),
        ("d", "NAME", "SKIP_COLUMN_MISSING", "n", ["Manually approved: D"]),
    ]


def test_variables(spark):
    rows = [(1, {"top3rate": "5", "score": "", "other": "x", "outside3rate": None}, " Solr "), (2, None, None)]
    got = {r.id: r.v for r in spark.createDataFrame(rows, "id int, m map<string,string>, s string").select("id", contacts.task_variables(F.col("m"), F.col("s")).alias("v")).collect()}
    assert got[1] == {"top3rate": "5", "top_3_rate": "5", "search_platform_sentence": "This is a configuration and tuning gap on Solr — fixable without replatforming."}
    assert list(got[2]) == ["search_platform_sentence"]


def test_kept_addresses(spark):
    schema = "contact_id int, company_domain string, company_website string, existing_email string, existing_status string"
    rows = [(1, "a.example", None, "ann@a.example", "verified"), (2, None, "https://www.a.example/x", "ann@a.example", None), (3, " ", None, "ann@a.example", "verified"), (4, "a.example", None, "info@a.example", "verified"), (5, "a.example", None, None, None), (6, "a.example", None, "x@gmail.com", "risky")]
    attempts = spark.createDataFrame([(c, 1, "p", f"found{c}@a.example", "verified", "found") for c in (1, 2, 3, 4)] + [(5, 1, "p", None, None, "error")], "contact_id int, ord int, provider string, email string, status string, outcome string")
    run = lambda **k: {r.contact_id: (r.email, r.status, r.source, r.provider) for r in enrichment.enriched_emails(spark.createDataFrame(rows, schema), attempts, **k).collect()}
    kept, found, none = ("ann@a.example", "verified", "existing_crm", None), lambda c: (f"found{c}@a.example", "verified", "provider", "p"), (None, None, "none", None)
    assert run() == {1: kept, 2: ("ann@a.example", "risky", "existing_crm", None), 3: none, 4: found(4), 5: none, 6: none}
    assert run(reverify=True) == {1: kept, 2: found(2), 3: none, 4: found(4), 5: none, 6: none}
    assert run(allow_role=True)[4] == ("info@a.example", "verified", "existing_crm", None)


def test_lists_and_lookups(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 5), (3, "b", 1), (4, None, 9), (5, "a", 5)], "id int, parent string, at int")
    got = {(r.parent, r.place): r.id for r in outreach.child_lists(rows, "parent", [F.desc("at"), F.col("id")]).collect()}
    assert got == {("a", 1): 2, ("a", 2): 5, ("a", 3): 1, ("b", 1): 3}
    only = outreach.child_lists(rows, "parent", [F.col("id")], spark.createDataFrame([("b",), ("b",), ("z",)], "parent string")).collect()
    assert [(r.id, r.place) for r in only] == [(3, 1)]
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("q", 2), (None, 3)], "parent string, n int")
    found = sorted((r.n, r.id, r.at) for r in outreach.looked_up(asked, rows, "parent").collect())
    assert [f[:2] for f in found[:2]] == [(0, 1), (1, 1)] and found[2:] == [(2, None, None), (3, None, None)]
    sequences = spark.createDataFrame([(1, "late", 9), (2, "early", 1), (3, "none", 5)], "id int, name string, created_at int")
    steps = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (7, 1, "lost")], "sequence_id int, step_order int, subject string")
    assert [(r.name, [tuple(s) for s in r.steps]) for r in outreach.sequences_with_steps(sequences, steps).collect()] == [("early", [(1, "c")]), ("none", []), ("late", [(1, "a"), (2, "b")])]


def themes(spark, rows):
    (r,) = reports.title_themes(spark.createDataFrame(rows, "query_id int, query string, category string, severity string, failure_mode string, displacement int")).collect()
    return r.themes, r.title


def test_themes(spark):
    assert themes(spark, [(1, "red shoes", "X", "PASS", "BRAND_BLEED", 9)]) == ([], "")
    assert themes(spark, [(1, "x", "X", "CRITICAL", "POOR_RANKING", 9)]) == (["ranking"], "ranking")
    rows = [(1, "Blue Boots", "X", "MODERATE", "CATEGORY_MAPPING_FAILURE", 9), (2, " Hats ", "X", "CRITICAL", "CATEGORY_MAPPING_FAILURE", 1), (3, "very long query of many words", "X", "CRITICAL", "CATEGORY_MAPPING_FAILURE", 99), (4, "shoes and boots", "X", "CRITICAL", "NO_SEMANTIC_UNDERSTANDING", 0)]
    assert themes(spark, rows) == (["hats", "boots", "shoes"], "hats, boots, and shoes")
    rows = [(1, "spa bags", "BRAND_SEARCH", "MODERATE", "CONSTRAINT_DROPPED", 9)]
    assert themes(spark, rows) == (["brand", "bags", "attribute filters"], "brand, bags, and attribute filters")
    assert themes(spark, [(1, "x", "X", "MODERATE", "NO_SEMANTIC_UNDERSTANDING", 9), (2, "", None, "CRITICAL", "FACET_NOT_EXTRACTED", None)]) == (["shopping context", "attribute filters"], "shopping context and attribute filters")


def test_cache(spark):
    wanted = spark.createDataFrame([("k1", 1), ("k2", 2), ("k1", 3), (None, 4)], "key string, n int")
    cache = spark.createDataFrame([("k1", "old", 1), ("k1", None, 2), ("k1", "new", 3), ("k9", "x", 1)], "key string, value string, stored_at int")
    hits, rest = files.cached(wanted, cache)
    assert sorted((r.n, r.value) for r in hits.collect()) == [(1, "new"), (3, "new")] and sorted(r.n for r in rest.collect()) == [2, 4]
    assert spark.range(1).select(files.cache_key(F.lit("a"), F.lit(None), F.lit(3))).first()[0] == "7966d9af932e7c4c62b0f766aa52782f"
