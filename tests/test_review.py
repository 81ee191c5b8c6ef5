import json

from pyspark.sql import functions as F

from sparrowlens.functions import extract, web
from sparrowlens.operators import enrichment, review, scoring


def test_addresses_of_a_page(spark):
    html = '<body><script>x@script.example</script><a href="mailto:Info@Acme.example?subject=x">write</a> jane.doe@acme.example, info@acme.example, bob [at] acme.example, eve @ acme.example, me@gmail.com</body>'
    rows = spark.createDataFrame([(html,), ("",), (None,)], "html string").select(extract.page_emails(F.col("html")).alias("e")).collect()
    got = [tuple(x) for x in rows[0].e]
    assert got == [("info@acme.example", "MAILTO"), ("jane.doe@acme.example", "VISIBLE_TEXT"), ("bob@acme.example", "OBFUSCATED_TEXT"), ("eve@acme.example", "OBFUSCATED_TEXT")]
    assert not rows[1].e and not rows[2].e


def test_profiles_of_a_page(spark):
    html = '<a href="https://www.linkedin.com/in/jane/">Jane</a> https://linkedin.com/company/acme?x=1 https://www.linkedin.com/in/jane'
    got = spark.createDataFrame([(html,)], "html string").select(extract.profile_links(F.col("html")).alias("p")).first().p
    assert [tuple(x) for x in got] == [("https://www.linkedin.com/in/jane", "PERSON_PROFILE"), ("https://linkedin.com/company/acme", "COMPANY_PAGE")]


def test_declared_products(spark):
    data = {"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": ["Product"], "name": " Scarf ", "offers": [{"price": 9, "priceCurrency": "EUR"}], "description": "d" * 400, "url": "/s"}}, {"@type": "Product", "name": "Hat", "offers": {"lowPrice": "5"}}, {"@type": "Product", "name": ""}]}
    page = f'<script type="application/ld+json">{json.dumps(data)}</script><script type="application/ld+json">no json</script><script>{{"@type": "Product", "name": "x"}}</script>'
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string").select("id", extract.declared_products(F.col("html")).alias("p")).orderBy("id").collect()
    assert [(p.title, p.price, len(p.snippet or ""), p.url) for p in rows[0].p] == [("Scarf", "EUR 9", 300, "/s"), ("Hat", "5", 0, None)]
    assert not rows[1].p and not rows[2].p


def test_approvals(spark):
    schema = "reviewId string, bucket string, humanDecision string, candidateName string, candidateLinkedin string, candidateEmail string"
    rows = [("1", "EMAIL_INFERRED_WEAK", "APPROVE_CANDIDATE", "n", "", "e"), ("2", "OTHER", "APPROVE_CANDIDATE", " ", "l", "e"), ("3", "OTHER", "APPROVE_EMAIL_ONLY", "n", "l", None), ("4", "OTHER", "APPROVE_ROLE_AND_LINKEDIN", "n", None, "e"), ("5", "OTHER", "SKIP", "n", "l", "e")]
    got = {r.reviewId: (r.approved, r.issues) for r in review.manual_approvals(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "1": (["NAME", "EMAIL"], []),
        "2": (["LINKEDIN"], ["APPROVE_CANDIDATE but no candidateName"]),
        "3": ([], ["APPROVE_EMAIL_ONLY but no candidateEmail"]),
        "4": (["NAME"], ["APPROVE_ROLE_AND_LINKEDIN but no candidateLinkedin"]),
        "5": ([], []),
    }


def test_names_that_match(spark):
    left = spark.createDataFrame([(1, "Jane Doe"), (1, "X"), (2, "Jane Doe")], "row_key int, full_name string")
    right = spark.createDataFrame([(1, "jane  DOE"), (1, "Doe Jane Marie"), (1, "Jane Smith"), (1, "x"), (2, None)], "row_key int, full_name string")
    got = sorted(map(tuple, review.name_matches(left, right).collect()))
    assert got == [(1, "Jane Doe", "Doe Jane Marie"), (1, "Jane Doe", "jane  DOE"), (1, "X", "x")]
    assert spark.range(1).select(enrichment.token_overlap(F.lit("a b doe"), F.lit("doe a")).alias("v")).first().v == 0.5


def test_first_person_with_address(spark):
    people = spark.createDataFrame([(1, 1, "A", None), (1, 2, "B", "b@x.example"), (2, 1, "C", None), (2, 2, "D", "")], "row_key int, ord int, name string, email string")
    assert {r.row_key: r.name for r in review.first_with_email(people).collect()} == {1: "B", 2: "C"}


def test_sites(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert value(web.site_type(F.lit("Add to cart, sku, $ 5"))) == "PHYSICAL_GOODS"
    assert value(web.site_type(F.lit("guided tours and lessons"))) == "SERVICES_EXPERIENCES"
    assert value(web.site_type(F.lit(None).cast("string"))) == "MARKETPLACE_MIXED"
    brands = [value(web.domain_brand(F.lit(u))) for u in ("https://www.acme.co.uk/x", "https://ACME.example", "https://localhost:80/", "nothing")]
    assert brands == ["Acme", "Acme", "Localhost", ""]


def test_who_may_be_looked_up(spark):
    schema = "id int, status string, opt_out int, email string, email_status string, reason string, domain string"
    rows = [(1, "active", 0, None, None, "r", "x"), (2, "active", 1, None, None, "r", "x"), (3, "bounced", 0, None, None, "r", "x"), (4, None, None, "a", "risky", None, "x"), (5, "active", 0, "a", "verified", "r", "x"), (6, "active", 0, "a", None, "r", "x"), (7, "active", 0, None, None, "r", "")]
    contacts = spark.createDataFrame(rows, schema)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(scoring.to_enrich(contacts)) == [1]
    assert ids(scoring.to_enrich(contacts, "run")) == [1, 4]
    assert ids(scoring.to_enrich(contacts, "run", again=True)) == [1, 4, 5, 6]


def test_people_of_a_role(spark):
    schema = "row_key int, role string, name string, link string, base_score int, n_search int, search_text string, website array<struct<title:string,page_type:string,hints:array<string>>>, n_links int"
    rows = [
        (1, "CEO", "Jane Doe", "l", 65, 2, "Jane Doe - CEO", [("Founder", "TEAM", ["CEO"])], 1),
        (2, "HEAD_OF_GROWTH", "Jane Doe", "l", 85, 2, "Jane", None, 0),
        (3, "CEO", "Jane Doe", None, 50, 1, "News: we are hiring", None, 0),
        (4, "HEAD_OF_PRODUCT", "Jane Doe", "l", 80, 2, "CPO", None, 0),
        (5, "CEO", "Jane Doe", None, 60, 2, "CEO", [("Founder", "LEGAL", ["CEO"])], 0),
        (6, "CEO", "Jane Doe", None, 70, 2, "CEO", [("Founder", "CAREERS", ["CEO"])], 0),
    ]
    got = {r.row_key: (r.score, r.explicit_role, r.status) for r in scoring.cluster_scores(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: (65 + 20 + 15 + 10 + 8, True, "RESOLVED_STRONG"),
        2: (85 + 20 - 20, False, "RESOLVED_PROBABLE"),
        3: (50 - 20 - 15 - 25, False, "UNRESOLVED_NONE"),
        4: (80 + 20, True, "RESOLVED_STRONG"),
        5: (60 + 20 + 15 + 8, True, "RESOLVED_STRONG"),
        6: (70 + 20 + 15, True, "RESOLVED_PROBABLE"),
    }
