from pyspark.sql import functions as F

from sparrowlens.functions import email, numbers, text
from sparrowlens.operators import audit, enrichment, outreach
from sparrowlens.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding(spark):
    assert value(spark, numbers.half_up(F.lit(-2.5))) == -2 and value(spark, numbers.half_up(F.lit(2.5))) == 3
    assert value(spark, numbers.half_even(F.lit(2.5))) == 2
    assert value(spark, numbers.percent(F.lit(1), F.lit(0))) == 0
    assert value(spark, numbers.leading_number(F.lit("12.5% of"))) == 12.5 and value(spark, numbers.leading_number(F.lit("x"))) is None


def test_text(spark):
    assert value(spark, text.without_accents(F.lit("Müßig Čapek"))) == "muessig capek"
    assert value(spark, text.query_terms(F.lit("The Dresses for the dresses, 2 a"))) == ["dresse"]
    assert value(spark, text.family_key(F.lit("Black Boots 12 New"))) == "boot"
    got = value(spark, text.fill_template(F.lit("Hi {{a}} {{b}} {{a}}"), F.create_map(F.lit("a"), F.lit("X"))))
    assert got == "Hi X {{b}} X"
    assert value(spark, text.website_key(F.lit("https://www.my-shop.example.com/x"))) == "myshop"
    assert value(spark, text.without_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert value(spark, text.headline_stat(F.lit("12%"), F.lit(None).cast("string"))).startswith("12% of searches returned zero")


def test_email_rules(spark):
    cases = {"a@gmail.com": "PERSONAL_DOMAIN", "info@x.example": "ROLE_INBOX", "a@b@c.example": "MALFORMED", "a@nodot": "INVALID_FORMAT", "a.b@x.example": None}
    rows = spark.createDataFrame([(k,) for k in cases], "e string").select("e", email.gate(F.col("e")).alias("g"), email.gate(F.col("e"), True).alias("r")).collect()
    assert {r.e: r.g for r in rows} == cases
    assert next(r.r for r in rows if r.e.startswith("info")) is None
    status = lambda guessed, verdict: value(spark, email.status(F.lit("a.b@x.example"), F.lit(guessed), F.lit(verdict).cast("string")))
    assert [status(False, "valid"), status(False, "invalid"), status(False, "accept_all"), status(False, None), status(True, None), status(True, "valid")] == ["verified", "invalid", "risky", "risky", "guessed", "verified"]
    assert value(spark, email.classify(F.lit("jdoe"), F.lit("Dr. Jane Doe"))) == "F_LAST"


def test_waterfall(spark):
    schema = "contact_id long, ord int, provider string, email string, status string, outcome string"
    rows = [(1, 1, "p", "a@x.example", "risky", "found"), (1, 2, "q", "b@x.example", "verified", "found"), (1, 3, "r", "c@x.example", "verified", "found"), (2, 1, "p", "d@x.example", "guessed", "found"), (2, 2, "q", "e@x.example", "risky", "found"), (3, 1, "p", None, "unavailable", "none")]
    got = {r.contact_id: (r.provider, r.status) for r in enrichment.waterfall(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("q", "verified"), 2: ("q", "risky")}


def test_top_priority_is_144(spark):
    schema = "row_key long, company_name string, website_url string, country string, category string, roles map<string,struct<name:string,link:string,email:string>>"
    tasks = enrichment.role_tasks(spark.createDataFrame([(1, "A", "https://a.example", "DE", "Fashion", {}), (2, None, "x", None, None, {})], schema)).collect()
    assert {(t.row_key, t.role): t.priority for t in tasks}[(1, "CEO")] == 144
    assert {t.status for t in tasks if t.row_key == 2} == {"SKIP_NO_COMPANY_NAME"}


def test_no_results_and_ties(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    results = spark.createDataFrame([(1, "x", 1, 0.5), (1, "y", 4, 0.9), (1, "z", 7, 0.9)], "query_id long, title string, original_rank int, relevance_score double")
    got = {r.query_id: r for r in audit.judge(audit.query_stats(queries, results)).collect()}
    assert (got[1].displacement, got[1].severity, got[2].displacement, got[2].severity) == (3, "MODERATE", 15, "CRITICAL")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "email.opened", "2024-01-01 00:00:00"), (1, "email.opened", "2024-01-01 00:05:00"), (1, "email.link_clicked", "2024-01-01 00:06:00"), (2, "email.bounced", "2024-01-01 00:07:00"), (9, "email.opened", "2024-01-01 00:08:00"), (1, "other", "2024-01-01 00:09:00")]
    spark.createDataFrame(rows, "provider_id long, type string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(1, 10), (2, 20)], "provider_id long, event_id long")
    table = spark.read.parquet(str(tmp_path / "in"))
    batch = sorted(map(tuple, events.counters(events.routed(table, known)).collect()))
    stream = events.counters(events.routed(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), known))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == batch and len(batch) == 2


def test_order_of_input_does_not_matter(spark):
    contacts = spark.createDataFrame([(i, f"a{i}@x.example" if i % 3 else "", "active", i % 2, "verified" if i % 5 else None) for i in range(50)], "id long, email string, status string, opt_out int, email_status string")
    a = sorted(map(tuple, outreach.readiness(contacts).collect()))
    assert a == sorted(map(tuple, outreach.readiness(contacts.repartition(7).orderBy(F.rand())).collect()))


def test_votes_of_many_addresses_and_names(spark):
    """Votes are those of all pairs of a domain, equal addresses and names that differ in the middle counted each."""
    words = ["ann", "bo", "ana", "lee", "le", "o-lee", "b"]
    names = [("d.example", f"{a} {m} {b}") for a in words for b in words for m in ("", "van")] + [("d.example", "ann"), ("e.example", "ann lee"), (None, "ann lee")]
    locals_ = ["ann.lee", "annlee", "alee", "a.lee", "ann", "lee", "anlee", "axolee", "b", "bb", "ab", "xle", "alee", "Alee"]
    emails = spark.createDataFrame([(f"{x}@d.example",) for x in locals_] + [("ann.lee@f.example",), ("zed@e.example",), ("info@d.example",)], "email string")
    own = spark.createDataFrame(names, "domain string, name string")
    pairs = emails.where("email like '%@d.example' and email not like 'info%'").crossJoin(own.where("domain = 'd.example'"))
    each = pairs.select(email.classify(F.lower(F.split("email", "@")[0]), F.col("name")).alias("p")).where("p <> 'UNKNOWN'").groupBy("p").agg(F.count("*").alias("n")).collect()
    got = {r.domain: (r.pattern, r.votes, r.confidence) for r in enrichment.pattern_votes(emails, own).collect()}
    best = max(each, key=lambda r: r.n)
    assert got == {"d.example": (best.p, best.n, 100), "e.example": ("UNKNOWN", 0, 30), "f.example": ("FIRST_LAST", 1, 50)}
    many = spark.range(30_000).select(F.lit("g.example").alias("domain"), F.concat(F.lit("ann x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("name"))
    votes = enrichment.pattern_votes(many.select(F.concat(F.lit("ann.x"), F.substr("name", F.lit(6)), F.lit("@g.example")).alias("email")), many).collect()
    assert [(r.pattern, r.votes, r.confidence) for r in votes] == [("FIRST_LAST", 30_000, 100)]  # 900 million pairs
