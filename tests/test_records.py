"""Checked rows, role decisions, slugs, lean pages and chunks on odd and missing values."""

from pyspark.sql import functions as F

from sparrowlens.functions import extract, text
from sparrowlens.operators import records, results


def checked(spark, table, schema, rows, **options):
    good, bad = records.validated(spark.createDataFrame(rows, schema), table, **options)
    return [r.asDict() for r in good.orderBy("k").collect()], {r.k: r.errors for r in bad.collect()}


def test_checked_rows(spark):
    good, bad = checked(spark, "contact", "k int, company_id string, name string, email string, extra int", [(1, "c", "Ann", "ann.lee+x@a-b.example", 7), (2, "", "Bob", "bob@x", 1), (3, "c", None, None, 1), (4, "c", "D", "a b@x.example", 1)])
    assert good == [{"k": 1, "company_id": "c", "name": "Ann", "email": "ann.lee+x@a-b.example", "extra": 7, "status": "active"}]
    assert bad == {2: ["Company is required", "Valid email is required"], 3: ["Contact name is required", "Valid email is required"], 4: ["Valid email is required"]}
    good, bad = checked(spark, "contact", "k int, name string, status string", [(1, None, None), (2, "x", "replied"), (3, "", "gone")], partial=True)
    assert [(r["k"], r["name"], r["status"]) for r in good] == [(1, None, None), (2, "x", "replied")] and bad == {3: ["Contact name is required", "status is none of active, bounced, unsubscribed, replied"]}
    good, bad = checked(spark, "step", "k int, step_order string, delay_days string", [(1, "1", None), (2, "0", "3"), (3, "2.5", "-1"), (4, None, "0"), (5, "99999999999999999999", "1")])
    assert [(r["step_order"], r["delay_days"]) for r in good] == [(1, 0)]
    assert bad == {2: ["step_order is no whole number from 1"], 3: ["step_order is no whole number from 1", "delay_days is no whole number from 0"], 4: ["step_order is required"], 5: ["step_order is no whole number from 1"]}
    good, bad = checked(spark, "enrollment", "k int, sequence_id string, contact_id string, send_hour int", [(1, "s", "c", None), (2, "s", "c", 23), (3, "s", "c", 24)])
    assert [r["send_hour"] for r in good] == [None, 23] and bad == {3: ["send_hour is no whole number from 0 to 23"]}
    good, _ = checked(spark, "sequence", "k int, name string", [(1, "n")])
    assert good[0]["is_active"] == 1 and good[0]["from_email"] is None


def test_role_decisions(spark):
    tasks = spark.createDataFrame([(1, "CEO"), (2, "CEO"), (3, "CEO"), (1, "CTO")], "row_key int, role string")
    schema = "row_key int, role string, name string, link string, score int, status string"
    scored = [(1, "CEO", n, "l", s, "RESOLVED_PROBABLE") for n, s in (("b", 70), ("a", 70), ("c", 95), ("d", 5), ("e", 1))] + [(2, "CEO", "x", None, 0, "UNRESOLVED_NONE"), (2, "CEO", "y", None, -5, "UNRESOLVED_NONE"), (9, "CEO", "z", None, 99, "RESOLVED_STRONG")]
    got = {(r.row_key, r.role): (r.name, r.score, r.status, r.alternates) for r in records.role_decisions(tasks, spark.createDataFrame(scored, schema)).collect()}
    none = (None, None, "UNRESOLVED_NONE", [])
    assert got == {(1, "CEO"): ("c", 95, "RESOLVED_PROBABLE", ["a", "b", "d"]), (2, "CEO"): (None, None, "UNRESOLVED_NONE", ["x", "y"]), (3, "CEO"): none, (1, "CTO"): none}


def test_slugs_and_order(spark):
    rows = spark.createDataFrame([("https://www.Shop-x.co.uk/a",), ("https://huckberry.com",), ("celio.cz/x",), (None,)], "u string").select(text.company_slug(text.host_slug(F.col("u"))).alias("s")).collect()
    assert [r.s for r in rows] == ["Shop_x", "huckberry", "celio_cz_x", None]
    names = spark.createDataFrame([(n,) for n in ("b", "B", "a", "Á", "C")], "n string")
    assert [r.n for r in names.orderBy(text.locale_order(F.col("n"))).collect()][:3] == ["a", "Á", "b"]


def test_lean_pages(spark):
    page = '<div class="a" style="x" onclick=\'y\' id=z>\n  \n\n<SCRIPT src="q">if (a < b)</script><a href="/p" target="_b" data-testid="t">x   y</a><svg><path d="1"></path></svg></div>  '
    rows = spark.createDataFrame([(page,), ("",), (None,)], "h string").select(extract.lean_html(F.col("h")).alias("l")).collect()
    assert [r.l for r in rows] == ['<div class="a" id=z>\n<a href="/p" data-testid="t">x y</a></div>', "", None]


def test_chunks_and_totals(spark):
    wanted = spark.createDataFrame([(f"q{i}", i) for i in range(9)], "query string, place int")
    done = spark.createDataFrame([("q0", 3), ("q2", 0), ("q0", 3)], "query string, n int")
    assert [r.query for r in results.next_chunk(wanted, done, "query", 3).collect()] == ["q1", "q3", "q4"]
    totals, empty = results.fetch_totals(spark.createDataFrame([("q0", 3), ("q2", 0), ("q4", None)], "query string, n int"))
    assert tuple(totals.first()) == (3, 3, 2) and sorted(r.query for r in empty.collect()) == ["q2", "q4"]
    assert tuple(results.fetch_totals(done.where("false"))[0].first()) == (0, 0, 0)
