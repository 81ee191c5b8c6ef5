"""Queries on stored pages give what their SQL gives, also for cut references and long addresses."""

import duckdb
import pytest

from sparrowlens import plans

PAGES = [(1, "https://a.example/" + "x" * 80 + "?a=1", "<body><article><h1>Rings &amp; things &amp;&amp</h1><p>Some words on rings</p></article></body>"), (2, "https://b.example/?q=" + "y" * 120, "<body><article><h1>Small &lt;b&gt; blue rings</h1><p>And &amplifiers</p></article></body>")]


@pytest.mark.parametrize("name", ["page_elements", "page_articles", "unwrapped_urls"])
def test_as_its_sql_says(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = plans.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cur.fetchall()) and df.count() == 2


def test_articles_whose_titles_speak_of_goods(spark, tmp_path):
    """An article isn't left out because its title begins like a heading above other goods or like a part of a page."""
    titles = ["Best und erge schheit", "New, of the", "BEST!! EIN!!", "Sale of an", "Voor allen", "Previous ones", "Sign in the", "Short 12", "12345678", "Seven l"]
    rows = [(i, f"https://a.example/{i}", f"<body><article><h1>{t}</h1></article></body>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(plans.oracle_sql()["page_articles"]).fetchall()
    assert sorted(tuple(r) for r in plans.queries()["page_articles"](spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 8
