"""Search addresses and roadmaps: rules on odd and broken texts."""

from pyspark.sql import functions as F

from sparrowlens.functions import searches


def test_search_template(spark):
    cases = {
        "https://www.x.example/search?query=spa": ("https://www.x.example/search?query={}", "spa", "query", 1),
        "HTTPS://X.example/s?a=b%20c&K=red+ring&page=2": ("https://X.example/s?a=b+c&K={}", "red ring", "K", 2),
        "https://x.example/?q=&s=&find=blue&q=late": ("https://x.example/?q=&s=&find={}", "blue", "find", 3),
        "https://x.example/?s=one&q=two": ("https://x.example/?s=one&q={}", "two", "q", 1),
        "https://x.example/?tags=%C3%A9t%C3%A9*~&q=1": ("https://x.example/?tags=%C3%A9t%C3%A9%2A~&q={}", "1", "q", 1),
        "https://x.example/?id=0123456789abcdef01234567&u=123e4567-e89b-12d3-a456-426614174000&n=42": None,
        "https://x.example/?w=ab%&z": ("https://x.example/?w={}&z=", "ab%", "w", 3),
        "https://x.example/path#?q=no": None,
        "no address": None,
        "": None,
    }
    rows = spark.createDataFrame([(u,) for u in [*cases, None]], "url string").select("url", searches.search_template(F.col("url")).alias("s")).collect()
    got = {r.url: tuple(r.s) if r.s else None for r in rows}
    assert got == {**cases, None: None}


def test_site_templates(spark):
    urls = ["https://a.example/s?q=x&page=1", "https://a.example/s?q=w&page=2", "https://a.example/t?q=1", "https://a.example/?find=everything", "https://A.example:80/?find=everything", "https://b.example/?Q=z", None, "x?q=y", "https://c.example/"]
    got = {r.host: tuple(r)[1:] for r in searches.site_templates(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got == {"a.example": ("https://a.example/s?q={}", "w", "q", 1, 2), "b.example": ("https://b.example/?Q={}", "z", "Q", 2, 1)}


def test_roadmap_items(spark):
    text = "Intro **bold** text\nImpact: none here\n1. **Improve relevance**\n   Do this.\n   And that.\n   Impact: Critical | Effort: Major (6 w)\n2.  **Boost ranking by brand** right away\n10. **Plain** Impact: High, Effort: one day\n3. no bold\n4. **Ranking**"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " \n"), (4, "x" * 100)], "id long, text string").select("id", F.inline(searches.roadmap_items(F.col("text")))).collect()
    got = [tuple(r)[1:] for r in rows if r.id == 1]
    assert got == [
        ("bold", "Intro **bold** text", "none", "", "moderate", "quick"),
        (searches.INSTEAD, "Do this.\n   And that.", "Critical", "Major (6 w)", "critical", "major"),
        ("Boost ranking by brand", "right away", "", "", "moderate", "quick"),
        ("Plain", "3. no bold", "High", "one day", "high", "quick"),
        (searches.INSTEAD, "", "", "", "moderate", "quick"),
    ]
    assert [tuple(r)[1:3] for r in rows if r.id == 4] == [("x" * 80, "x" * 100)] and {r.id for r in rows} == {1, 4}
