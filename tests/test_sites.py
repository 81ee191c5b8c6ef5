"""Addresses joined to their pages as browsers do, and facts of a shop's home page."""

from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from sparrowlens.functions import links
from sparrowlens.operators import sites

BASE = "https://www.X.example:443/a/b/page.html?x=1#top"


def test_addresses(spark):
    hrefs = ["c", "./c/", "../c?d=1#e", "../../../c", "/c/./d/../e", "//Y.example/z/", "?q=2", "#f", "", "HTTP://Z.example:80", "http://z.example:8080/k//", "mailto:a@b.example", "c/..", "  d\n ", "/"]
    rows = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", links.normal_url(F.col("h"), F.lit(BASE)).alias("u"), links.resolved(F.col("h"), F.lit(BASE)).alias("r")).collect()
    for r in rows:
        want = urlsplit(urljoin(BASE, r.h.strip().replace("\n", "")))
        if not want.netloc:
            assert r.u is None and r.r is None
            continue
        host = want.netloc.lower().removesuffix(":443" if want.scheme == "https" else ":80")
        query = f"?{want.query}" if want.query else ""
        assert r.u == f"{want.scheme}://{host}{want.path.rstrip('/') or '/'}{query}", r.h
        assert tuple(r.r) == (want.scheme, host, want.path or "/", query)
    odd = spark.createDataFrame([(None, BASE), ("x", None), ("x", "no base"), ("https://a.example/x/", "no base")], "h string, b string").select(links.normal_url(F.col("h"), F.col("b")).alias("u")).collect()
    assert [r.u for r in odd] == [None] * 4


def facts(spark, *pages):
    rows = spark.createDataFrame([(i, p, u) for i, (p, u) in enumerate(pages)], "page_id long, html string, url string")
    return {r.page_id: r for r in sites.site_facts(rows).collect()}


def test_site_facts(spark):
    page = """<html><head><meta name="Description" content="  Goods  for all "><meta name="description" content="second">
      <script type="application/ld+json">{"@graph": [{"@type": ["Thing", "Product"], "name": " Copper  kettle", "brand": {"@type": "Brand", "name": "Acme"}}, {"@type": "Offer", "name": "x", "brand": "Bolt"}]}</script>
      <script type="application/ld+json">{broken</script></head><body>
      <nav><a href="/">Home</a><a>Pots &amp; <b>pans</b></a><ul><li><a href="#">pots &amp; PANS</a><a>Lamps</a></ul></nav>
      <form action="/login"><input name="user"></form><form action="../find?x=1"><input type="text" name="lang"><input type="search" name="Text"></form>
      <a href="/brands/cup">Cup</a><a href="/brand/acme">acme</a><div class="brand-row">Dora<br>Ltd</div>
      <div class="ProductTile"><h3>Blue lamp</h3></div><div class="item"><a href="/x">Red lamp</a></div><div class="card">no name</div><p data-item-name="Green lamp" data-product-name="blue LAMP"></p></body>"""
    many = "<nav>" + "".join(f"<a>Category {i}</a>" for i in range(70)) + "</nav>"
    got = facts(spark, (page, "https://shop.example/en/index.html"), (None, None), ("", "x"), (many + '<a href="/s/search?page=1&K=lamp">s</a>', "https://y.example/"), ('<form action="search"></form>', "https://z.example/a/b"), ('<form><input name="q"></form>', "https://z.example"), ('<a href="/search?x=1">s</a>', "https://z.example/"))
    r = got[0]
    assert r.description == "Goods for all" or r.description == "Goods  for all"
    assert r.categories == ["Pots & pans", "Lamps"] and r.brands == ["Cup", "acme", "Bolt", "DoraLtd"]
    assert r.featured == ["Copper kettle", "Blue lamp", "Red lamp", "Green lamp"]
    assert r.search_template == "https://shop.example/find?Text={}"
    assert [tuple(got[i])[1:] for i in (1, 2)] == [("", [], [], [], "")] * 2
    assert len(got[3].categories) == 50 and got[3].search_template == "https://y.example/s/search?K={}"
    assert [got[i].search_template for i in (4, 5, 6)] == ["https://z.example/a/search?q={}", "https://z.example?q={}", "https://z.example/search?q={}"]


def test_site_names_and_links(spark):
    pages = [
        (0, '<meta property="og:site_name" content=" Acme "><title>Pots | Other</title>', "https://www.kettle-shop.co.uk/x"),
        (1, '<nav><a>Pots</a></nav><meta property="og:site_name" content="POTS"><title>a</title>', "https://www.kettle.example/x"),
        (2, "<title>Pots – Lamps - Cup</title>", "no address"),
        (3, "<nav><a>Cup</a></nav><title>Pots | Cup</title>", None),
        (4, None, None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, html string, url string")
    assert {r.page_id: r.name for r in sites.site_names(frame).collect()} == {0: "Acme", 1: "Kettle", 2: "Pots", 3: "", 4: ""} | {2: "Lamps - Cup"}
    body = "<a href='/team/'>Our team</a><a href='team'>again</a><a href='https://www.kettle.example/a/b/c'>deep</a><a href='/about'>About us</a><a href='/x.pdf'>file</a><a href='mailto:a@b.c'>m</a><a href='https://other.example/team'>no</a><a href='#top'>top</a><a>none</a><a href='/z'>z</a>"
    rows = spark.createDataFrame([(1, body, "https://kettle.example/"), (2, None, None), (3, body, None)], "page_id long, html string, url string")
    got = [tuple(r) for r in sites.internal_links(rows).orderBy("page_id", "place").collect()]
    assert [(r[2], r[3]) for r in got] == [("https://kettle.example/team", "TEAM"), ("https://kettle.example/about", "ABOUT"), ("https://kettle.example/z", "OTHER"), ("https://www.kettle.example/a/b/c", "OTHER")]
    assert len(sites.internal_links(rows, most=2).collect()) == 2


def test_merged_brands(spark):
    rows = spark.createDataFrame([(["Acme", " ", None], ["ACME", "Marken", "Bolt", "Zur Startseite", "bolt "]), (None, ["Cup"] * 3), (None, None)], "t array<string>, f array<string>")
    assert [r[0] for r in rows.select(sites.merged_brands(F.col("t"), F.col("f"))).collect()] == [["Acme", "Bolt"], ["Cup"], []]
    items = spark.createDataFrame([(["Kettle", "abcd", "Newsletter hier", "Was tun – bei Husten?", "Really?", "Oak – table", None],), (None,)], "i array<string>")
    assert [r[0] for r in items.select(sites.clean_featured(F.col("i"))).collect()] == [["Kettle", "Oak – table"], []]


def test_registry_and_export(spark, tmp_path):
    from sparrowlens.sources import files

    (tmp_path / "r.json").write_text('[{"name": "a", "url": "u", "more": 1}, {"name": "b", "url": ""}, {"name": "c"}]')
    (tmp_path / "broken.json").write_text("{no json")
    read = lambda name: [tuple(r) for r in files.read_registry(spark, f"file://{tmp_path}/{name}").collect()]
    assert read("r.json") == [("a", "u")] and read("broken.json") == [] and read("missing.json") == []
    frame = spark.createDataFrame([(1, 'say "x"', ["a", "b"])], "id int, name string, tags array<string>")
    files.export_all({"companies": (frame, ["name", "id"]), "contacts": (frame, ["id", "tags"])}, f"file://{tmp_path}/out")
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/out/companies-export").collect()] == [('say "x"', "1")]
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/out/contacts-export").collect()] == [("1", "a; b")]
