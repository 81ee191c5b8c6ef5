"""People of pages: every way to name them, once each, with odd and broken markup."""

from sparrowlens.operators import staff


def people(spark, pages):
    rows = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(pages)], "page_id long, html string, name string")
    got = {}
    for r in sorted(staff.page_people(rows).collect()):
        got.setdefault(r.page_id, []).append((r.name, r.title, r.hints, r.evidence, r.signals))
    return got


def test_page_people(spark):
    pages = [
        None,
        "",
        "<h2>Ann Lee</h2>no parent, Founder",
        "<div><h1>ANN LEE</h1><h2>ann lee</h2><h3> Zoë \n de Ångström </h3>\n<p>VP  Product</p></div>",
        '<div class="x team-member y"><b>Bob Kim</b>\n— Growth Lead\nother</div><div class="our-staff"><i class="fullname">Cy Moss</i></div><div class="bio">no name</div>',
        "<ul><li>Eve Hill | CEO<li>Dora Moss, buyer<li>Gus Vane - cmo - Paris</ul><dl><dt>Ida Ray, CPO<dd>Jo Fox: CEO</dl>",
        "<section><h2>Bob Kim</h2><p>Bob Kim, CEO</p></section><div class=person><strong>bob kim</strong></div><p>" + "x" * 400 + "</p>",
        "<script>document.write('<h2>Ann Lee</h2>')</script><h2>Ann <!-- x -->Lee</h2>",
    ]
    got = people(spark, pages)
    assert not {0, 1} & set(got)
    assert got[2] == [("Ann Lee", "no parent, Founder", ["CEO"], "Ann Leeno parent, Founder", ["heading-element", "has-role-hint"])]
    # the title is looked for beside the name as it is written; a name with other spaces isn't cut out
    assert [p[0] for p in got[3]] == ["Zoë de Ångström"] and got[3][0][2] == [] and got[3][0][1] == "ANN LEEann lee Zoë"
    assert [(n, t, h, s[0]) for n, t, h, _, s in got[4]] == [("Bob Kim", "Growth Lead", ["HEAD_OF_GROWTH"], "team-card-pattern"), ("Cy Moss", "", [], "team-card-pattern")]
    assert [(n, t, h) for n, t, h, _, _ in got[5]] == [("Eve Hill", "CEO", ["CEO"]), ("Gus Vane", "cmo - Paris", ["HEAD_OF_GROWTH"]), ("Ida Ray", "CPO", ["HEAD_OF_PRODUCT"])]
    assert got[6] == [("Bob Kim", "Bob Kim, CEO", ["CEO"], "Bob KimBob Kim, CEO", ["heading-element", "has-role-hint"])]
    assert [p[0] for p in got[7]] == ["Ann Lee"]


def team(spark, pages):
    got = {}
    for r in sorted(staff.team_people(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()):
        got.setdefault(r.page_id, []).append((r.name, r.title, r.way))
    return got


def test_team_people(spark):
    ld = lambda text: f'<script type="application/ld+json">{text}</script>'
    pages = [
        None,
        "",
        ld('{"@type": "Person", "name": "Ann Lee", "jobTitle": "CEO"}') + ld("{broken") + ld('[{"@type": "Person", "name": "Bob Kim", "role": "Chef"}, {"@type": ["Person"], "name": "Not one"}, 5, "x", null]') + "<p>Cy Moss<p>CEO",
        ld('{"@type": "Organization", "member": {"name": "Eve Hill", "jobTitle": null, "role": "CTO"}, "founder": {"name": "Not read"}}') + ld('{"employee": [{"name": "Eve Hill", "jobTitle": "again"}, {"name": ""}, {"name": 5}, null, {"name": "Gus Vane"}]}'),
        "<p>Cy Moss<p>Head of Growth, Paris<p>Ida Ray<p>buyer",
        "<div>Managing   Director<br>Jo <b>Fox</b></div><div>CEO</div><div>x</div><p>Ann Lee<p>President<p>Bob Kim",
        ld("[]") + "<ul><li>Ann Lee<li>ceo<li>Ann Lee<li>founder</ul>",
        "<p>Ann Lee</p><script>CEO</script><p>Vp Digital",
    ]
    got = team(spark, pages)
    assert not {0, 1} & set(got)
    assert got[2] == [("Ann Lee", "CEO", "declared"), ("Bob Kim", "Chef", "declared")]
    assert got[3] == [("Eve Hill", "CTO", "declared"), ("Gus Vane", "", "declared")]
    assert got[4] == [("Cy Moss", "Head of Growth, Paris", "lines")]
    assert got[5] == [("Jo Fox", "Managing Director", "lines"), ("Ann Lee", "CEO", "lines"), ("Bob Kim", "President", "lines")]  # lines of one letter don't count
    assert got[6] == [("Ann Lee", "ceo", "lines")]
    assert got[7] == [("Ann Lee", "Vp Digital", "lines")]
