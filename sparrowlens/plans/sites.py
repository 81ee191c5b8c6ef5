"""Named queries on workbooks, search addresses, roadmaps and written changes, each with the SQL that says the same."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import searches
from ..operators import identity
from ..sources import files, workbooks
from ..sources.views import Views
from ..streaming import changes
from .contacts import _list
from .pages import _name

COLUMNS = {"company_name": "Company Name", "website_url": "Website", "country": "Country", "estimated_revenue": "Revenue", "notes": "Notes"}


def _workbooks(v: Views):
    """A workbook per nation, written from its suppliers: strings in the table of strings and inline, numbers, blank companies and countries."""
    k = F.col("s_suppkey")
    cell = lambda col, kind, text: F.concat(F.lit(f'<c r="{col}'), (F.col("n") + 2).cast("string"), F.lit(f'"{kind}>'), text, F.lit("</c>"))
    numbered = v.table("supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("s"))
    each = numbered.select("s_nationkey", F.posexplode("s").alias("n", "x")).select("s_nationkey", "n", "x.*")
    country = F.when(k % 3 == 0, cell("C", ' t="inlineStr"', F.concat(F.lit("<is><t> Land "), (k % 7).cast("string"), F.lit(" </t></is>")))).otherwise("")
    row = F.concat(F.lit('<row r="'), (F.col("n") + 2).cast("string"), F.lit('">'), F.when(k % 5 != 0, cell("A", ' t="s"', F.concat(F.lit("<v>"), (F.col("n") + 5).cast("string"), F.lit("</v>")))).otherwise(""),
        cell("B", ' t="str"', F.concat(F.lit("<f>x</f><v>https://s"), k.cast("string"), F.lit(".example</v>"))), country, cell("D", "", F.concat(F.lit("<v>"), F.floor("s_acctbal").cast("string"), F.lit(".0</v>"))), F.lit("</row>"))
    text = F.concat(F.lit("<si><r><t>"), F.col("s_name"), F.lit("</t></r><r><t> &amp; Co</t></r></si>"))
    sheets = each.groupBy("s_nationkey").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c.alias("t")))), lambda x: x["t"]), "").alias(name) for name, c in (("rows", row), ("texts", text))])
    headers = [*COLUMNS.values()]
    head = '<row r="1">' + "".join(f'<c r="{"ABCDE"[i]}1" t="s"><v>{i}</v></c>' for i in range(5)) + "</row>"

    def zipped(rows: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for r, t in zip(rows.to_pylist(), texts.to_pylist()):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Leads" r:id="a"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
                z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="m"><sheetData>{head}{r}</sheetData></worksheet>')
                z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{h}</t></si>" for h in headers) + t + "</sst>")
            out.append(held.getvalue())
        return pa.array(out, pa.binary())

    files = sheets.select(F.concat(F.lit("/in/nation-"), F.col("s_nationkey").cast("string"), F.lit(".xlsx")).alias("path"), F.arrow_udf(zipped, "binary")("rows", "texts").alias("content"))
    return workbooks.normalised_rows(workbooks.sheet_rows(workbooks.sheet_cells(files)), COLUMNS, "Nowhere", "EU").drop("original_row")


QUERIES = ["?q={t}&page=2&sort=price%20up", "?ref=r1&Query={t}", "?id=0123456789abcdef01234567&find={t}", "?page=3&p=", "?q=&k={t}", "", "?utm=12&S={t}&pn=4"]


def _addresses(v: Views):
    """An address of a search per order: known names, names in capitals, names that aren't known, and none."""
    key = F.col("o_orderkey")
    query = F.get(F.array(*map(F.lit, QUERIES)), (F.col("o_custkey") % len(QUERIES)).cast("int"))
    term = F.concat(F.lit("red+"), (key % 5).cast("string"), F.lit("%26ring"))
    return v.table("orders").select(F.concat(F.lit("https://www.shop"), (key % 40).cast("string"), F.lit(".example/find"), F.replace(query, F.lit("{t}"), term)).alias("url"))


_TEMPLATES = f"""WITH u AS (SELECT 'https://www.shop' || (o_orderkey % 40) || '.example/find' || replace(({_list(QUERIES)})[o_custkey % {len(QUERIES)} + 1], '{{t}}', 'red+' || (o_orderkey % 5) || '%26ring') AS url FROM orders),
  p AS (SELECT url, split_part(url, '?', 1) AS base, list_transform(list_filter(string_split(split_part(url, '?', 2), '&'), lambda x: x <> ''), lambda x: struct_pack(name := split_part(x, '=', 1), value := url_decode(replace(split_part(x, '=', 2), '+', ' ')))) AS ps FROM u),
  h AS (SELECT *, list_filter(list_transform({_list(searches.SEARCH_NAMES)}, lambda n: list_filter(ps, lambda x: x.name = n AND x.value <> '')[1]), lambda x: x IS NOT NULL)[1] AS a,
      list_filter(list_transform({_list(searches.SEARCH_NAMES)}, lambda n: list_filter(ps, lambda x: lower(x.name) = n AND x.value <> '')[1]), lambda x: x IS NOT NULL)[1] AS b,
      list_filter(ps, lambda x: regexp_matches(x.value, '[a-z]') AND length(x.value) <= 120 AND NOT regexp_matches(x.value, '^[0-9a-f]{{24,}}$'))[1] AS c FROM p),
  k AS (SELECT *, coalesce(a, b, c) AS hit, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 3 END AS turn FROM h),
  t AS (SELECT regexp_extract(base, '://([^/]*)', 1) AS host, turn, hit.name AS param, hit.value AS term,
      base || coalesce('?' || nullif(array_to_string(list_transform(list_filter(ps, lambda x: NOT list_contains({_list(searches.PAGE_NAMES)}, lower(x.name))), lambda x: x.name || '=' || CASE WHEN x.name = hit.name THEN '{{}}' ELSE replace(url_encode(x.value), '%20', '+') END), '&'), ''), '') AS template FROM k WHERE hit IS NOT NULL),
  v AS (SELECT host, template, param, turn, count(*) AS votes, min(term) AS term FROM t GROUP BY 1, 2, 3, 4)
  SELECT host, template, term, param, CAST(turn AS INT) AS turn, votes FROM v QUALIFY row_number() OVER (PARTITION BY host ORDER BY turn, votes DESC, template) = 1"""

TITLES = ["Fix the relevance of {n}", "Ranking for {n}", "Ranking by brand for {n}", "Index {n}"]
NOTES = ["Impact: High | Effort: Medium (2 weeks)", "Impact: Low", "Effort: Major", ""]


def _roadmap(v: Views):
    """A roadmap per order with an item for each of its lines."""
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    lines = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    title = F.replace(pick(TITLES, F.col("l_suppkey")), F.lit("{n}"), F.col("p_name"))
    each = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", title.alias("title"), F.col("p_type").alias("about"), pick(NOTES, F.col("l_partkey")).alias("note")).alias("x"))
    texts = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    item = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". **"), x["title"], F.lit("**\n   About "), x["about"], F.lit(".\n   "), x["note"])
    text = F.concat(F.lit("\n"), F.array_join(F.transform("xs", item), "\n"), F.lit("\n"))
    return texts.select("l_orderkey", F.posexplode(searches.roadmap_items(text)).alias("place", "r")).select("l_orderkey", "place", "r.*")


_ROADMAP = f"""WITH t AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS place, replace(({_list(TITLES)})[l_suppkey % 4 + 1], '{{n}}', p_name) AS title, 'About ' || p_type || '.' AS about, ({_list(NOTES)})[l_partkey % 4 + 1] AS note FROM lineitem JOIN part ON p_partkey = l_partkey)
  SELECT l_orderkey, place, CASE WHEN contains(lower(title), 'relevance') OR (contains(lower(title), 'ranking') AND NOT regexp_matches(lower(title), '{'|'.join(searches.INTENTS)}')) THEN '{searches.INSTEAD}' ELSE title END AS title,
    about || CASE WHEN starts_with(note, 'Effort') THEN chr(10) || '   ' || note ELSE '' END AS description, regexp_extract(note, 'Impact: (\\w+)', 1) AS impact, regexp_extract(note, 'Effort: (.*)$', 1) AS effort,
    CASE regexp_extract(note, 'Impact: (\\w+)', 1) WHEN 'Critical' THEN 'critical' WHEN 'High' THEN 'high' ELSE 'moderate' END AS impact_class, CASE WHEN contains(note, 'Medium') THEN 'medium' WHEN contains(note, 'Major') THEN 'major' ELSE 'quick' END AS effort_class FROM t"""


def _merged(v: Views):
    """Customers after a stream of changes, one for each order in three batches, and some deleted at last; counted with their links."""
    folder, key = files.shared_folder(v.spark, "changes"), F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ["upsert", "upsert", "link", "unlink", "set_links"])), (key % 5).cast("int"))
    fields = F.when(kind == "upsert", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("id"), F.lit("never")))
    orders = v.table("orders").select(key.alias("ord"), kind.alias("op"), F.col("o_custkey").alias("id"), fields.alias("fields"), F.when(kind != "upsert", F.array(key % 7, key % 3)).alias("targets"))
    gone = v.table("customer").where("c_custkey % 10 = 3").select((F.col("c_custkey") + 1_000_000_000_000).alias("ord"), F.lit("delete").alias("op"), F.col("c_custkey").alias("id"), F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast("array<long>").alias("targets"))
    store = changes.Store(v.spark, f"{folder}/store", "id long, status string, name string", ["status"])
    store.start(v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("name")), v.spark.createDataFrame([], "id long, target long"))
    every = orders.unionByName(gone)
    cuts = [str(c) for c in orders.agg(F.expr("percentile_approx(ord, array(0.33, 0.66))")).first()[0]]
    for number, where in enumerate([f"ord <= {cuts[0]}", f"ord > {cuts[0]} and ord <= {cuts[1]}", f"ord > {cuts[1]}"]):
        store.merge(every.where(where), number)
    store.merge(every.where(f"ord > {cuts[1]}"), 2)  # delivered again
    entities, links = store.read()
    counts = links.groupBy(F.col("id").alias("i")).agg(F.count("*").alias("links"), F.sum("target").alias("targets"))
    return entities.join(counts, F.col("id") == F.col("i"), "left").select("id", "status", "name", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("targets", F.lit(0)).alias("targets"))


_MERGED = """WITH o AS (SELECT o_orderkey AS ord, o_custkey AS id, o_orderkey % 5 AS k, o_orderstatus AS status, unnest(list_distinct([o_orderkey % 7, o_orderkey % 3])) AS target FROM orders),
  s AS (SELECT id, max(ord) AS since FROM o WHERE k = 4 GROUP BY 1),
  t AS (SELECT id, target, arg_max(k, ord) AS k FROM o LEFT JOIN s USING (id) WHERE k >= 2 AND ord >= coalesce(since, -1) GROUP BY 1, 2),
  l AS (SELECT id, count(*) AS links, CAST(sum(target) AS BIGINT) AS targets FROM t WHERE k <> 3 GROUP BY 1),
  u AS (SELECT id, arg_max(status, ord) AS status FROM o WHERE k < 2 GROUP BY 1),
  e AS (SELECT c_custkey AS id, coalesce(u.status, c_mktsegment) AS status, c_name AS name FROM customer LEFT JOIN u ON u.id = c_custkey UNION ALL SELECT id, status, NULL FROM u WHERE id NOT IN (SELECT c_custkey FROM customer))
  SELECT e.id, e.status, e.name, coalesce(l.links, 0) AS links, coalesce(l.targets, 0) AS targets FROM e LEFT JOIN l ON l.id = e.id WHERE e.id % 10 <> 3 OR e.id NOT IN (SELECT c_custkey FROM customer)"""


ROLES = ["CEO", "HEAD_OF_PRODUCT", "HEAD_OF_ECOMMERCE", "HEAD_OF_GROWTH"]


def _found(v: Views):
    """Results of a search for a role at each order's company: profiles, pages, posts and goods, some of them twice."""
    k, name = F.col("l_suppkey"), _name()
    slug = F.concat(F.lit("https://www.linkedin.com/in/"), F.replace(F.lower(name), F.lit(" "), F.lit("-")), F.lit("?trk=x#y"))
    kinds = [("concat({n}, ' – CEO – Acme Tools | LinkedIn')", "''", "{s}"), ("concat({n}, ', Founder')", "'at work'", "'https://x.example/1'"), ("'Boots on sale'", "concat({n}, ' is here')", "'https://x.example/2'"), ("concat({n}, ' - CMO')", "''", "'https://x.example/posts/3'"), ("'x'", "concat({n}, ' is the founder of ACME')", "'https://x.example/4'"), ("'Profile'", "'growth lead'", "{s}")]
    lines = v.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey").withColumn("s_suppkey", k).withColumns({"n": name, "s": slug})
    pick = lambda j: F.coalesce(*[F.when(F.col("l_partkey") % 6 == i, F.expr(kind[j].format(n="n", s="s"))) for i, kind in enumerate(kinds)])
    role = F.get(F.array(*map(F.lit, ROLES)), (F.col("l_orderkey") % 4).cast("int"))
    rows = lines.select(F.col("l_orderkey").alias("row_key"), role.alias("role"), F.lit("Acme").alias("company_name"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("place"), pick(0).alias("title"), pick(1).alias("snippet"), pick(2).alias("url"), F.when((F.col("l_partkey") % 6).isin(0, 5), "PERSON_PROFILE").alias("link_type"), F.array().cast("array<string>").alias("signals"))
    found = identity.identity_candidates(rows.distinct())
    return found.withColumn("signals", F.array_join("signals", ",")).drop("url", "place")


_FOUND = """WITH l AS (SELECT DISTINCT l_orderkey AS row_key, l_orderkey % 4 AS r, l_partkey % 6 AS v, l_linenumber * 100000000 + l_partkey AS place, translate(CAST(l_suppkey AS VARCHAR), '0123456789', 'abcdefghij') AS t FROM lineitem WHERE l_partkey % 6 IN (0, 1, 4, 5)),
  c AS (SELECT row_key, r, place, v, 'M' || t || ' N' || t || 'o' AS full_name, CASE WHEN v IN (0, 5) THEN 'https://www.linkedin.com/in/m' || t || '-n' || t || 'o' ELSE '' END AS link FROM l),
  f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY row_key, full_name, link ORDER BY place, v) = 1)
  SELECT row_key, ['CEO', 'HEAD_OF_PRODUCT', 'HEAD_OF_ECOMMERCE', 'HEAD_OF_GROWTH'][r + 1] AS role, full_name, lower(full_name) AS normal, link, CASE WHEN v IN (0, 4) THEN 'Acme' ELSE '' END AS company,
    array_to_string(list_filter([CASE WHEN v IN (0, 5) THEN 'linkedin-profile-name' END, CASE WHEN v = 0 AND r = 0 THEN 'LINKEDIN_TITLE_ROLE_MATCH' END, CASE WHEN v = 0 THEN 'COMPANY_MATCH_FROM_TITLE' END, CASE WHEN v IN (0, 5) THEN 'LINKEDIN_PROFILE_SLUG_MATCHES_NAME' END, CASE WHEN v = 1 THEN 'title-name' END, CASE WHEN v = 4 THEN 'snippet-name' END, CASE WHEN (r = 0 AND v IN (0, 1, 4)) OR (r = 3 AND v = 5) THEN 'role-evidence' END], lambda x: x IS NOT NULL), ',') AS signals FROM f"""

OBSERVED = [["{f}.{l}", "info"], ["jane.doe", "info"], ["info", "shop"], [], ["j.roe", "k.poe", "gone@elsewhere"]]


def _decided(v: Views):
    """A person for each supplier; its pages show the person's address, another person's, shared ones only, none, or two of a form."""
    k = F.col("s_suppkey")
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    domain = F.concat(F.lit("d"), k.cast("string"), F.lit(".example"))
    own = v.table("supplier").select(k.alias("row_key"), F.lit("CEO").alias("role"), F.when(k % 11 != 0, _name()).alias("person_name"), F.when(k % 13 == 0, "gmail.com").otherwise(F.concat(F.lit("https://www."), domain, F.lit("/team"))).alias("website_url"), F.get(F.array(*map(F.lit, ["RESOLVED_STRONG", "RESOLVED_PROBABLE", "UNRESOLVED_WEAK"])), (k % 3).cast("int")).alias("role_status"), (k % 5).alias("v"), letters.alias("t"), domain.alias("d"))
    local = lambda text: F.concat(F.lit("m"), F.col("t"), F.lit(".n"), F.col("t"), F.lit("o")) if text.startswith("{") else F.lit(text)
    lists = F.coalesce(*[F.when(F.col("v") == i, F.array(*[local(t) if "@" in t else F.concat(local(t), F.lit("@"), F.col("d")) for t in texts]).cast("array<string>")) for i, texts in enumerate(OBSERVED)])
    observed = own.select("row_key", F.posexplode(lists).alias("ord", "email")).withColumn("ord", F.col("ord").cast("long"))
    people = own.where("v = 1").select("row_key", F.lit("Jane Doe").alias("full_name"))
    return identity.resolved_emails(own.select("row_key", "role", "person_name", "website_url", "role_status"), observed, people).withColumn("alternates", F.array_join("alternates", ","))


_DECIDED = """WITH o AS (SELECT s_suppkey AS k, s_suppkey % 5 AS v, 'm' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') AS f, 'n' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') || 'o' AS l, '@d' || s_suppkey || '.example' AS d,
      CASE WHEN s_suppkey % 11 = 0 THEN 'NO_PERSON' WHEN s_suppkey % 13 = 0 THEN 'PERSONAL_DOMAIN' END AS early FROM supplier),
  p AS (SELECT *, CASE v WHEN 1 THEN 'FIRST_LAST' WHEN 2 THEN 'UNKNOWN' WHEN 4 THEN 'F.DOT.LAST' END AS pattern, CASE v WHEN 1 THEN 65 WHEN 2 THEN 20 WHEN 3 THEN 30 WHEN 4 THEN 85 END AS base, CASE k % 3 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END AS role_points FROM o),
  s AS (SELECT *, base + role_points + CASE v WHEN 4 THEN 15 ELSE 0 END - CASE v WHEN 2 THEN 45 WHEN 3 THEN 15 ELSE 0 END AS score,
      list_distinct_in_order AS made FROM (SELECT *, CASE v WHEN 4 THEN [f[1] || '.' || l, f || '.' || l, f || l, f, f[1] || l] ELSE [f || '.' || l, f || l, f, f[1] || '.' || l, f[1] || l] END AS list_distinct_in_order FROM p))
  SELECT k AS row_key, 'CEO' AS role, CASE WHEN early IS NOT NULL THEN 'UNRESOLVED' WHEN v = 0 THEN 'RESOLVED_PUBLIC' WHEN score <= 0 THEN 'UNRESOLVED' ELSE 'RESOLVED_INFERRED' END AS status,
    CASE WHEN early IS NOT NULL THEN NULL WHEN v = 0 THEN f || '.' || l || d WHEN score > 0 THEN made[1] || d END AS email, CASE WHEN early IS NOT NULL THEN 0 WHEN v = 0 THEN 95 ELSE CAST(score AS INT) END AS score,
    CASE WHEN early IS NOT NULL THEN NULL WHEN v = 0 THEN 'STRONG' WHEN score <= 0 THEN NULL WHEN score >= 90 AND v IN (1, 4) THEN 'STRONG' WHEN score >= 70 THEN 'PROBABLE' ELSE 'WEAK' END AS label,
    CASE WHEN early IS NULL AND v > 0 THEN pattern END AS pattern, CASE WHEN early IS NOT NULL OR v = 0 THEN '' ELSE array_to_string(list_transform(made[2:], lambda x: x || d), ',') END AS alternates,
    CASE WHEN early IS NOT NULL THEN early WHEN v > 0 AND score <= 0 THEN 'LOW_CONFIDENCE' END AS issue FROM s"""


def _guessed(v: Views):
    """The provider of last resort for each supplier, with the addresses that a company's domain is known for."""
    k = F.col("s_suppkey")
    domain = F.concat(F.lit("d"), k.cast("string"), F.lit(".example"))
    known = F.when(k % 3 == 0, F.array(F.concat(F.lit("Jane.Doe@"), domain), F.lit("x@other.example"))).when(k % 3 == 1, F.array(F.concat(F.lit("info@"), domain)))
    rows = v.table("supplier").select(k.alias("contact_id"), F.when(k % 2 == 0, _name()).alias("full_name"), F.when(k % 4 == 1, F.get(F.split(_name(), " "), 0)).alias("first_name"), F.when(k % 4 == 1, F.get(F.split(_name(), " "), 1)).alias("last_name"), F.when(k % 17 == 0, "gmail.com").otherwise(domain).alias("company_domain"), known.alias("known"), F.lit(False).alias("allow_role"))
    return identity.guessed_emails(rows)


_GUESSED = """WITH o AS (SELECT s_suppkey AS k, 'm' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') || '.n' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') || 'o@d' || s_suppkey || '.example' AS e, s_suppkey % 4 = 3 AS nobody, s_suppkey % 17 = 0 AS personal FROM supplier)
  SELECT k AS contact_id, CASE WHEN nobody OR personal THEN NULL ELSE e END AS email, CASE WHEN nobody OR personal THEN 'unavailable' ELSE 'guessed' END AS status, CASE WHEN nobody OR personal THEN NULL ELSE CASE k % 3 WHEN 0 THEN 50 WHEN 1 THEN 20 ELSE 30 END END AS confidence,
    CASE WHEN nobody OR personal THEN 'not_found' ELSE 'found' END AS outcome, CASE WHEN nobody THEN 'no person name' WHEN personal THEN 'no candidate' END AS reason FROM o"""


CATALOGUE = {
    "workbook_rows": (
        _workbooks,
        "SELECT 'nation-' || s_nationkey || '.xlsx' AS source_file, 'Leads' AS sheet_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row_index, 'EU' AS region, s_name || ' & Co' AS company_name, 'https://s' || s_suppkey || '.example' AS website_url, CASE WHEN s_suppkey % 3 = 0 THEN 'Land ' || (s_suppkey % 7) ELSE 'Nowhere' END AS country, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS estimated_revenue, '' AS notes FROM supplier QUALIFY s_suppkey % 5 <> 0",
    ),
    "search_templates": (lambda v: searches.site_templates(_addresses(v)), _TEMPLATES),
    "roadmap_items": (_roadmap, _ROADMAP),
    "merged_changes": (_merged, _MERGED),
    "identity_candidates": (_found, _FOUND),
    "resolved_emails": (_decided, _DECIDED),
    "guessed_emails": (_guessed, _GUESSED),
}
