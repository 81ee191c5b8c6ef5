"""Named queries on report tables, ladders, people and page rules, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, people, web
from ..operators import reports
from ..operators.audit import SPECIFICITY_CATEGORIES
from ..sources.views import CATEGORIES, Views
from .audit import WITH as AUDIT
from .audit import _judged, _terms
from .checks import _pick, _sql_pick
from .contacts import _list
from .leads import CATALOGUE as LEADS

SITE_TYPES = LEADS["site_types"][1]
LINES, COLUMNS = ["women", "men", "kids", "unisex"], ["shoes", "apparel", "accessories"]
PERSONAS, SCENARIOS = ["P0", "P1", "P2", "P3", "P9"], ["S0", "S1", "S2"]
REACTIONS = ["CLICKED", "IGNORED", "TRUST_DAMAGED", "NOTICED"]


def _grid(v: Views):
    k = F.col("query_id")
    judged = _judged(v).where(k % 7 != 0).select(F.when(k % 6 < 4, F.get(F.array(*map(F.lit, LINES)), (k % 6).cast("int"))).otherwise("men").alias("line"), F.get(F.array(*map(F.lit, COLUMNS[:2])), (k % 2).cast("int")).alias("col"), (F.col("severity") == "PASS").alias("ok"))
    return reports.grid(judged, LINES, COLUMNS)


_GRID = AUDIT + f""", j AS (SELECT CASE WHEN query_id % 6 < 4 THEN ({_list(LINES)})[query_id % 6 + 1] ELSE 'men' END AS line, ({_list(COLUMNS)})[query_id % 2 + 1] AS col, severity = 'PASS' AS ok FROM judged WHERE query_id % 7 <> 0),
  cells AS (SELECT line, col FROM (SELECT unnest({_list(LINES)}) AS line), (SELECT unnest({_list(COLUMNS)}) AS col)) SELECT line, col, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM cells LEFT JOIN j USING (line, col) GROUP BY 1, 2"""


def _runs(v: Views):
    k = F.col("s_suppkey")
    runs = v.table("supplier").groupBy((k % 4).alias("p"), (k % 3).alias("s")).agg(F.min(k).alias("k"))
    return runs.select(F.concat(F.lit("P"), F.col("p").cast("string")).alias("persona"), F.concat(F.lit("S"), F.col("s").cast("string")).alias("scenario"), ((F.col("k") % 5) * -0.1).alias("trust_delta"), F.get(F.array(*map(F.lit, REACTIONS)), (F.col("k") % 4).cast("int")).alias("reaction"))


_CELL = "max(CASE WHEN s = {i} THEN CASE WHEN r = 'CLICKED' THEN 'HELPFUL' WHEN r = 'TRUST_DAMAGED' OR d <= -0.3 THEN 'HARMFUL' ELSE 'NEUTRAL' END END) AS \"S{i}\""
_IMPACT = f"""WITH runs AS (SELECT s_suppkey % 4 AS p, s_suppkey % 3 AS s, min(s_suppkey) AS k FROM supplier GROUP BY 1, 2), l AS (SELECT p, s, (k % 5) * CAST(-0.1 AS DOUBLE) AS d, ({_list(REACTIONS)})[k % 4 + 1] AS r FROM runs)
  SELECT persona, {', '.join(_CELL.format(i=i) for i in range(3))} FROM (SELECT unnest({_list(PERSONAS)}) AS persona) LEFT JOIN l ON persona = 'P' || p GROUP BY 1"""


def _tried(v: Views):
    k = F.col("l_quantity").cast("int")
    lines = v.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    return lines.select(F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") - 1).alias("place"), (k % 3).alias("hits"), F.when(k % 17 == 0, "Query: 429").when(k % 11 == 0, "timeout").alias("error"))


_TRIED = """WITH t AS (SELECT l_orderkey AS plan_id, l_linenumber - 1 AS place, CAST(min(l_quantity) AS INT) AS k FROM lineitem GROUP BY 1, 2),
  s AS (SELECT *, k % 17 = 0 OR (sum(k % 3) OVER w >= 3 AND place >= 1) AS stops FROM t WINDOW w AS (PARTITION BY plan_id ORDER BY place ROWS UNBOUNDED PRECEDING))
  SELECT plan_id, place, k % 3 AS hits FROM (SELECT *, coalesce(bool_or(stops) OVER (PARTITION BY plan_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM s) WHERE NOT over"""


def _known(v: Views):
    k = F.col("s_suppkey")
    address = F.when(k % 4 != 0, F.concat(F.lit(" U"), (k % 50).cast("string"), F.lit("@D"), (k % 7).cast("string"), F.lit(".example")))
    return reports.known_addresses(v.table("supplier").select(k.alias("id"), address.alias("email"), F.when(k % 3 == 0, F.concat(F.lit("d"), (k % 5).cast("string"), F.lit(".example"))).alias("domain")))


_KNOWN = """WITH c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN 'u' || (s_suppkey % 50) || '@d' || (s_suppkey % 7) || '.example' END AS a, CASE WHEN s_suppkey % 3 = 0 THEN 'd' || (s_suppkey % 5) || '.example' END AS given FROM supplier),
  d AS (SELECT *, coalesce(given, split_part(a, '@', 2)) AS domain FROM c) SELECT id, domain, (SELECT count(DISTINCT o.a) FROM c o WHERE split_part(o.a, '@', 2) = domain AND o.a IS DISTINCT FROM d.a) AS known FROM d"""

def _flags(values) -> str:
    return "[" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in values) + "]"


_CEO = """SELECT s_suppkey, array_to_string(list_filter(['"' || s_name || '" CEO LinkedIn', 'site:linkedin.com/in "' || s_name || '" CEO', '"' || s_name || '" founder LinkedIn', CASE WHEN s_suppkey % 2 = 0 THEN '"' || s_name || '" CEO Norway LinkedIn' END, CASE WHEN s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0 THEN '"Ann Lee" "' || s_name || '" LinkedIn' END], lambda x: x IS NOT NULL), '|') AS searches FROM supplier"""


def _searches(v: Views):
    k = F.col("s_suppkey")
    found = people.role_searches(F.col("s_name"), F.lit("CEO"), F.when(k % 2 == 0, "EU").otherwise("US"), F.lit("Norway"), F.when(k % 3 == 0, "Ann Lee"))
    return v.table("supplier").select("s_suppkey", F.array_join(found, "|").alias("searches"))


def _furniture(v: Views):
    k = F.col("p_partkey")
    title = F.when(k % 5 == 0, _pick(web.FURNITURE_TITLES, "p_partkey")).when(k % 7 == 0, "Our Cookie wall").otherwise(F.col("p_name"))
    url = F.when(k % 3 == 0, "#top").when(k % 11 == 0, "https://policies.google.com/x").when(k % 13 == 0, "JavaScript:x").when(k % 17 != 0, F.lit("https://x.example/p"))
    return v.table("part").select("p_partkey", web.is_furniture(title, url).alias("furniture"), web.is_consent_artefact(title, url).alias("artefact"))


_LADDERS = AUDIT + f""", a AS (SELECT query, min(query_id) AS query_id, list_sort({_terms('query')}) AS terms FROM queries WHERE category IN ({', '.join(repr(c) for c in SPECIFICITY_CATEGORIES)}) GROUP BY query HAVING len({_terms('query')}) > 0),
  step AS (SELECT below, arg_min(query, [size, query_id]) AS next FROM (SELECT DISTINCT b.terms AS below, n.query, n.query_id, len(n.terms) AS size FROM a b JOIN a n ON len(b.terms) < len(n.terms) AND list_has_all(n.terms, b.terms)) GROUP BY below),
  RECURSIVE_PLACEHOLDER"""
_LADDERS = _LADDERS.replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "RECURSIVE_PLACEHOLDER",
    """c AS (SELECT [query] AS queries, terms, query AS tip FROM a UNION ALL SELECT list_append(queries, n.query), n.terms, n.query FROM c JOIN step ON below = c.terms JOIN a n ON n.query = step.next),
  e AS (SELECT DISTINCT queries FROM c WHERE len(queries) >= 3 AND terms NOT IN (SELECT below FROM step)),
  t AS (SELECT query, coalesce((SELECT avg(relevance_score) FROM scored s WHERE s.query_id = a.query_id AND original_rank <= 3), 0) AS top3 FROM a),
  r AS (SELECT queries, unnest(queries) AS query, unnest(range(len(queries))) AS rung FROM e),
  b AS (SELECT queries, query, rung, top3, lag(top3) OVER (PARTITION BY queries ORDER BY rung) AS before FROM r JOIN t USING (query))
  SELECT array_to_string(queries, ' > ') AS ladder, CAST(len(queries) AS INT) AS rungs, coalesce(arg_min(query, CASE WHEN top3 + 0.15 < before THEN rung END), '') AS break_query FROM b GROUP BY queries""",
)


def _people(v: Views):
    """People of a search and of a site for each nation, with names that are alike."""
    k = F.col("s_suppkey")
    name = F.concat_ws(" ", _pick(["Ann", "Bob", "Cy"], "s_suppkey"), F.when(k % 4 == 0, "Maria"), F.get(F.array(*map(F.lit, ["Lee", "Kim"])), (k % 2).cast("int")))
    base = v.table("supplier").select(F.col("s_nationkey").alias("row_key"), F.lit("CEO").alias("role"), k.alias("ord"), name.alias("full_name"), F.when(k % 3 == 0, F.concat(F.lit("https://l.example/"), k.cast("string"))).alias("link"), (k % 90).alias("rank_score"), F.when(k % 5 == 0, F.array(F.lit("CEO"))).otherwise(F.array().cast("array<string>")).alias("hints"))
    return reports.merged_people(base.where("ord % 2 = 0"), base.where("ord % 2 = 1"), base.where("link is not null").select("row_key", "role", F.col("link").alias("url")))


TITLES = ["Ann Lee – CEO – Acme | LinkedIn", "Bob Kim - Head of Product at Acme Foo - LinkedIn", "shop | CEO", "Cy Moss", "Dora Hill — Founder | Foo Bar | Baz | LinkedIn", "Foo, Eve Moss", "Eve Moss, CEO"]
PARSED = [("Ann Lee", "CEO", "Acme"), ("Bob Kim", "Head of Product", "Acme Foo"), (None, "CEO", ""), ("Cy Moss", "", ""), ("Dora Hill", "Founder", "Foo Bar"), (None, "", ""), (None, "", "")]
IN_TITLE = ["Ann Lee", "Bob Kim", None, "Cy Moss", "Dora Hill", None, "Eve Moss"]
SNIPPETS = ["Ann Lee is the founder. More", "We are; Bob Kim , head of product", "a. b. c. Cy Moss is late", "Dora Hill was", "no name"]
IN_SNIPPET = ["Ann Lee", "Bob Kim", None, None, None]


def _titles(v: Views):
    title = _pick(TITLES, "p_partkey")
    parts = people.profile_title(title)
    return v.table("part").select("p_partkey", parts["name"].alias("name"), parts["role"].alias("role"), parts["company"].alias("company"), people.name_in_title(title).alias("in_title"), people.name_in_snippet(_pick(SNIPPETS, "p_partkey")).alias("in_snippet"))


def _at(values, n: int) -> str:
    return f"({_flags(values)})[p_partkey % {n} + 1]"


def _two_phases(v: Views):
    k = F.col("s_suppkey")
    keys = [k.alias("row_key"), F.lit("CEO").alias("role")]
    supplier = v.table("supplier")
    roles = supplier.select(*keys, F.when(k % 3 != 0, F.col("s_name")).otherwise(" ").alias("name"), F.when(k % 5 == 0, "own@x.example").alias("email"))
    by_name = supplier.where("s_suppkey % 2 = 0").select(*keys, F.lit("n@x.example").alias("found"))
    by_domain = supplier.where("s_suppkey % 7 < 4").select(*keys, F.lit("d@x.example").alias("entry"), F.lit("Dora Hill").alias("entry_name"))
    return reports.ensured(reports.filled_in_two_phases(roles, by_name, by_domain), ["source", "note"])


_TWO = """SELECT s_suppkey AS row_key, 'CEO' AS role, CASE WHEN source = 'domain' AND s_suppkey % 3 = 0 THEN 'Dora Hill' WHEN s_suppkey % 3 <> 0 THEN s_name ELSE ' ' END AS name, CASE source WHEN 'kept' THEN 'own@x.example' WHEN 'name' THEN 'n@x.example' WHEN 'domain' THEN 'd@x.example' END AS email, source, CAST(NULL AS VARCHAR) AS note
  FROM (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN 'kept' WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 THEN 'name' WHEN s_suppkey % 7 < 4 THEN 'domain' ELSE 'missing' END AS source FROM supplier)"""


def _contact_page():
    """A page for each part that names its addresses in a link, in the text, bracketed and spaced, and again in capitals."""
    k = F.col("p_partkey").cast("string")
    parts = ['<p><a class="x" href="mailto:L', k, '@x.example?subject=a">mail</a> v', k, "@y.example, b", k, " [at] z.example s", k, " @ w.example V", k, "@Y.EXAMPLE g", k, "@gmail.com <script>no", k, "@q.example</script></p>"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _product_page():
    """A page for each part that declares a product in a list, one twice, and an offer with a low price."""
    k = F.col("p_partkey").cast("string")
    one = ['{"@type": "Product", "name": " Item ', k, ' ", "offers": [{"price": "', k, '", "priceCurrency": "EUR"}], "description": "d', k, '", "url": "https://x.example/', k, '"}']
    two = ['{"@type": ["Thing", "Service"], "name": "Service ', k, '", "offers": {"lowPrice": 7}, "@id": "#', k, '"}']
    parts = ['<html><script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"item": ', *one, '}, {"item": ', *one, '}]}</script><script type="application/ld+json">broken {</script><script type="application/ld+json">[', *two, "]</script></html>"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


CATALOGUE = {
    "product_page_items": (
        lambda v: v.table("part").select("p_partkey", F.inline(extract.declared_products(_product_page()))),
        "SELECT p_partkey, 'Item ' || p_partkey AS title, 'EUR ' || p_partkey AS price, 'd' || p_partkey AS snippet, 'https://x.example/' || p_partkey AS url FROM part UNION ALL SELECT p_partkey, 'Service ' || p_partkey, '7', NULL, '#' || p_partkey FROM part",
    ),
    "profile_titles": (_titles, f"SELECT p_partkey, {_at([p[0] for p in PARSED], 7)} AS name, {_at([p[1] for p in PARSED], 7)} AS role, {_at([p[2] for p in PARSED], 7)} AS company, {_at(IN_TITLE, 7)} AS in_title, {_at(IN_SNIPPET, 5)} AS in_snippet FROM part"),
    "filled_in_two_phases": (_two_phases, _TWO),
    "site_categories": (lambda v: v.table("pages").select("page_id", F.posexplode(reports.site_categories(F.nullif(web.site_type(F.col("html")), F.lit("PHYSICAL_GOODS")))).alias("place", "category")), "SELECT page_id, CAST(i AS INT) AS place, c[i + 1] AS category FROM (SELECT page_id, c, unnest(range(len(c))) AS i FROM (SELECT page_id, CASE WHEN type = 'SERVICES_EXPERIENCES' THEN " + _list(reports.SITE_CATEGORIES["SERVICES_EXPERIENCES"]) + " ELSE " + _list(reports.SITE_CATEGORIES["MARKETPLACE_MIXED"]) + " END AS c FROM (" + SITE_TYPES + ")))"),
    "pass_grid": (_grid, _GRID),
    "labelled_coverage": (lambda v: reports.labelled_coverage(_judged(v).select("category", (F.col("severity") == "PASS").alias("ok"))), AUDIT + f"SELECT CAST(l.place AS INT) AS place, label, category, count(*) FILTER (severity = 'PASS') AS passed, count(*) AS total, count(*) FILTER (severity = 'PASS') / count(*) AS rate FROM judged JOIN (SELECT unnest({_list(reports.COVERAGE_LABELS)}) AS category, unnest({_list(reports.COVERAGE_LABELS.values())}) AS label, unnest(range({len(reports.COVERAGE_LABELS)})) AS place) l USING (category) GROUP BY 1, 2, 3"),
    "impact_matrix": (lambda v: reports.impact_matrix(_runs(v), PERSONAS, SCENARIOS), _IMPACT),
    "planned_runs": (
        lambda v: reports.planned_runs(v.table("customer").select(F.col("c_mktsegment").alias("persona")).distinct(), v.table("orders").select(F.col("o_orderpriority").alias("scenario")).distinct()),
        "SELECT persona, scenario FROM (SELECT DISTINCT c_mktsegment AS persona FROM customer), (SELECT DISTINCT o_orderpriority AS scenario FROM orders)",
    ),
    "fetched_by_category": (lambda v: reports.fetched_by_category(v.queries(), v.scored()), AUDIT + "SELECT category, count(*) AS queries, CAST(sum(n) AS BIGINT) AS results, count(*) FILTER (n = 0) AS empty FROM (SELECT q.query_id, category, count(s.query_id) AS n FROM queries q LEFT JOIN scored s ON s.query_id = q.query_id GROUP BY 1, 2) GROUP BY 1"),
    "worst_ranked": (lambda v: _judged(v).where("failure_mode = 'POOR_RANKING'").orderBy(F.desc("displacement"), "query_id").limit(8).select("query_id", "displacement"), AUDIT + "SELECT query_id, displacement FROM judged WHERE failure_mode = 'POOR_RANKING' ORDER BY displacement DESC, query_id LIMIT 8"),
    "searched_until_enough": (lambda v: reports.until_enough(_tried(v)).select("plan_id", "place", "hits"), _TRIED),
    "known_addresses": (_known, _KNOWN),
    "adjusted_categories": (
        lambda v: v.table("supplier").select("s_suppkey", F.array_join(reports.adjusted(F.array(*map(F.lit, CATEGORIES[:4])), F.array(F.lit(CATEGORIES[1]), _pick(CATEGORIES[:4], "s_suppkey")), F.array(_pick(CATEGORIES, "s_suppkey")), F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit("TYPO")))), ",").alias("categories")),
        f"SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'TYPO' ELSE array_to_string(CASE WHEN list_contains(kept, a) THEN kept ELSE list_append(kept, a) END, ',') END AS categories FROM (SELECT s_suppkey, {_sql_pick(CATEGORIES, 's_suppkey')} AS a, list_filter({_list(CATEGORIES[:4])}, lambda c: c <> '{CATEGORIES[1]}' AND c <> {_sql_pick(CATEGORIES[:4], 's_suppkey')}) AS kept FROM supplier)",
    ),
    "page_furniture": (_furniture, f"SELECT p_partkey, list_contains({_list(web.FURNITURE_TITLES)}, t) OR u = '' OR u[1] = '#' OR contains(u, 'policies.google.com') AS furniture, contains(lower(t), 'cookie') OR starts_with(lower(u), 'javascript:') AS artefact FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN {_sql_pick(web.FURNITURE_TITLES, 'p_partkey')} WHEN p_partkey % 7 = 0 THEN 'Our Cookie wall' ELSE p_name END AS t, CASE WHEN p_partkey % 3 = 0 THEN '#top' WHEN p_partkey % 11 = 0 THEN 'https://policies.google.com/x' WHEN p_partkey % 13 = 0 THEN 'JavaScript:x' WHEN p_partkey % 17 <> 0 THEN 'https://x.example/p' ELSE '' END AS u FROM part)"),
    "role_searches": (_searches, _CEO),
    "query_ladders": (lambda v: reports.ladders(v.queries(), v.scored()).select(F.array_join("queries", " > ").alias("ladder"), "rungs", "break_query"), _LADDERS),
    "merged_people": (_people, None),
}
