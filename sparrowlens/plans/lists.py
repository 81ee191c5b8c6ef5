"""Named queries on child lists, lookups, follow-ups, kept addresses, themes, caches and home pages, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, links, text, web
from ..operators import contacts, enrichment, outreach, records, reports, review, scoring, sites
from ..sources import files, nodes
from ..sources.views import Views
from .audit import WITH as AUDIT
from .audit import _judged
from .checks import _ATTEMPTS, _CLUSTERS, _attempts, _clusters
from .contacts import _list
from .leads import _NAV, _TYPE, DECISIONS, _decided
from .leads import CATALOGUE as LEADS
from .outreach import WITH as OUTREACH

LIST_ROLES = ["CEO", "HEAD_OF_PRODUCT", "HEAD_OF_ECOMMERCE", "HEAD_OF_GROWTH", "CTO"]


def _follow_ups(v: Views):
    k = F.col("reviewId")
    own = _decided(v).withColumns({"source_file": F.when(k % 2 == 0, F.concat(F.lit("EU "), k.cast("string"))).otherwise("US list"), "role": F.get(F.array(*map(F.lit, LIST_ROLES)), (k % 5).cast("int")), "notes": F.when(k % 9 == 0, " seen ")})
    approved = review.manual_approvals(own).select(F.col("reviewId").alias("_r"), "approved")
    return review.follow_up_actions(own.join(approved, k == F.col("_r"))).withColumn("evidence", F.array_join("evidence", "; "))


_COLUMN = "CASE " + " ".join(f"WHEN role = '{r}' AND field = '{f}' THEN " + (f"CASE WHEN eu THEN '{c['EU']}' ELSE '{c['US']}' END" if isinstance(c, dict) else f"'{c}'") for (r, f), c in review.FIELD_COLUMNS.items()) + " END"
_FOLLOW_UPS = f"""WITH d AS (SELECT p_partkey AS k, ({_list(DECISIONS)})[p_partkey % 8 + 1] AS d, p_partkey % 3 <> 0 AS n, p_partkey % 5 <> 0 AS l, p_partkey % 7 <> 0 AS e, p_partkey % 4 = 0 AS eb, p_partkey % 2 = 0 AS eu, ({_list(LIST_ROLES)})[p_partkey % 5 + 1] AS role FROM part),
  f AS (SELECT *, 'NAME' AS field, 'n' AS v FROM d WHERE n AND d IN ('APPROVE_CANDIDATE', 'APPROVE_ROLE_ONLY', 'APPROVE_ROLE_AND_LINKEDIN') UNION ALL SELECT *, 'LINKEDIN', 'l' FROM d WHERE l AND d IN ('APPROVE_CANDIDATE', 'APPROVE_ROLE_AND_LINKEDIN') UNION ALL SELECT *, 'EMAIL', 'e' FROM d WHERE e AND (d = 'APPROVE_EMAIL_ONLY' OR d = 'APPROVE_CANDIDATE' AND eb)),
  c AS (SELECT *, {_COLUMN} AS col FROM f)
  SELECT k AS "reviewId", role, field, coalesce(col, role || '_' || field) AS column_name, CASE WHEN col IS NULL THEN 'SKIP_COLUMN_MISSING' ELSE 'WRITE_CELL' END AS action, v AS new_value, CASE WHEN col IS NULL THEN 'No workbook column for ' || role || ' ' || field ELSE 'Manually approved via ' || d END AS reason, 'MANUAL_REVIEW' AS confidence,
    CASE WHEN col IS NULL THEN 'Manually approved: ' || d ELSE 'reviewId: ' || k || '; decision: ' || d END || CASE WHEN k % 9 = 0 THEN '; seen' ELSE '' END AS evidence FROM c"""


def _variables(v: Views):
    k = F.col("p_partkey")
    values = F.when(k % 4 != 0, F.create_map(F.lit("top3rate"), F.when(k % 3 != 0, k.cast("string")), F.lit("outside3rate"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")), F.lit("other"), F.lit("x")))
    own = v.table("part").select("p_partkey", contacts.task_variables(values, F.when(k % 2 == 0, F.col("p_brand"))).alias("m"))
    return own.select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("variables"))


_VARIABLES = """SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN a IS NOT NULL THEN 'top3rate=' || a END, CASE WHEN a IS NOT NULL THEN 'top_3_rate=' || a END, CASE WHEN b IS NOT NULL THEN 'outside3rate=' || b END, CASE WHEN b IS NOT NULL THEN 'outside_3_rate=' || b END,
    'search_platform_sentence=This is a configuration ' || CASE WHEN p_partkey % 2 = 0 THEN 'and tuning gap on ' || p_brand ELSE 'gap on your current search stack' END || ' — fixable without replatforming.'], lambda x: x IS NOT NULL)), ';') AS variables
  FROM (SELECT *, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS a, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN p_name END AS b FROM part)"""


def _enriched(v: Views):
    k = F.col("o_orderkey")
    address = F.get(F.array(*map(F.lit, [None, "ann@acme.example", "info@acme.example", "x@gmail.com", " bob@acme.example "])), (k % 5).cast("int"))
    rows = v.table("orders").select(k.alias("contact_id"), F.when(k % 7 != 0, "acme.example").alias("company_domain"), F.when(k % 14 == 0, "https://www.acme.example/x").alias("company_website"), address.alias("existing_email"), F.get(F.array(*map(F.lit, ["verified", "guessed", None])), (k % 3).cast("int")).alias("existing_status"))
    return enrichment.enriched_emails(rows, _attempts(v), reverify=True)


_ENRICHED = "WITH w AS (" + _ATTEMPTS + """),
  c AS (SELECT o_orderkey AS contact_id, trim(([NULL, 'ann@acme.example', 'info@acme.example', 'x@gmail.com', ' bob@acme.example '])[o_orderkey % 5 + 1]) AS e, o_orderkey % 3 = 0 AS verified, o_orderkey % 7 = 0 AND o_orderkey % 14 <> 0 AS lost FROM orders),
  s AS (SELECT c.*, w.provider AS p, w.email AS we, w.status AS ws, CASE WHEN lost THEN 'none' WHEN verified AND contact_id % 5 IN (1, 4) THEN 'existing_crm' WHEN w.email IS NOT NULL THEN 'provider' ELSE 'none' END AS source FROM c LEFT JOIN w USING (contact_id))
  SELECT contact_id, CASE source WHEN 'existing_crm' THEN e WHEN 'provider' THEN we END AS email, CASE source WHEN 'existing_crm' THEN 'verified' WHEN 'provider' THEN ws END AS status, source, CASE WHEN source = 'provider' THEN p END AS provider FROM s"""


def _children(parent: str):
    """Enrollments by a parent, the newest first."""
    return lambda v: outreach.child_lists(v.enrollments(), parent, [F.desc("started_at"), F.col("id")]).select(parent, "place", "id")


def _sequences(v: Views):
    parts = v.table("part")
    steps = parts.select((F.col("p_partkey") % 50).alias("sequence_id"), F.col("p_partkey").alias("step_order"), F.col("p_name").alias("subject")).where("sequence_id % 9 <> 0")
    sequences = parts.groupBy((F.col("p_partkey") % 50).alias("id")).agg(F.min("p_brand").alias("name"), F.sum("p_size").alias("created_at"))
    return outreach.sequences_with_steps(sequences, steps).select("id", "name", "created_at", F.size("steps").alias("n"), F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["step_order"].cast("string"), s["subject"])), ",").alias("steps"))


def _lookups(v: Views):
    """Messages by the id that a provider gave them, and ids that no message has."""
    known = v.table("orders").select(F.concat(F.lit("m"), (F.col("o_orderkey") * 2).cast("string")).alias("provider_id"), "o_orderkey", "o_orderstatus")
    asked = v.table("orders").select(F.concat(F.lit("m"), (F.col("o_orderkey") * 3).cast("string")).alias("provider_id"))
    return outreach.looked_up(asked, known, "provider_id")


def _themes(v: Views):
    parts = ["small", "ring", "widget", "gear"]
    mode = F.get(F.array(*map(F.lit, ["CATEGORY_MAPPING_FAILURE", "NO_FUZZY_MATCHING", "POOR_RANKING", "NO_SEMANTIC_UNDERSTANDING", "CONSTRAINT_DROPPED"])), (F.col("query_id") % 5).cast("int"))
    judged = _judged(v).withColumn("failure_mode", mode)
    every = [reports.title_themes(judged.where(F.col("capability") == c), parts).select(F.lit(c).alias("capability"), F.array_join("themes", ",").alias("themes"), "title") for c in ("PRODUCT_DISCOVERY", "FILTERS_CONSTRAINTS", "BRAND_MODEL_SEARCH")]
    return every[0].unionAll(every[1]).unionAll(every[2])


_THEMES = AUDIT + """, f AS (SELECT query_id, category, capability, severity, displacement, lower(trim(query)) AS q, query_id % 5 AS m, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END, displacement DESC, query_id) AS w FROM judged WHERE severity IN ('CRITICAL', 'MODERATE') AND capability IN ('PRODUCT_DISCOVERY', 'FILTERS_CONSTRAINTS', 'BRAND_MODEL_SEARCH')),
  t AS (SELECT capability, term, count(*) AS n, min(w * 1000 + p) AS first FROM (SELECT capability, w, unnest(string_split(q, ' ')) AS term, generate_subscripts(string_split(q, ' '), 1) AS p FROM f) WHERE term IN ('small', 'ring', 'widget', 'gear') GROUP BY 1, 2),
  top AS (SELECT capability, list(term ORDER BY n DESC, first) AS terms FROM t GROUP BY 1),
  o AS (SELECT capability, arg_min(CASE WHEN m = 0 AND len(string_split(q, ' ')) <= 3 THEN q END, CASE WHEN m = 0 AND len(string_split(q, ' ')) <= 3 THEN w END) AS missed, bool_or(m = 1 OR category = 'BRAND_SEARCH') AS brand, bool_or(m = 3) AS context, bool_or(m = 4) AS filters FROM f GROUP BY 1),
  a AS (SELECT capability, context, filters, list_filter(list_concat([missed, CASE WHEN brand THEN 'brand' END], coalesce(terms, [])), lambda x: x IS NOT NULL)[:3] AS x FROM o LEFT JOIN top USING (capability)),
  b AS (SELECT capability, CASE WHEN len(x) < 3 AND context AND filters THEN list_concat(x, ['shopping context', 'attribute filters'])[:3] WHEN len(x) < 3 AND context THEN list_append(x, 'shopping context') WHEN len(x) < 3 AND filters THEN list_append(x, 'attribute filters') ELSE x END AS x FROM a)
  SELECT capability, array_to_string(x, ',') AS themes, CASE WHEN len(x) < 3 THEN array_to_string(x, ' and ') ELSE x[1] || ', ' || x[2] || ', and ' || x[3] END AS title FROM b"""


def _cached(v: Views):
    """Companies to be looked at, of which some were before, some of them twice."""
    k = F.col("s_suppkey")
    key = files.cache_key(F.lit("leads.xlsx"), F.lit("Leads"), k, F.concat(F.lit("s"), k.cast("string"), F.lit(".example")))
    wanted = v.table("supplier").select(k.alias("row"), key.alias("key"))
    old = v.table("supplier").where("s_suppkey % 3 = 0").select(key.alias("key"), F.lit("old").alias("value"), F.lit(1).alias("stored_at"))
    new = v.table("supplier").where("s_suppkey % 6 = 0").select(key.alias("key"), F.col("s_name").alias("value"), F.lit(2).alias("stored_at"))
    hits, rest = files.cached(wanted, old.unionAll(new))
    return hits.select("row", "key", "value").unionAll(rest.select("row", "key", F.lit(None).cast("string")))


def _facts(v: Views):
    facts = sites.site_facts(v.table("pages"))
    return facts.select("page_id", "description", F.array_join("categories", "|").alias("categories"), F.size("brands").alias("brands"), F.array_join("featured", "|").alias("featured"), "search_template")


_FACTS = f"""SELECT page_id, '' AS description, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[:50], '|'), '') AS categories, 0 AS brands, '' AS featured, '' AS search_template
  FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(coalesce(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), ''), '<a href="[^"]*">([^<]*)</a>', 1), lambda x: trim(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))), lambda x: x <> '' AND len(x) <= 80 AND NOT list_contains({_list(sites.MENU)}, lower(x))) AS l FROM pages)"""


def _urls(v: Views):
    found = nodes.page_nodes(v.table("pages")).where("tag = 'a'").select(F.col("page_id").alias("_i"), "pre", F.col("attrs")["href"].alias("href"))
    both = v.table("pages").select("page_id", "url").join(found, F.col("page_id") == F.col("_i"))
    return both.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", links.normal_url(F.col("href"), F.col("url")).alias("u")))), lambda x: x["u"]), " ").alias("urls"))


_URLS = """SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda h: lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || replace(replace(h, '&amp;', '&'), '&quot;', '"')), ' ') AS urls FROM pages WHERE contains(html, '<a href="/')"""
_INTERNAL = f"""WITH {_NAV}, u AS (SELECT page_id, place, label, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '[#].*$', ''), '/+(\\?|$)', '\\1') AS home, '/' || label AS href FROM nav),
  a AS (SELECT page_id, place, label, host || rtrim(href, '/') AS url FROM u WHERE label <> '' AND host || href <> home AND NOT list_contains({_list(web.FILE_ENDINGS)}, regexp_extract(lower(href), '\\.([^./]*)$', 1))),
  b AS (SELECT *, lower(url || ' ' || label) AS b FROM a QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY place) = 1),
  t AS (SELECT *, {_TYPE} AS type, CAST(10 * len(list_filter({_list(web.PAGE_WORDS)}, lambda w: contains(b, w))) - 2 AS INT) AS relevance FROM b)
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY type = 'OTHER', relevance DESC, place) AS INT) AS place, url, type, label, relevance FROM t QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY type = 'OTHER', relevance DESC, place) <= 9"""
_PLACE = "CAST(row_number() OVER (PARTITION BY {p} ORDER BY started_at DESC, id) AS INT)"

STATUSES = ["prospect", "won", "lost", "new", None]


def _companies(v: Views):
    """Rows to be taken in as companies: some without a name or with another status; the good ones with defaults, the others with why."""
    k = F.col("c_custkey")
    rows = v.table("customer").select(k, F.when(k % 7 == 0, "").when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("name"), F.get(F.array(*map(F.lit, STATUSES)), (k % 5).cast("int")).alias("status"))
    good, bad = records.validated(rows, "company")
    return good.select("c_custkey", "status", F.lit("").alias("errors")).unionAll(bad.select("c_custkey", "status", F.array_join("errors", "; ")))


_COMPANIES = f"""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name, (['prospect', 'won', 'lost', 'new', NULL])[c_custkey % 5 + 1] AS status FROM customer),
  e AS (SELECT *, list_filter([CASE WHEN coalesce(name, '') = '' THEN 'Company name is required' END, CASE WHEN NOT list_contains({_list(records.COMPANY_STATUSES)}, status) THEN 'status is none of {', '.join(records.COMPANY_STATUSES)}' END], lambda x: x IS NOT NULL) AS e FROM r)
  SELECT c_custkey, CASE WHEN len(e) = 0 THEN coalesce(status, 'prospect') ELSE status END AS status, coalesce(array_to_string(e, '; '), '') AS errors FROM e"""


def _decisions(v: Views):
    scored = scoring.cluster_scores(_clusters(v)).withColumns({"row_key": F.floor(F.col("row_key") / 4), "link": F.when(F.col("row_key") % 2 == 0, "https://l.example/in/x")})
    tasks = v.table("part").select(F.floor(F.col("p_partkey") / 2).alias("row_key"), F.get(F.array(*map(F.lit, ["CEO", "HEAD_OF_PRODUCT"])), (F.col("p_partkey") % 2).cast("int")).alias("role"))
    return records.role_decisions(tasks, scored).withColumn("alternates", F.array_join("alternates", ","))


_DECISIONS = "WITH q AS (" + _CLUSTERS + """),
  c AS (SELECT q.row_key // 4 AS row_key, role, p_name AS name, CASE WHEN q.row_key % 2 = 0 THEN 'https://l.example/in/x' END AS link, score, status FROM q JOIN part ON p_partkey = q.row_key),
  b AS (SELECT row_key, role, list(struct_pack(name, link, score, status) ORDER BY score DESC, name) AS l FROM c GROUP BY 1, 2)
  SELECT p_partkey // 2 AS row_key, CASE p_partkey % 2 WHEN 0 THEN 'CEO' ELSE 'HEAD_OF_PRODUCT' END AS role, CASE WHEN ok THEN l[1].name END AS name, CASE WHEN ok THEN l[1].link END AS link, CASE WHEN ok THEN l[1].score END AS score, coalesce(l[1].status, 'UNRESOLVED_NONE') AS status,
    coalesce(array_to_string(list_transform(l[CASE WHEN ok THEN 2 ELSE 1 END:CASE WHEN ok THEN 4 ELSE 3 END], lambda x: x.name), ','), '') AS alternates
  FROM (SELECT p_partkey, l, coalesce(l[1].status <> 'UNRESOLVED_NONE', false) AS ok FROM part LEFT JOIN b ON b.row_key = p_partkey // 2 AND b.role = CASE p_partkey % 2 WHEN 0 THEN 'CEO' ELSE 'HEAD_OF_PRODUCT' END)"""

CATALOGUE = {
    "checked_companies": (_companies, _COMPANIES),
    "role_decisions": (_decisions, _DECISIONS),
    "company_slugs": (
        lambda v: v.table("pages").select("page_id", text.company_slug(text.host_slug(F.col("url"))).alias("slug")),
        f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'www.', ''), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^www_', ''), '{text.SUFFIX}', '') AS slug FROM pages",
    ),
    "lean_pages": (
        lambda v: v.table("pages").select("page_id", F.md5(extract.lean_html(F.col("html"))).alias("lean")),
        r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|svg|path|noscript)[^>]*>.*?</(?:script|style|svg|path|noscript)>', '', 'g'), '\s+(?:lang|charset)="[^"]*"', '', 'g'), '
\s*
+', chr(10), 'g'), '[ 	]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS lean FROM pages""",
    ),
    "follow_up_actions": (_follow_ups, _FOLLOW_UPS),
    "task_variables": (_variables, _VARIABLES),
    "enriched_emails": (_enriched, _ENRICHED),
    **{f"enrollments_by_{n}": (_children(p), OUTREACH + f"SELECT {p}, {_PLACE.format(p=p)} AS place, id FROM enrollments") for n, p in (("sequence", "sequence_id"), ("contact", "contact_id"), ("experiment", "experiment_id"))},
    "comments_by_contact": (lambda v: outreach.child_lists(v.table("orders").select(F.col("o_custkey").alias("contact_id"), "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("comment")), "contact_id", [F.desc("o_orderdate"), F.col("o_orderkey")]).select("contact_id", "place", "comment"), "SELECT o_custkey AS contact_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS place, o_orderpriority AS comment FROM orders"),
    "events_by_enrollment": (lambda v: outreach.child_lists(v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], v.table("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))).drop("l_suppkey"), "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS place FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')"),
    "sequences_with_steps": (_sequences, "SELECT p_partkey % 50 AS id, min(p_brand) AS name, CAST(sum(p_size) AS BIGINT) AS created_at, CAST(CASE WHEN p_partkey % 50 % 9 = 0 THEN 0 ELSE count(*) END AS INT) AS n, CASE WHEN p_partkey % 50 % 9 = 0 THEN '' ELSE string_agg(p_partkey || ':' || p_name, ',' ORDER BY p_partkey) END AS steps FROM part GROUP BY p_partkey % 50"),
    "messages_by_provider_id": (_lookups, "SELECT 'm' || a.o_orderkey * 3 AS provider_id, b.o_orderkey, b.o_orderstatus FROM orders a LEFT JOIN orders b ON b.o_orderkey * 2 = a.o_orderkey * 3"),
    "title_themes": (_themes, _THEMES),
    "cached_answers": (_cached, "SELECT s_suppkey AS row, md5('leads.xlsx|Leads|' || s_suppkey || '|s' || s_suppkey || '.example') AS key, CASE WHEN s_suppkey % 6 = 0 THEN s_name WHEN s_suppkey % 3 = 0 THEN 'old' END AS value FROM supplier"),
    "site_facts": (_facts, _FACTS),
    "page_urls": (_urls, _URLS),
    "internal_links": (lambda v: sites.internal_links(v.table("pages")), _INTERNAL),
    "site_names": (lambda v: sites.site_names(v.table("pages")), LEADS["site_brands"][1].replace("AS brand", "AS name", 1)),
}
