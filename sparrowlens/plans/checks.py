"""Named queries on text rules, decisions and rankings, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import email as mail
from ..functions import extract, numbers, text, web
from ..operators import audit, enrichment, outreach, results, review, scoring
from ..sources import files
from ..sources.views import CATEGORIES, Views
from ..streaming import events as streams
from .audit import WITH as AUDIT
from .contacts import _list, _quoted
from .outreach import WITH as OUTREACH

SENTENCES = ["No results. The query failed", "a query without an end that goes on and on", "  First   sentence! Second one.", "One"]


def _pick(values, by: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))


def _sql_pick(values, by: str) -> str:
    return f"({_list(values)})[{by} % {len(values)} + 1]"


def _evidence(v: Views):
    words = F.concat_ws(" ", _pick(SENTENCES, "p_partkey"), F.repeat(F.concat(F.col("p_name"), F.lit(" ")), (F.col("p_partkey") % 12).cast("int")))
    return v.table("part").select("p_partkey", F.md5(text.trimmed(words)).alias("trimmed"))


_EVIDENCE = f"""SELECT p_partkey, md5(CASE WHEN sentence <> '' AND length(sentence) <= 160 THEN sentence WHEN length(clean) <= 160 THEN clean ELSE regexp_replace(left(clean, 160), '\\s+\\S*$', '') || '…' END) AS trimmed
  FROM (SELECT *, regexp_extract(clean, '^(.*?[.!?])(?:\\s|$)', 1) AS sentence FROM (SELECT p_partkey, trim(regexp_replace({_sql_pick(SENTENCES, 'p_partkey')} || ' ' || repeat(p_name || ' ', CAST(p_partkey % 12 AS INT)), '\\s+', ' ', 'g')) AS clean FROM part))"""

TEMPLATES = ["Hi {{first_name}}, about {{company}}", "{{a}}{{a}} and {{b}}", "plain", "{{ first_name }} {{first_name}}{{unknown}}"]


def _filled(v: Views):
    names = text.name_variables(F.replace("c_name", F.lit("#"), F.lit(" ")))
    values = F.create_map(*[x for k, c in {**names, "company": F.col("c_mktsegment"), "a": F.lit("{{b}}")}.items() for x in (F.lit(k), c)])
    return v.table("customer").select("c_custkey", text.fill_template(_pick(TEMPLATES, "c_custkey"), values).alias("message"), names["last_name"].alias("last_name"))


_FILLED = f"""SELECT c_custkey, replace(replace(replace(t, '{{{{first_name}}}}', string_split(replace(c_name, '#', ' '), ' ')[1]), '{{{{company}}}}', c_mktsegment), '{{{{a}}}}', '{{{{b}}}}') AS message, string_split(replace(c_name, '#', ' '), ' ')[-1] AS last_name
  FROM (SELECT *, {_sql_pick(TEMPLATES, 'c_custkey')} AS t FROM customer)"""

RATES = ["12.5%", "9.99%", "x", "10 %", "-3%", "41.5"]


def _attempts(v: Views):
    k = F.col("l_suppkey")
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("contact_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_suppkey").alias("l_suppkey")).select(
        "contact_id", "ord", F.concat(F.lit("p"), F.col("ord").cast("string")).alias("provider"), F.when(k % 5 != 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@x.example"))).alias("email"),
        F.get(F.array(*map(F.lit, ["verified", "risky", "invalid", "guessed", "odd"])), (k % 5).cast("int")).alias("status"), F.when(k % 3 == 0, "not_found").otherwise("found").alias("outcome"))


_ATTEMPTS = """WITH l AS (SELECT l_orderkey AS contact_id, l_linenumber AS ord, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2),
  a AS (SELECT contact_id, ord, 'p' || ord AS provider, 'u' || k || '@x.example' AS email, ['verified', 'risky', 'invalid', 'guessed', 'odd'][k % 5 + 1] AS status FROM l WHERE k % 3 <> 0 AND k % 5 <> 0)
  SELECT contact_id, provider, email, status FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY status <> 'verified', CASE status WHEN 'risky' THEN 1 WHEN 'guessed' THEN 2 WHEN 'invalid' THEN 3 WHEN 'verified' THEN 0 ELSE 4 END, ord) AS n FROM a) WHERE n = 1"""


def _status(v: Views):
    k = F.col("p_partkey")
    address = F.get(F.array(*map(F.lit, ["a.b@x.example", "info@x.example", "a@gmail.com", "broken", "a@b@c.de"])), (k % 5).cast("int"))
    verdict = F.get(F.array(*map(F.lit, ["valid", "invalid", "accept_all", "unknown"])), (k % 4).cast("int"))
    return v.table("part").select("p_partkey", mail.status(address, k % 3 == 0, verdict, k % 7 == 0).alias("status"))


_STATUS = """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (2, 3, 4) OR (p_partkey % 5 = 1 AND p_partkey % 7 <> 0) OR p_partkey % 4 = 1 THEN 'invalid' WHEN p_partkey % 4 = 0 THEN 'verified' WHEN p_partkey % 3 = 0 THEN 'guessed' ELSE 'risky' END AS status FROM part"""


def _role_status(v: Views):
    k = F.col("p_partkey")
    return v.table("part").select("p_partkey", scoring.role_status((k % 120).cast("int"), F.when(k % 3 != 0, F.col("p_name")), k % 2 == 0, k % 5 == 0, F.when(k % 4 == 0, "CEO").otherwise("HEAD_OF_GROWTH")).alias("status"))


_ROLE_STATUS = """SELECT p_partkey, CASE WHEN strong AND (k % 4 = 0 OR k % 5 = 0) THEN 'RESOLVED_STRONG' WHEN strong OR (s >= 65 AND k % 3 <> 0) THEN 'RESOLVED_PROBABLE' WHEN s > 0 THEN 'UNRESOLVED_WEAK' ELSE 'UNRESOLVED_NONE' END AS status
  FROM (SELECT p_partkey, p_partkey AS k, p_partkey % 120 AS s, p_partkey % 120 >= 90 AND p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS strong FROM part)"""

ROLE_TEXTS = ["Founder and CEO", "VP of Product", "digital commerce lead", "CMO", "nobody"]
ROLES = ["CEO", "HEAD_OF_PRODUCT", "HEAD_OF_ECOMMERCE", "HEAD_OF_GROWTH", "OTHER"]


def _queue(v: Views):
    k = F.col("l_partkey")
    items = v.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return items.select(F.col("l_orderkey").alias("row_key"), _pick(ROLES[:2], "l_partkey").alias("role"), _pick(["A", "B"], "l_orderkey").alias("bucket"), _pick(["LOW", "HIGH", "MEDIUM", "?"], "l_partkey").alias("priority"), (k % 100).alias("score"), F.col("l_linenumber").alias("ord"))


_QUEUE = f"""SELECT row_key, role, bucket, priority, score FROM (SELECT *, row_number() OVER (PARTITION BY row_key, role, bucket ORDER BY ord) AS n FROM (SELECT l_orderkey AS row_key, {_sql_pick(ROLES[:2], 'min(l_partkey)')} AS role, {_sql_pick(['A', 'B'], 'l_orderkey')} AS bucket, {_sql_pick(['LOW', 'HIGH', 'MEDIUM', '?'], 'min(l_partkey)')} AS priority, min(l_partkey) % 100 AS score, l_linenumber AS ord FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE n = 1"""


def _quota(v: Views):
    every = v.table("part").select(F.col("p_partkey").alias("ord"), _pick(CATEGORIES, "p_partkey").alias("category"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("query"))
    targets = v.spark.createDataFrame([(c, 2 + i % 5) for i, c in enumerate(CATEGORIES)], "category string, target int")
    return enrichment.quota(every.where("ord % 10 = 0").select("category", F.upper("query").alias("query")), every, targets)


_QUOTA = f"""WITH q AS (SELECT p_partkey AS ord, {_sql_pick(CATEGORIES, 'p_partkey')} AS category, p_name || ' ' || p_partkey AS query FROM part), t AS (SELECT unnest({_list(CATEGORIES)}) AS category, 2 + unnest(range(26)) % 5 AS target),
  h AS (SELECT category, count(*) AS have FROM q WHERE ord % 10 = 0 GROUP BY 1) SELECT category, query FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS n FROM q WHERE ord % 10 <> 0) JOIN t USING (category) LEFT JOIN h USING (category) WHERE n <= target - coalesce(have, 0)"""


def _people(v: Views):
    k = F.col("s_suppkey")
    return v.table("supplier").select(F.col("s_nationkey").alias("row_key"), F.col("s_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("s"), k.cast("string"), F.lit("@x.example"))).when(k % 3 == 1, "").alias("email"), k.alias("ord"))


def _clusters(v: Views):
    k = F.col("p_partkey")
    page = F.struct(F.col("p_name").alias("title"), F.when(k % 4 == 0, "TEAM").otherwise("OTHER").alias("page_type"), F.when(k % 3 == 0, F.array(F.lit("founder"))).otherwise(F.array().cast("array<string>")).alias("hints"))
    return v.table("part").select(k.alias("row_key"), _pick(ROLES[:4], "p_partkey").alias("role"), F.col("p_name").alias("name"), F.when(k % 2 == 0, "https://l.example/in/x").alias("link"), (k % 90).cast("int").alias("base_score"), (k % 3).cast("int").alias("n_search"), _pick(["our jobs page", "news article", "the founder", "cmo here", ""], "p_partkey").alias("search_text"), F.when(k % 5 != 0, F.array(page)).alias("website"), (k % 2).cast("int").alias("n_links"))


# says_role of the five search texts and the hint for the four roles; the site counts where k % 5 <> 0
_CLUSTERS = """WITH c AS (SELECT p_partkey AS k, ['CEO', 'HEAD_OF_PRODUCT', 'HEAD_OF_ECOMMERCE', 'HEAD_OF_GROWTH'][p_partkey % 4 + 1] AS role, p_partkey % 5 <> 0 AND p_partkey % 3 = 0 AS hinted, p_partkey % 5 <> 0 AND p_partkey % 4 = 0 AS speaks,
    p_partkey % 2 = 0 AS linked, p_partkey % 3 <= 1 AS once, p_name FROM part),
  e AS (SELECT *, (k % 4 = 0 AND (k % 5 = 2 OR hinted)) OR (k % 4 = 3 AND k % 5 = 3) AS explicit_role FROM c),
  s AS (SELECT *, CAST(k % 90 + CASE WHEN k % 3 >= 2 THEN 20 ELSE 0 END + CASE WHEN hinted THEN 15 ELSE 0 END + CASE WHEN k % 2 > 0 THEN 10 ELSE 0 END + CASE WHEN speaks THEN 8 ELSE 0 END
    - CASE WHEN k % 5 = 0 AND NOT linked AND once THEN 20 ELSE 0 END - CASE WHEN NOT linked AND once THEN 15 ELSE 0 END - CASE WHEN k % 5 = 1 AND NOT linked AND once THEN 25 ELSE 0 END - CASE WHEN k % 4 <> 0 AND NOT explicit_role AND k % 3 > 0 THEN 20 ELSE 0 END AS INT) AS score FROM e)
  SELECT k AS row_key, role, score, explicit_role, CASE WHEN score >= 90 AND backed AND (k % 4 = 0 OR explicit_role) THEN 'RESOLVED_STRONG' WHEN (score >= 90 AND backed) OR score >= 65 THEN 'RESOLVED_PROBABLE' WHEN score > 0 THEN 'UNRESOLVED_WEAK' ELSE 'UNRESOLVED_NONE' END AS status FROM (SELECT *, linked OR (hinted AND speaks) AS backed FROM s)"""

LINKS = ["https://www.linkedin.com/in/ann-lee/", "https://linkedin.com/company/x", "https://www.linkedin.com/jobs/1", "https://x.example/in/a", "HTTPS://LINKEDIN.COM/IN/B"]


def _profiles(v: Views):
    page = F.concat(F.col("html"), F.lit('<a href="https://www.linkedin.com/in/p-'), F.col("page_id").cast("string"), F.lit('/">x</a> https://linkedin.com/company/c?y https://www.linkedin.com/in/p-'), F.col("page_id").cast("string"))
    return v.table("pages").select("page_id", F.inline(extract.profile_links(page)))


KEYS = ["direct_match-query", "single", "two  words", "-a--b_", "ÄPfel_x"]


def _keyed(v: Views):
    return v.table("supplier").select("s_suppkey", text.title_words(_pick(KEYS, "s_suppkey")).alias("title"))


_TITLES = ["Direct Match Query", "Single", "Two Words", "A B", "ÄPfel X"]
FENCED = ["```json\n{}\n```", "{}", "``` x ```", "a ``` b", "```\n[1]```  "]
_BARE = ["{}", "{}", "x", "a ``` b", "[1]"]

SECTIONS = ["# Search Audit Report for x\nBody\n\n\n\nMore", "## Roadmap\n1. Fix. Most users never scroll past position 3. End\n", "plain", "\n ## DEEP DIVES \nx\n"]
CLEANED = ["Body\n\nMore", "1. Fix.  End", "plain", "x"]
LINK_KINDS = ["https://www.linkedin.com/in/a", "https://linkedin.com/company/b", "https://c.example/in/", "https://linkedin.com/jobs"]


def _answers(v: Views):
    k = F.col("s_suppkey")
    row = lambda url, meta: F.struct(F.when(k % 2 == 0, F.col("s_name")).alias("title"), url.alias("url"), F.repeat(F.lit("d"), (k % 4 * 150).cast("int")).alias("description"), meta.alias("meta_url"))
    meta = F.when(k % 3 == 0, F.struct(F.lit("h.example").alias("hostname"), F.lit("/p").alias("path")))
    body = F.to_json(F.struct(F.struct(F.array(row(_pick(LINK_KINDS, "s_suppkey"), meta), row(F.lit("https://d.example"), meta)).alias("results")).alias("web")))
    return files.search_results(v.table("supplier").select(k.cast("string").alias("query"), F.when(k % 5 == 0, "no json").otherwise(body).alias("body")))


_ANSWERS = f"""SELECT CAST(s_suppkey AS VARCHAR) AS query, r AS rank, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS title, left(repeat('d', CAST(s_suppkey % 4 * 150 AS INT)), 300) AS snippet, url, CASE WHEN s_suppkey % 3 = 0 THEN 'h.example/p' ELSE url END AS display_url,
  CASE WHEN contains(url, 'linkedin.com') THEN CASE WHEN contains(url, '/in/') THEN 'PERSON_PROFILE' WHEN contains(url, '/company/') THEN 'COMPANY_PAGE' ELSE 'OTHER' END END AS link_type
  FROM (SELECT *, CASE WHEN r = 1 THEN {_sql_pick(LINK_KINDS, 's_suppkey')} ELSE 'https://d.example' END AS url FROM supplier, (SELECT CAST(unnest([1, 2]) AS INT) AS r) WHERE s_suppkey % 5 <> 0)"""


def _scripted(v: Views):
    k = F.col("p_partkey")
    link = F.repeat(F.lit('<a href="/product/1">x</a>'), (k % 7).cast("int"))
    words = F.repeat(F.lit("word "), (k % 3 * 100).cast("int"))
    page = F.concat(F.when(k % 11 == 0, F.lit('<div id="APP">')).otherwise(""), F.lit("<html><body><script>var x = 1;</script><p>"), words, F.lit("</p>"), link, F.lit("</body></html>"))
    return v.table("part").select("p_partkey", web.needs_scripts(page, k % 9).alias("scripted"))


CATALOGUE = {
    "search_answers": (_answers, _ANSWERS),
    "scripted_pages": (_scripted, "SELECT p_partkey, p_partkey % 11 = 0 OR (p_partkey % 9 < 5 AND (p_partkey % 3 = 0 OR p_partkey % 7 < 5)) AS scripted FROM part"),
    "evidence_trim": (_evidence, _EVIDENCE),
    "filled_templates": (_filled, _FILLED),
    "headline_stats": (lambda v: v.table("part").select("p_partkey", text.headline_stat(_pick(RATES, "p_partkey"), _pick(RATES[::-1] + ["none"], "p_partkey")).alias("stat")), f"SELECT p_partkey, CASE WHEN z >= 10 THEN CAST(floor(z + 0.5) AS BIGINT) || '% of searches returned zero results — a blank page — for products you stock.' WHEN o IS NOT NULL THEN CAST(floor(o + 0.5) AS BIGINT) || '% of searches surfaced the best match outside the top 3 — relevant products pushed out of view.' ELSE 'Relevant products you stock are not surfacing on the first page of search.' END AS stat FROM (SELECT p_partkey, [12.5, 9.99, NULL, 10.0, -3.0, 41.5][p_partkey % 6 + 1] AS z, [41.5, -3.0, 10.0, NULL, 9.99, 12.5, NULL][p_partkey % 7 + 1] AS o FROM part)"),
    "platform_sentences": (lambda v: v.companies().select("id", text.platform_sentence(F.col("platform")).alias("sentence")), OUTREACH + "SELECT id, 'This is a configuration ' || CASE WHEN platform IS NULL THEN 'gap on your current search stack' ELSE 'and tuning gap on ' || platform END || ' — fixable without replatforming.' AS sentence FROM companies"),
    "reranker_documents": (lambda v: v.table("part").select("p_partkey", text.joined_document(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" ")).otherwise(F.col("p_brand")), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type"))).alias("document")), "SELECT p_partkey, concat_ws(' | ', p_name, CASE WHEN p_partkey % 2 <> 0 THEN p_brand END, CASE WHEN p_partkey % 3 <> 0 THEN p_type END) AS document FROM part"),
    "review_ids": (lambda v: v.table("supplier").select("s_suppkey", text.review_id(F.col("s_name"), F.col("s_nationkey"), F.lit(None), F.lit("CEO"), F.lit("A")).alias("review_id")), "SELECT s_suppkey, left(md5(s_name || '|' || s_nationkey || '||CEO|A'), 12) AS review_id FROM supplier"),
    "rate_bands": (lambda v: v.table("part").select("p_partkey", numbers.band(F.col("p_partkey") % 101).alias("band"), numbers.band(F.col("p_partkey") % 101, inverse=True).alias("inverse")), "SELECT p_partkey, CASE WHEN r >= 80 THEN 'good' WHEN r >= 60 THEN 'warn' ELSE 'bad' END AS band, CASE WHEN r <= 20 THEN 'good' WHEN r <= 40 THEN 'warn' ELSE 'bad' END AS inverse FROM (SELECT p_partkey, p_partkey % 101 AS r FROM part)"),
    "companies_filtered": (lambda v: outreach.companies_page(v.companies().withColumn("has_report", F.col("report_url").isNotNull()), status="contacted", has_report=False, sort="name", descending=False, limit=20).select("id", "name"), OUTREACH + "SELECT id, name FROM companies WHERE status = 'contacted' AND report_url IS NULL ORDER BY name LIMIT 20"),
    "companies_with_report": (lambda v: outreach.companies_page(v.companies().withColumn("has_report", F.col("report_url").isNotNull()), has_report=True, limit=50).select("id"), OUTREACH + "SELECT id FROM companies WHERE report_url IS NOT NULL"),
    "waterfall_best": (lambda v: enrichment.waterfall(_attempts(v)), _ATTEMPTS),
    "role_status": (_role_status, _ROLE_STATUS),
    "cluster_scores": (lambda v: scoring.cluster_scores(_clusters(v)).drop("name"), _CLUSTERS),
    "review_queue": (lambda v: enrichment.review_queue(_queue(v)).select("row_key", "role", "bucket", "priority", "score"), _QUEUE),
    "quota_merge": (_quota, _QUOTA),
    "chain_breaks": (lambda v: audit.chain_breaks(v.scored().select(F.col("query_id").alias("chain_id"), F.col("original_rank").alias("step"), F.col("title").alias("query"), F.col("relevance_score").alias("score"))), AUDIT + "SELECT chain_id, break_query, break_step FROM (SELECT query_id AS chain_id, title AS break_query, original_rank AS break_step, row_number() OVER (PARTITION BY query_id ORDER BY original_rank) AS n FROM (SELECT *, lag(relevance_score) OVER (PARTITION BY query_id ORDER BY original_rank) AS before FROM scored) WHERE relevance_score + 0.15 < before) WHERE n = 1"),
    "first_people": (lambda v: review.first_with_email(_people(v)), "SELECT row_key, name, email FROM (SELECT s_nationkey AS row_key, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 's' || s_suppkey || '@x.example' WHEN 1 THEN '' END AS email, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 <> 0, s_suppkey) AS n FROM supplier) WHERE n = 1"),
    "reply_dedupe": (lambda v: streams.deduplicated(v.table("events").withColumn("delivery_id", F.col("event_id") % 1000)).agg(F.count("*").alias("n")), "SELECT count(DISTINCT event_id % 1000) AS n FROM events"),
}
