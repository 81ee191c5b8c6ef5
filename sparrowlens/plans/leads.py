"""Named queries on web pages, cleaned results, found people and merged tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, text, web
from ..operators import results, review, scoring
from ..sources import files
from ..sources.views import CATEGORIES, Views
from .audit import WITH as AUDIT
from .audit import _judged
from .outreach import WITH as OUTREACH


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


def _has(column: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({column}, w))) > 0"


def _pairs(names: dict[str, str]) -> str:
    return "map(" + _list(names) + ", " + _list(names.values()) + ")"


# pages
_HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"


def _nav(v: Views):
    """The links of each page's navigation, each label being a search query too."""
    nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    label = F.regexp_extract_all(nav, F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return v.table("pages").select("page_id", "url", F.posexplode(label).alias("place", "label"))


_NAV = "nav AS (SELECT page_id, url, CAST(i AS INT) AS place, l[i + 1] AS label FROM (SELECT page_id, url, l, unnest(range(len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS l FROM pages)))"


def _page_links(v: Views):
    address = F.concat(F.regexp_extract("url", r"^(https?://[^/?#:]+)", 1), F.lit("/"), F.col("label"))
    own = _nav(v).withColumn("address", address)
    return own.select("page_id", "place", web.page_type(F.col("address"), F.col("label")).alias("type"), web.page_relevance(F.col("address"), F.col("label")).alias("relevance"))


_TYPE = "CASE " + " ".join(f"WHEN {_has('b', words)} THEN '{kind}'" for kind, words in web.PAGE_TYPES.items()) + " ELSE 'OTHER' END"
_LANG = f"""WITH p AS (SELECT page_id, lower(regexp_extract(html, '(?i)<html\\b[^>]*?\\slang\\s*=\\s*["'']?\\s*([a-z]+)', 1)) AS d, lower({_PATH}) AS path, regexp_extract(lower({_HOST}), '\\.([^.]*)$', 1) AS suffix,
  regexp_replace(html, '(?s)<[^>]*>', '', 'g') AS shown FROM pages),
n AS (SELECT *, len(regexp_replace(shown, '\\P{{L}}', '', 'g')) AS letters, len(regexp_replace(shown, '[^åäöæøÅÄÖÆØ]', '', 'g')) AS nordic, len(regexp_replace(shown, '[^åäöÅÄÖ]', '', 'g')) AS sv, len(regexp_replace(shown, '[^æøÆØ]', '', 'g')) AS da, len(regexp_replace(shown, '[^üÜßéè]', '', 'g')) AS german FROM p)
SELECT page_id, coalesce(CASE WHEN d <> 'en' THEN {_pairs(web.LANGUAGES)}[d] END,
  {_pairs(web.LANGUAGES)}[list_filter({_list(web.LANGUAGES)}, lambda c: regexp_matches(path, '/' || c || '[-/]'))[1]], {_pairs(web.SUFFIX_LANGUAGES)}[suffix],
  CASE WHEN letters > 200 THEN CASE WHEN nordic / letters > 0.01 THEN CASE WHEN da > sv THEN 'Danish' ELSE 'Swedish' END WHEN german / letters > 0.005 THEN 'German' END END, 'English') AS language FROM n"""


def _redirects(v: Views):
    host = F.regexp_extract("url", r"^(https?://[^/?#:]+)", 1)
    query = F.concat(F.lit("Q"), F.col("page_id").cast("string"))
    asked = F.concat(host, F.lit("/search?q="), query)
    reached = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(host, F.lit("/find?text="), F.lower(query))).otherwise(asked)
    return v.table("pages").select("page_id", web.search_redirected(asked, reached, query).alias("redirected"))


def _twins(v: Views):
    """Labels of navigation judged as queries: scores and modes by their places."""
    n = F.col("page_id") * 100 + F.col("place")
    judged = _nav(v).select(n.alias("query_id"), F.col("label").alias("query"), F.get(F.array(*map(F.lit, CATEGORIES)), (n % 26).cast("int")).alias("category"), (n % 4).alias("n_results"), F.when(n % 5 == 0, "CONSTRAINT_DROPPED").otherwise("OTHER").alias("failure_mode"), (n % 10 / 10.0).alias("top_score"))
    return results.accent_twins(judged)


# generated queries
def _raw_queries(v: Views):
    key = F.col("p_partkey")
    category = F.when(key % 27 == 26, "OTHER").otherwise(F.get(F.array(*map(F.lit, CATEGORIES)), (key % 27).cast("int")))
    query = F.when(key % 11 == 0, "  ").when(key % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    return v.table("part").select(key.alias("ord"), category.alias("category"), query.alias("query"), F.when(key % 3 == 0, "why").alias("rationale"))


_HASH = "(('0x' || substr(md5(text), 25, 8))::BIGINT % 100 + 96 * (('0x' || substr(md5(text), 17, 8))::BIGINT % 100) + 16 * (('0x' || substr(md5(text), 9, 8))::BIGINT % 100) + 36 * (('0x' || substr(md5(text), 1, 8))::BIGINT % 100)) % 100"


# people
def _names(v: Views):
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    title = F.initcap("p_name")
    name = F.when(key % 6 == 0, title).when(key % 6 == 1, F.upper("p_name")).when(key % 6 == 2, F.col("p_name")).when(key % 6 == 3, F.concat(title, F.lit(" Shop"))).when(key % 6 == 4, F.concat(F.lit("Jane "), F.initcap(F.get(words, 1)))).otherwise("")
    link = F.when(key % 4 == 0, F.concat(F.lit("https://www.linkedin.com/in/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/?x"))).when(key % 4 == 1, "https://www.linkedin.com/in/nobody")
    label = F.when(key % 3 == 0, "STRONG").when(key % 3 == 1, "PROBABLE")
    return v.table("part").select("p_partkey", name.alias("name"), F.concat(F.get(words, 1), F.lit(" & Sons")).alias("company"), link.alias("link"), label.alias("label"))


def _plausible(v: Views):
    score, status = scoring.plausibility(F.col("name"), F.col("company"), F.col("link"), F.col("label"))
    return _names(v).select("p_partkey", score.alias("score"), status.alias("status"))


def _sum(column: str, patterns: list[str], n: int) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({column}, {_quoted(p if p in scoring.NOT_NAMES else '(?i)' + p)}) THEN {n} ELSE 0 END" for p in patterns)


_PLAUSIBLE = f"""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS w, upper(p_name[1]) || p_name[2:len(split_part(p_name, ' ', 1))] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS t, p_name FROM part),
b AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN t WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name WHEN 3 THEN t || ' Shop' WHEN 4 THEN 'Jane ' || split_part(t, ' ', 2) ELSE '' END AS name, w[2] AS company,
  CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'nobody' END AS slug, p_partkey % 3 AS label FROM a),
c AS (SELECT *, string_split(lower(name), ' ') AS ws, list_filter([company, 'sons'], lambda x: len(x) >= 3) AS cs FROM b),
s AS (SELECT p_partkey, CASE WHEN name = '' THEN 0 ELSE 50 - ({_sum('name', scoring.NOT_NAMES, 40)}) - ({_sum('name', scoring.COMPANY_SUFFIXES, 35)}) - ({_sum('name', scoring.SHOP_WORDS, 40)}) - ({_sum('name', scoring.MARKETING, 50)})
  - 30 * len(list_filter(ws, lambda w: list_contains({_list(scoring.TOXIC_WORDS)}, w)))
  - CASE WHEN len(list_filter(ws, lambda w: len(list_filter(cs, lambda c: contains(c, w) OR contains(w, c))) > 0)) = len(ws) THEN 35 ELSE 0 END
  - CASE WHEN len(ws) < 2 THEN 30 ELSE 0 END - CASE WHEN len(ws) > 4 THEN 15 ELSE 0 END - CASE WHEN name = upper(name) THEN 20 ELSE 0 END - CASE WHEN name = lower(name) THEN 25 ELSE 0 END
  + CASE WHEN regexp_matches(name, {_quoted(scoring.PERSON)}) THEN 25 ELSE 0 END + CASE WHEN len(ws) BETWEEN 2 AND 3 THEN 10 ELSE 0 END
  + CASE WHEN slug IS NULL THEN 0 WHEN len(list_filter(ws, lambda w: len(w) >= 3 AND contains(replace(slug, '-', ' '), w))) > 0 THEN 35 ELSE 10 END + CASE label WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END END AS score FROM c)
SELECT p_partkey, CAST(score AS INT) AS score, CASE WHEN score >= 60 THEN 'PLAUSIBLE' WHEN score >= 30 THEN 'SUSPICIOUS' ELSE 'IMPLAUSIBLE' END AS status FROM s"""


def _ranked(v: Views):
    key = F.col("p_partkey")
    candidates = v.table("part").select(
        (key % 25).cast("int").alias("row_key"), F.when(key % 2 == 0, "CEO").otherwise("HEAD_OF_GROWTH").alias("role"), key.alias("ord"), F.when(key % 7 == 0, "Jane").otherwise(F.initcap("p_name")).alias("full_name"),
        F.when(key % 3 == 0, F.concat(F.lit("https://www.linkedin.com/in/p"), key.cast("string"))).alias("link"), F.when(key % 5 == 0, F.concat(F.lit("Post by NATION_"), (key % 25).cast("string"))).otherwise(F.col("p_name")).alias("source_title"),
        F.when(key % 6 == 0, "Formerly hiring at europe").otherwise("").alias("source_snippet"), F.lit("https://x.example").alias("source_url"), F.when(key % 4 == 0, F.array(F.lit("role-evidence"), F.lit("COMPANY_MATCH_FROM_TITLE"))).alias("signals"))
    tasks = v.table("nation").select(F.col("n_nationkey").alias("row_key"), F.col("n_name").alias("company_name"), F.concat(F.lit("https://www.nation-"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("website_url"), F.when(F.col("n_regionkey") == 3, "EU").otherwise("US").alias("region"), F.lit("Europe").alias("country"))
    people = v.table("part").where("p_partkey % 9 = 0").select((key % 25).cast("int").alias("row_key"), F.upper("p_name").alias("full_name"))
    links = v.table("part").where("p_partkey % 6 = 0").select((key % 25).cast("int").alias("row_key"), F.concat(F.lit("https://www.linkedin.com/in/p"), key.cast("string")).alias("url"))
    out = scoring.candidate_ranks(candidates, tasks, people, links)
    status = scoring.role_status(F.col("rank_score"), F.col("full_name"), F.col("ord") % 3 == 0, F.col("ord") % 4 == 0, F.col("role"))
    return out.select("row_key", "role", "ord", "rank_score", "place", status.alias("status"))


_RANKED = """WITH c AS (SELECT CAST(p_partkey % 25 AS INT) AS row_key, CASE WHEN p_partkey % 2 = 0 THEN 'CEO' ELSE 'HEAD_OF_GROWTH' END AS role, p_partkey AS ord, lower(CASE WHEN p_partkey % 7 = 0 THEN 'jane' ELSE p_name END) AS name, p_partkey % 3 = 0 AS l,
  lower(CASE WHEN p_partkey % 5 = 0 THEN 'Post by NATION_' || (p_partkey % 25) ELSE p_name END || ' ' || CASE WHEN p_partkey % 6 = 0 THEN 'Formerly hiring at europe' ELSE '' END || ' https://x.example') AS ctx FROM part),
s AS (SELECT c.*, CASE WHEN l THEN 40 ELSE 0 END + CASE WHEN ord % 4 = 0 THEN 30 ELSE 0 END + CASE WHEN contains(ctx, lower(n_name)) THEN 25 ELSE 0 END + CASE WHEN contains(ctx, 'nation-' || n_nationkey) THEN 20 ELSE 0 END
  + CASE WHEN n_regionkey = 3 AND contains(ctx, 'europe') THEN 10 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM part x WHERE x.p_partkey % 9 = 0 AND x.p_partkey % 25 = c.row_key AND lower(x.p_name) = c.name) THEN 8 ELSE 0 END
  + CASE WHEN ord % 6 = 0 THEN 8 ELSE 0 END - CASE WHEN ord % 5 = 0 THEN 20 ELSE 0 END - CASE WHEN ord % 6 = 0 THEN 40 ELSE 0 END - CASE WHEN ord % 7 = 0 THEN 30 ELSE 0 END AS rank_score FROM c JOIN nation ON n_nationkey = row_key)
SELECT row_key, role, ord, CAST(rank_score AS INT) AS rank_score, CAST(row_number() OVER (PARTITION BY row_key, role ORDER BY rank_score DESC, ord) AS INT) AS place,
  CASE WHEN rank_score >= 90 AND l AND (role = 'CEO' OR ord % 4 = 0) THEN 'RESOLVED_STRONG' WHEN rank_score >= 65 THEN 'RESOLVED_PROBABLE' WHEN rank_score > 0 THEN 'UNRESOLVED_WEAK' ELSE 'UNRESOLVED_NONE' END AS status FROM s"""


def _fields(v: Views):
    key = F.col("l_orderkey")
    return v.table("lineitem").select(
        key.alias("row_key"), F.concat(F.lit("R"), (F.col("l_linenumber") % 4).cast("string")).alias("role"), F.concat(F.lit("CEO_"), F.when(F.col("l_partkey") % 2 == 0, "EMAIL").otherwise("NAME")).alias("field"),
        F.when(F.col("l_returnflag") == "A", "APPROVED").when(F.col("l_returnflag") == "N", "REVIEW").otherwise("BLOCKED").alias("status"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey").cast("string")).alias("value"),
        F.when(F.col("l_suppkey") % 3 == 0, "held").alias("old_value"), (F.col("l_linenumber") != 3).alias("column_exists"))


_ACTIONS = """WITH actions AS (SELECT l_orderkey AS row_key, 'R' || (l_linenumber % 4) AS role, CASE WHEN l_partkey % 2 = 0 THEN 'CEO_EMAIL' ELSE 'CEO_NAME' END AS field,
  CASE WHEN l_linenumber = 3 THEN 'SKIP_COLUMN_MISSING' WHEN l_partkey % 5 = 0 THEN 'SKIP_EMPTY_VALUE' WHEN l_returnflag NOT IN ('A', 'N') THEN 'SKIP_BLOCKED' WHEN l_returnflag = 'N' THEN 'SKIP_NOT_APPROVED' WHEN l_suppkey % 3 = 0 AND l_partkey % 2 <> 0 THEN 'SKIP_EXISTING_VALUE' ELSE 'WRITE_CELL' END AS action,
  CASE WHEN l_linenumber <> 3 AND l_suppkey % 3 = 0 THEN 'held' ELSE '' END AS old_value, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS new_value FROM lineitem WHERE l_linenumber <> 3 OR l_partkey % 5 <> 0)
"""


def _merged(v: Views):
    now = v.table("customer").select("c_custkey", "c_name", "c_acctbal")
    changes = v.table("supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return files.merge_snapshot(now, changes, ["c_custkey"], ["c_name"])


def _tags(v: Views):
    tags = v.table("supplier").select(F.col("s_nationkey").alias("company_id"), (F.col("s_suppkey") % 20).alias("tag_id")).distinct()
    wanted = v.table("nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("company_id"), (F.col("n_regionkey") + 100).cast("long").alias("tag_id"))
    return files.replace_links(tags, wanted, wanted, "company_id")

# reviews
DECISIONS = [*review.APPROVES, "SKIP", "KEEP_EXISTING", "REJECT_CANDIDATE", "NEEDS_MORE_RESEARCH"]


def _decided(v: Views):
    key = F.col("p_partkey")
    filled = lambda k, c: F.when(key % k != 0, F.lit(c))
    return v.table("part").select(key.alias("reviewId"), F.when(key % 4 == 0, review.EMAIL_BUCKETS[0]).otherwise("ROLE_WEAK_WITH_CANDIDATE").alias("bucket"), F.get(F.array(*map(F.lit, DECISIONS)), (key % 8).cast("int")).alias("humanDecision"), filled(3, "n").alias("candidateName"), filled(5, "l").alias("candidateLinkedin"), filled(7, "e").alias("candidateEmail"))


_DECIDED = f"""WITH d AS (SELECT p_partkey AS k, ({_list(DECISIONS)})[p_partkey % 8 + 1] AS d, p_partkey % 3 <> 0 AS n, p_partkey % 5 <> 0 AS l, p_partkey % 7 <> 0 AS e, p_partkey % 4 = 0 AS eb FROM part)
SELECT k AS "reviewId", d AS decision, list_filter([CASE WHEN d IN ('APPROVE_CANDIDATE','APPROVE_ROLE_ONLY','APPROVE_ROLE_AND_LINKEDIN') AND n THEN 'NAME' END, CASE WHEN d IN ('APPROVE_CANDIDATE','APPROVE_ROLE_AND_LINKEDIN') AND l THEN 'LINKEDIN' END,
  CASE WHEN e AND (d = 'APPROVE_EMAIL_ONLY' OR d = 'APPROVE_CANDIDATE' AND eb) THEN 'EMAIL' END], lambda x: x IS NOT NULL) AS approved,
  list_filter([CASE WHEN d IN ('APPROVE_CANDIDATE','APPROVE_ROLE_ONLY','APPROVE_ROLE_AND_LINKEDIN') AND NOT n THEN d || ' but no candidateName' END, CASE WHEN d = 'APPROVE_ROLE_AND_LINKEDIN' AND NOT l THEN d || ' but no candidateLinkedin' END, CASE WHEN d = 'APPROVE_EMAIL_ONLY' AND NOT e THEN d || ' but no candidateEmail' END], lambda x: x IS NOT NULL) AS issues FROM d"""
STATUSES = ["RESOLVED_STRONG", "RESOLVED_PROBABLE", "UNRESOLVED_WEAK", "UNRESOLVED_NONE"]


def _reviewed(v: Views):
    key = F.col("p_partkey")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (F.floor(key / k) % len(names)).cast("int"))
    return v.table("part").select(
        key.alias("row_key"), F.when(key % 2 == 0, "CEO").otherwise("HEAD_OF_GROWTH").alias("role"), pick(STATUSES, 1).alias("role_status"), F.when(key % 5 != 0, F.initcap("p_name")).alias("full_name"),
        F.when(key % 3 != 0, "https://x.example/in/a").alias("link"), (key % 100).cast("int").alias("role_score"), pick(["PLAUSIBLE", "SUSPICIOUS", "IMPLAUSIBLE"], 4).alias("plausibility"), pick(["RESOLVED_INFERRED", "UNRESOLVED"], 12).alias("email_status"),
        pick(["WEAK", "PROBABLE"], 24).alias("email_label"), F.when(key % 7 != 0, "a@b.example").alias("chosen_email"), F.when(key % 11 == 0, F.upper("p_name")).alias("existing_name"), (key % 3).cast("int").alias("domain_emails"), (key % 13 == 0).alias("written"),
        F.when(key % 4 == 1, F.array(F.struct(F.lit("Old").alias("old"), F.lit("new").alias("new")), F.struct(F.lit("Same").alias("old"), F.lit("same ").alias("new")))).alias("held"))


_REVIEWED = f"""WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'CEO' ELSE 'HEAD_OF_GROWTH' END AS role, ({_list(STATUSES)})[p_partkey % 4 + 1] AS st, p_partkey % 5 <> 0 AS c, p_partkey % 3 <> 0 AS l, p_partkey % 100 AS sc, p_partkey // 4 % 3 AS pl, p_partkey // 12 % 2 AS em, p_partkey // 24 % 2 AS lb FROM part),
g AS (SELECT *, st = 'RESOLVED_PROBABLE' AND pl = 0 AND k % 13 <> 0 AND NOT (c AND k % 11 = 0) AS a, st = 'UNRESOLVED_WEAK' AND c AND pl < 2 AS b, st IN ('RESOLVED_STRONG', 'RESOLVED_PROBABLE') AS r, CASE WHEN st = 'RESOLVED_STRONG' THEN 'HIGH' ELSE 'MEDIUM' END AS p FROM f WHERE c OR st <> 'UNRESOLVED_NONE'),
items AS (SELECT k AS row_key, role, 'ROLE_PROBABLE_NOT_WRITTEN' AS bucket, 'HIGH' AS priority FROM g WHERE a UNION ALL SELECT k, role, 'ROLE_WEAK_WITH_CANDIDATE', CASE WHEN pl = 0 THEN 'MEDIUM' ELSE 'LOW' END FROM g WHERE b
 UNION ALL SELECT k, role, 'INVALID_PERSON_BUT_HIGH_SIGNAL', 'LOW' FROM g WHERE pl = 2 AND c AND sc >= 60 UNION ALL SELECT k, role, 'EMAIL_INFERRED_WEAK', p FROM g WHERE pl = 0 AND em = 0 AND lb = 0 AND k % 7 <> 0 AND r
 UNION ALL SELECT k, role, 'EMAIL_UNRESOLVED_BUT_DOMAIN_KNOWN', 'MEDIUM' FROM g WHERE pl = 0 AND c AND r AND em = 1 AND k % 3 > 0
 UNION ALL SELECT k, role, 'SEARCH_GOOD_LINKEDIN_BUT_ROLE_UNCLEAR', 'HIGH' FROM g WHERE c AND l AND pl = 0 AND st IN ('UNRESOLVED_WEAK', 'RESOLVED_PROBABLE') AND sc >= 40 AND NOT a AND NOT b
 UNION ALL SELECT k, role, 'EXISTING_CELL_BLOCKED_NEW_VALUE', p FROM g WHERE c AND k % 4 = 1)
"""


def _confidence(v: Views):
    key = F.col("p_partkey")
    pick = F.get(F.array(*map(F.lit, STATUSES)), (key % 4).cast("int"))
    out = review.inferred_confidence((key % 90 + 1).cast("int"), pick, (key % 3).cast("int"), (key % 5).cast("int"), F.when(key % 2 == 0, "UNKNOWN").otherwise("FIRST"), F.when(key % 7 != 0, (key % 6).cast("int")))
    return v.table("part").select("p_partkey", *[c.alias(n) for c, n in zip(out, ("status", "score", "label"))])


_CONFIDENCE = """WITH s AS (SELECT p_partkey, p_partkey % 3 AS own, CAST(p_partkey % 90 + 1 + CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END + CASE WHEN p_partkey % 3 >= 2 THEN 15 ELSE 0 END - CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 25 ELSE 0 END
  - CASE WHEN p_partkey % 3 > 0 THEN 0 WHEN p_partkey % 5 > 0 THEN 20 ELSE 15 END - CASE WHEN p_partkey % 7 = 0 OR p_partkey % 6 > 3 THEN 15 ELSE 0 END AS INT) AS score FROM part)
SELECT p_partkey, CASE WHEN score <= 0 THEN 'UNRESOLVED' ELSE 'RESOLVED_INFERRED' END AS status, score, CASE WHEN score <= 0 THEN NULL WHEN score >= 90 AND own > 0 THEN 'STRONG' WHEN score >= 70 THEN 'PROBABLE' ELSE 'WEAK' END AS label FROM s"""
POSITIONS = {"CEO": ["building", "founder"], "HEAD_OF_GROWTH": ["machine", "auto"], "HEAD_OF_PRODUCT": ["house", "mach"]}


def _directory(v: Views):
    return v.table("customer").select(F.col("c_nationkey").alias("domain"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("email"), F.concat(F.lit("Head of "), "c_mktsegment").alias("position"), (F.col("c_custkey") % 50).cast("int").alias("confidence"))


_DIRECTORY = "WITH e AS (" + " UNION ALL ".join(f"SELECT c_nationkey AS domain, '{r}' AS role, c_name AS email, 'Head of ' || c_mktsegment AS position, CAST(c_custkey % 50 AS INT) AS confidence, c_custkey AS ord FROM customer WHERE regexp_matches(lower(c_mktsegment), '{'|'.join(w)}')" for r, w in POSITIONS.items()) + ") SELECT domain, role, email, position, confidence FROM (SELECT *, row_number() OVER (PARTITION BY domain, role ORDER BY confidence DESC, ord) AS n FROM e) WHERE n = 1"


def _alike(v: Views):
    part = v.table("part")
    left = part.where("p_partkey % 2 = 0").select((F.col("p_partkey") % 25).alias("row_key"), F.col("p_name").alias("full_name"))
    right = part.where("p_partkey % 2 = 1").select((F.col("p_partkey") % 25).alias("row_key"), F.concat(F.upper("p_name"), F.lit("  de la Cruz")).alias("full_name"))
    return review.name_matches(left, right.unionByName(part.where("p_partkey % 3 = 0").select((F.col("p_partkey") % 25).alias("row_key"), F.initcap("p_name").alias("full_name"))))


_ALIKE = """WITH l AS (SELECT DISTINCT p_partkey % 25 AS row_key, p_name AS n, p_name AS shown FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT DISTINCT p_partkey % 25 AS row_key, p_name || ' de la cruz' AS n, upper(p_name) || '  de la Cruz' AS shown FROM part WHERE p_partkey % 2 = 1
  UNION SELECT p_partkey % 25, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') FROM part WHERE p_partkey % 3 = 0)
SELECT l.row_key, l.shown AS left_name, r.shown AS right_name FROM l JOIN r USING (row_key) WHERE l.n = r.n OR len(list_intersect(list_filter(string_split(l.n, ' '), lambda w: len(w) > 1), string_split(r.n, ' '))) / least(len(list_distinct(string_split(l.n, ' '))), len(list_distinct(string_split(r.n, ' ')))) >= 0.66"""
_SHOWN = "regexp_replace(regexp_replace(text, '(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>', ' ', 'g'), '(?s)<[^>]*>', '', 'g')"


def _eligible(v: Views):
    key = F.col("p_partkey")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (F.floor(key / k) % len(names)).cast("int"))
    return scoring.field_eligibility(v.table("part").select(
        key.alias("row_key"), F.lit("CEO").alias("role"), F.when(key % 5 != 0, F.col("p_name")).alias("full_name"), F.when(key % 7 == 0, "https://x.example/company/a").when(key % 3 != 0, "https://x.example/in/a").alias("link"), pick(["PLAUSIBLE", "SUSPICIOUS", "IMPLAUSIBLE"], 1).alias("plausibility"),
        pick(STATUSES, 3).alias("role_status"), F.when(key % 11 != 0, "a@b.example").alias("email"), pick(["RESOLVED_PUBLIC", "RESOLVED_INFERRED", "UNRESOLVED"], 12).alias("email_status"), pick(["STRONG", "PROBABLE", "WEAK"], 36).alias("email_label")))


_ELIGIBLE = """WITH f AS (SELECT p_partkey AS k, p_partkey % 5 <> 0 AS n, CASE WHEN p_partkey % 7 = 0 THEN 'https://x.example/company/a' WHEN p_partkey % 3 <> 0 THEN 'https://x.example/in/a' END AS l, p_name, p_partkey % 3 AS pl, p_partkey // 3 % 4 < 2 AS r, p_partkey % 11 <> 0 AS e, p_partkey // 12 % 3 AS es, p_partkey // 36 % 3 AS lb FROM part),
s AS (SELECT *, CASE WHEN NOT n OR pl = 2 THEN 'BLOCKED' WHEN pl = 1 OR NOT r THEN 'REVIEW' ELSE 'ELIGIBLE' END AS sn, CASE WHEN l IS NULL OR pl = 2 OR NOT contains(l, '/in/') THEN 'BLOCKED' WHEN pl = 1 OR NOT r THEN 'REVIEW' ELSE 'ELIGIBLE' END AS sl,
  CASE WHEN NOT e OR pl = 2 OR es = 2 THEN 'BLOCKED' WHEN es = 0 THEN CASE WHEN pl = 1 THEN 'REVIEW' ELSE 'ELIGIBLE' END WHEN pl = 1 OR lb = 2 THEN 'BLOCKED' WHEN lb = 0 THEN 'ELIGIBLE' ELSE 'REVIEW' END AS se FROM f),
o AS (SELECT *, CASE WHEN sn = 'BLOCKED' AND sl = 'BLOCKED' AND se = 'BLOCKED' THEN 'BLOCKED' WHEN 'REVIEW' IN (sn, sl, se) THEN 'REVIEW' ELSE 'ELIGIBLE' END AS overall FROM s)
SELECT k AS row_key, 'CEO' AS role, overall, 'CEO_NAME' AS field, sn AS status, CASE WHEN sn <> 'BLOCKED' THEN p_name END AS value FROM o UNION ALL SELECT k, 'CEO', overall, 'CEO_LINKEDIN', sl, CASE WHEN sl <> 'BLOCKED' THEN l END FROM o
UNION ALL SELECT k, 'CEO', overall, 'CEO_EMAIL', se, CASE WHEN se <> 'BLOCKED' THEN 'a@b.example' END FROM o"""


def _to_enrich(v: Views):
    key = F.col("id")
    own = v.contacts().withColumns({"reason": F.when(key % 5 != 0, "known"), "domain": F.when(key % 23 != 0, "x.example")})
    return scoring.to_enrich(own).select("id", "reason", "domain")


CATALOGUE = {
    "clean_results": (lambda v: results.clean_results(v.scored()).select("query_id", "title", "original_rank", "rank"), AUDIT + f"SELECT query_id, title, original_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY original_rank) AS INT) AS rank FROM scored WHERE len(trim(title)) >= 8 AND regexp_matches(title, '\\p{{L}}') AND len(list_filter({_list(web.JUNK_STARTS)}, lambda w: starts_with(lower(trim(title)), w))) = 0 AND lower(trim(title)) NOT IN {tuple(web.JUNK_TITLES)}"),
    "commercial_tiers": (lambda v: results.tier_summary(_judged(v)), AUDIT + "SELECT *, CAST(floor(tier_a * 100.0 / total + 0.5) AS BIGINT) AS bounce_share FROM (SELECT capability, count(*) AS total, count(*) FILTER (t = 'A') AS tier_a, count(*) FILTER (t = 'B') AS tier_b, count(*) FILTER (t = 'C') AS tier_c FROM (SELECT capability, CASE WHEN n_results = 0 OR top_score < 0.4 THEN 'A' WHEN failure_mode = 'POOR_RANKING' THEN 'B' ELSE 'C' END AS t FROM judged) GROUP BY 1)"),
    "risk_buckets": (lambda v: _judged(v).select("query_id", results.risk_bucket(F.col("n_results"), F.col("failure_mode"), F.col("top_score")).alias("bucket")), AUDIT + "SELECT query_id, CASE WHEN n_results = 0 THEN 'revenue_risk' WHEN top_score < 0.4 THEN 'catastrophic' ELSE 'working' END AS bucket FROM judged"),
    "missing_quota": (lambda v: results.missing_quota(v.queries().select("category"), v.spark.createDataFrame([(c, 500 + 20 * i) for i, c in enumerate(CATEGORIES)], "category string, target long")), f"SELECT category, target - coalesce(n, 0) AS missing FROM (SELECT unnest({_list(CATEGORIES)}) AS category, 500 + 20 * unnest(range(26)) AS target, unnest(range(26)) AS i) LEFT JOIN (SELECT o_orderkey % 26 AS k, count(*) AS n FROM orders GROUP BY 1) ON k = i WHERE target > coalesce(n, 0)"),
    "valid_queries": (lambda v: results.valid_queries(_raw_queries(v), CATEGORIES), f"SELECT ord, category, query, rationale FROM (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY ord) AS n FROM (SELECT p_partkey AS ord, ({_list(CATEGORIES)})[p_partkey % 27 + 1] AS category, trim(CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END) AS query, CASE WHEN p_partkey % 3 = 0 THEN 'why' ELSE 'Tests ' || ({_list(CATEGORIES)})[p_partkey % 27 + 1] || ' behaviour' END AS rationale FROM part WHERE p_partkey % 27 <> 26) WHERE query <> '') WHERE n = 1"),
    "query_cloud": (lambda v: results.query_cloud(v.queries()), AUDIT + f"SELECT text, category, CAST(turn AS INT) AS turn, CAST(CASE WHEN h < 8 THEN 5 WHEN h < 24 THEN 4 WHEN h < 56 THEN 3 WHEN h < 82 THEN 2 ELSE 1 END AS INT) AS size FROM (SELECT *, {_HASH} AS h FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY len(text), text) AS turn FROM (SELECT category, min(trim(query)) AS text FROM queries WHERE len(trim(query)) BETWEEN 1 AND 40 GROUP BY category, lower(trim(query)))) ORDER BY turn, category LIMIT 26)"),
    "accent_twins": (_twins, f"WITH {_NAV}, j AS (SELECT page_id * 100 + place AS q, label, ({_list(CATEGORIES)})[(page_id * 100 + place) % 26 + 1] AS category FROM nav), o AS (SELECT label, max(q) AS q, max_by(category, q) AS category FROM j GROUP BY 1), b AS (SELECT label, category, CASE WHEN q % 4 = 0 OR q % 5 = 0 THEN 'revenue_risk' WHEN q % 10 < 4 THEN 'catastrophic' ELSE 'working' END AS bucket FROM o) SELECT a.label AS accented, a.bucket, strip_accents(a.label) AS stripped, t.bucket AS twin_bucket FROM b a LEFT JOIN b t ON t.label = strip_accents(a.label) WHERE strip_accents(a.label) <> a.label AND a.category NOT IN {tuple(results.CONFOUNDING)}"),
    "response_class": (lambda v: v.table("pages").select("page_id", web.response_class(F.col("html")).alias("class")), f"SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN 'empty' WHEN {_has('h', web.CLOUDFLARE_SIGNALS)} THEN 'cloudflare' WHEN {_has('h', web.IMPERVA_SIGNALS)} THEN 'imperva' ELSE 'ok' END AS class FROM (SELECT *, lower(left(html, 5000)) AS h FROM pages)"),
    "search_redirects": (_redirects, f"SELECT page_id, page_id % 3 = 0 AND {_PATH} <> '/search' AND NOT contains(lower(url), 'q' || page_id) AS redirected FROM pages"),
    "page_links": (_page_links, f"WITH {_NAV}, a AS (SELECT page_id, place, lower(regexp_extract(url, '^(https?://[^/?#:]+)', 1) || '/' || label || ' ' || label) AS b, label FROM nav) SELECT page_id, place, {_TYPE} AS type, CAST(10 * len(list_filter({_list(web.PAGE_WORDS)}, lambda w: contains(b, w))) - 2 * (1 + len(split_part(split_part(label, '?', 1), '#', 1)) - len(replace(split_part(split_part(label, '?', 1), '#', 1), '/', ''))) AS INT) AS relevance FROM a"),
    "page_language": (lambda v: v.table("pages").select("page_id", web.primary_language(F.col("html"), F.col("url")).alias("language")), _LANG),
    "document_prices": (lambda v: v.table("documents").select("doc_id", web.price(F.col("text")).alias("price")).where("price is not null"), f"SELECT doc_id, trim(regexp_extract(text, {_quoted('(' + web.PRICE + ')')}, 1)) AS price FROM documents WHERE regexp_extract(text, {_quoted('(' + web.PRICE + ')')}, 1) <> ''"),
    "person_plausibility": (_plausible, _PLAUSIBLE),
    "candidate_rank": (_ranked, _RANKED),
    "write_actions": (lambda v: scoring.write_actions(_fields(v), overwrite=["EMAIL"]), _ACTIONS + "SELECT * FROM actions"),
    "write_action_summary": (lambda v: scoring.action_summary(scoring.write_actions(_fields(v), overwrite=["EMAIL"])), _ACTIONS + "SELECT action, role, count(*) AS n, count(*) FILTER (action = 'WRITE_CELL') AS writes FROM actions GROUP BY GROUPING SETS ((action), (role), ())"),
    "snapshot_merge": (_merged, "SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(n, c_name) AS c_name, c_acctbal FROM customer FULL JOIN (SELECT s_suppkey * 3 AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS n FROM supplier) ON k = c_custkey"),
    "replaced_links": (_tags, "SELECT DISTINCT s_nationkey AS company_id, s_suppkey % 20 AS tag_id FROM supplier WHERE s_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey, n_regionkey + 100 FROM nation WHERE n_nationkey % 4 = 0"),
    "first_source_union": (lambda v: files.union_first([v.table("part").select(F.upper("p_brand").alias("name"), F.lit("brand").alias("origin")), v.table("part").select(F.col("p_name").alias("name"), F.lit("part").alias("origin")), v.table("nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("origin"))], "name"), "SELECT name, origin FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY p, name, origin) AS n FROM (SELECT upper(p_brand) AS name, 'brand' AS origin, 0 AS p FROM part UNION ALL SELECT p_name, 'part', 1 FROM part UNION ALL SELECT n_name, 'nation', 2 FROM nation)) WHERE n = 1"),
    "manual_approvals": (lambda v: review.manual_approvals(_decided(v)), _DECIDED),
    "review_items": (lambda v: review.review_items(_reviewed(v)), _REVIEWED + "SELECT * FROM items"),
    "review_summary": (lambda v: review.review_summary(review.review_items(_reviewed(v))), _REVIEWED + "SELECT bucket, priority, role, count(*) AS n FROM items GROUP BY GROUPING SETS ((bucket), (priority), (role), ())"),
    "email_confidence": (_confidence, _CONFIDENCE),
    "best_directory_entries": (lambda v: review.best_entries(_directory(v), POSITIONS), _DIRECTORY),
    "name_matches": (_alike, _ALIKE),
    "page_emails": (lambda v: v.table("documents").select("doc_id", F.inline(extract.page_emails(F.col("text")))).where("source = 'VISIBLE_TEXT'"), f"SELECT doc_id, email, 'VISIBLE_TEXT' AS source FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all({_SHOWN}, {_quoted(extract.ADDRESS)}), lambda e: lower(e)))) AS email FROM documents) WHERE len(email) BETWEEN 5 AND 100 AND split_part(email, '@', 2) NOT IN {tuple(extract.PERSONAL_DOMAINS)}"),
    "declared_products": (lambda v: v.table("pages").select("page_id", F.inline(extract.declared_products(F.col("html")))), None),
    "field_eligibility": (_eligible, _ELIGIBLE),
    "contacts_to_enrich": (_to_enrich, OUTREACH + "SELECT id, 'known' AS reason, 'x.example' AS domain FROM contacts WHERE opt_out = 0 AND status = 'active' AND id % 5 <> 0 AND id % 23 <> 0 AND NOT (email IS NOT NULL AND coalesce(email_status, '') IN ('', 'verified'))"),
    "contacts_export": (lambda v: v.contacts().join(v.companies().select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id", "left").select("id", "name", "email", "status", "company_name"), OUTREACH + "SELECT c.id, c.name, email, c.status, o.name AS company_name FROM contacts c LEFT JOIN companies o ON o.id = c.company_id"),
    "unsubscribed_export": (lambda v: v.contacts().where("status = 'unsubscribed'").select("id", "name", "email"), OUTREACH + "SELECT id, name, email FROM contacts WHERE status = 'unsubscribed'"),
    "site_types": (lambda v: v.table("pages").select("page_id", web.site_type(F.col("html")).alias("type")), f"SELECT page_id, CASE WHEN s >= 3 AND g <= 1 THEN 'SERVICES_EXPERIENCES' WHEN g >= 3 AND s <= 1 THEN 'PHYSICAL_GOODS' WHEN g >= 3 AND s >= 3 THEN 'MARKETPLACE_MIXED' WHEN g > s THEN 'PHYSICAL_GOODS' WHEN s > g THEN 'SERVICES_EXPERIENCES' ELSE 'MARKETPLACE_MIXED' END AS type FROM (SELECT page_id, len(list_filter({_list(web.SERVICE_WORDS)}, lambda w: contains(h, w))) AS s, len(list_filter({_list(web.GOODS_WORDS)}, lambda w: contains(h, w))) + least(len(regexp_extract_all(h, '[$€£¥]\\s?\\d')), 5) AS g FROM (SELECT page_id, lower(left(coalesce(html, ''), 50000)) AS h FROM pages))"),
    "site_brands": (lambda v: v.table("pages").select("page_id", web.domain_brand(F.col("url")).alias("brand")), f"SELECT page_id, upper(b[1]) || lower(b[2:]) AS brand FROM (SELECT page_id, CASE WHEN len(l) >= 3 AND list_contains({_list(web.SECOND_LEVELS)}, l[-2]) THEN l[-3] WHEN len(l) >= 2 THEN l[-2] ELSE l[1] END AS b FROM (SELECT page_id, list_filter(string_split({_HOST}, '.'), lambda x: x <> '' AND x <> 'www') AS l FROM pages))"),
    "report_slugs": (
        lambda v: files.report_slugs(v.table("customer").select(text.slug(F.col("c_name")).alias("company")).unionAll(v.table("supplier").select(text.slug(F.col("s_name")))), v.table("supplier").where("s_suppkey % 3 > 0").select(F.when(F.col("s_suppkey") % 3 == 1, text.slug(F.col("s_name"))).otherwise("other").alias("company"), F.concat(text.slug(F.col("s_name")), F.lit("-1234")).alias("slug"))),
        """WITH c AS (SELECT regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS company, NULL AS s FROM customer UNION ALL SELECT regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), s_suppkey FROM supplier),
  t AS (SELECT c.company, s, i, company || '-' || (('0x' || left(md5(company || '-' || i), 8))::BIGINT % 9000 + 1000) AS slug FROM c, range(8) r(i)),
  f AS (SELECT company, s, slug FROM t WHERE NOT (s % 3 > 0 AND slug = company || '-1234') IS TRUE QUALIFY row_number() OVER (PARTITION BY company ORDER BY i) = 1)
  SELECT company, CASE WHEN s % 3 = 1 THEN company || '-1234' ELSE slug END AS slug FROM f""",
    ),
}
