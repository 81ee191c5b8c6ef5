"""Named queries on rules for names, links and texts over whole tables; the SQL works each rule out again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import email as mail
from ..functions import extract, people, text, web
from ..operators import scoring
from ..sources.views import Views
from . import checks, reports
from .contacts import _list, _quoted


def _words():
    """Words of a document, as written: the first four."""
    return F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 4)


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:4]"


def _pick(values: list[str], key):
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _sql_pick(values: list[str], key: str) -> str:
    return f"({_list(values)})[{key} % {len(values)} + 1]"


def _capital(words):
    return F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))


CAPITAL = "list_transform({w}, lambda w: upper(w[1]) || lower(w[2:]))"


def _is_name(n: str) -> str:
    """The rule for names of people on an SQL expression."""
    bad = " OR ".join(f"regexp_matches({n}, {_quoted(p)})" for p in people.NO_NAMES)
    return rf"(length({n}) BETWEEN 4 AND 60 AND len(regexp_split_to_array({n}, '\s+')) BETWEEN 2 AND 5 AND {n} <> upper({n}) AND {n} <> lower({n}) AND NOT ({bad}) AND regexp_matches({n}, {_quoted(people.NAME)}))"


def _names(v: Views):
    """The first two to four words of each document, as they are and with capitals, some with a word that names don't hold."""
    k = F.col("doc_id")
    words = F.slice(F.when(k % 3 == 0, _words()).otherwise(_capital(_words())), F.lit(1), (F.pmod(k, F.lit(3)) + 2).cast("int"))
    name = F.concat(F.when(k % 7 == 0, "Shop ").otherwise(""), F.array_join(words, " "), F.when(k % 5 == 0, " GmbH").otherwise(""))
    return v.table("documents").select("doc_id", people.is_person_name(name).alias("is_name"))


_NAMES = f"""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {WORDS} ELSE {CAPITAL.format(w=WORDS)} END AS w FROM documents),
  n AS (SELECT doc_id, trim(CASE WHEN doc_id % 7 = 0 THEN 'Shop ' ELSE '' END || array_to_string(w[1:doc_id % 3 + 2], ' ') || CASE WHEN doc_id % 5 = 0 THEN ' GmbH' ELSE '' END) AS n FROM w)
  SELECT doc_id, {_is_name('n')} AS is_name FROM n"""

ENDS = ["", "/", "-1234", "?trk=x", "/details#a"]


def _profiles(v: Views):
    """Profile addresses made from each document's first words, with numbers and parameters."""
    k = F.col("doc_id")
    slug = F.array_join(F.slice(_words(), F.lit(1), (F.pmod(k, F.lit(3)) + 1).cast("int")), "-")
    url = F.concat(F.when(k % 6 == 5, "https://linkedin.com/company/").otherwise("https://www.LinkedIn.com/in/"), F.url_encode(F.lower(slug)), _pick(ENDS, k))
    return v.table("documents").select("doc_id", people.name_in_profile(url).alias("name"))


_PROFILES = rf"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'company' ELSE lower(array_to_string(({WORDS})[1:doc_id % 3 + 1], '-')) END AS slug, doc_id % 6 = 5 AS company, {_sql_pick(ENDS, 'doc_id')} AS ending FROM documents),
  w AS (SELECT doc_id, company, regexp_split_to_array(regexp_replace(trim(translate(slug || CASE WHEN starts_with(ending, '-') THEN ending ELSE '' END, '-_', '  ')), '\s+\d+$', ''), '\s+') AS w FROM s),
  n AS (SELECT doc_id, company, len(w) AS n, array_to_string({CAPITAL.format(w='w')}, ' ') AS name FROM w)
  SELECT doc_id, CASE WHEN NOT company AND n BETWEEN 2 AND 4 AND {_is_name('name')} THEN name END AS name FROM n"""


def _linked(page: str):
    """Addresses of pages, some of them moved to a network."""
    moved = F.regexp_replace("url", "^(https?://)[^/?#]+", "$1www.LinkedIn.com")
    return F.when(F.col(page) % 4 == 0, F.col("url")).otherwise(F.concat(moved, _pick(["", "/IN/x", "/company/y"], F.col(page))))


LINKED = r"CASE WHEN page_id % 4 = 0 THEN url ELSE regexp_replace(url, '^(https?://)[^/?#]+', '\1www.LinkedIn.com') || " + _sql_pick(["", "/IN/x", "/company/y"], "page_id") + " END"
_LINK_TYPES = f"SELECT page_id, CASE WHEN contains(u, 'linkedin.com') THEN CASE WHEN contains(u, '/in/') THEN 'PERSON_PROFILE' WHEN contains(u, '/company/') THEN 'COMPANY_PAGE' ELSE 'OTHER' END END AS type FROM (SELECT page_id, lower({LINKED}) AS u FROM pages)"


def _bases(v: Views):
    base = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^(https?)://", "HTTPS://WWW.")).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", r"^(https?://)(?:[a-z]+\.)?([^/?#]+)", "$1user@$2:8080")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return v.table("pages").select("page_id", web.same_site(F.col("url"), base).alias("same"))


_HOST = r"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
_SAME = rf"""SELECT page_id, {_HOST.format(u='url')} = {_HOST.format(u='base')} AND {_HOST.format(u='url')} <> '' AS same FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^(https?)://', 'HTTPS://WWW.') WHEN 1 THEN regexp_replace(url, '^(https?://)(?:[a-z]+\.)?([^/?#]+)', '\1user@\2:8080') ELSE regexp_replace(url, '^https?://', '') END AS base FROM pages)"""

TAILS = ["", "/logo.SVG", "/a.pdf?x=1", "/style.css#y", "/v1.2/page", ".zip"]
HEADS = ["", "", "", "mailto:", "JavaScript:", " #"]


def _skipped(v: Views):
    href = F.concat(_pick(HEADS, F.col("page_id")), F.when(F.col("page_id") % 6 == 5, "").otherwise(F.concat(F.regexp_replace("url", "[?#].*$", ""), _pick(TAILS, F.floor(F.col("page_id") / 6)))))
    return v.table("pages").select("page_id", web.is_skipped(href).alias("skipped"))


_SKIPPED = rf"""SELECT page_id, l IN ('', '#') OR regexp_matches(l, '^(mailto|tel|javascript|data):') OR list_contains({_list(web.FILE_ENDINGS)}, regexp_extract(regexp_extract(l, '^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '\.([^./]*)$', 1)) AS skipped
  FROM (SELECT page_id, lower(trim({_sql_pick(HEADS, 'page_id')} || CASE WHEN page_id % 6 = 5 THEN '' ELSE regexp_replace(url, '[?#].*$', '') || {_sql_pick(TAILS, '(page_id // 6)')} END)) AS l FROM pages)"""

JOINS = ["-", "_", "  ", "-_ "]


def _titles(v: Views):
    key = F.concat(_pick(["", "-", "_"], F.col("doc_id")), F.array_join(_words(), "\u0001"))
    return v.table("documents").select("doc_id", text.title_words(F.replace(key, F.lit("\u0001"), _pick(JOINS, F.col("doc_id")))).alias("title"))


_JOINED = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN array_to_string({WORDS}, {_quoted(j)})" for i, j in enumerate(JOINS)) + " END"
_TITLES = f"SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(regexp_split_to_array({_sql_pick(['', '-', '_'], 'doc_id')} || {_JOINED}, '[-_ ]+'), lambda w: w <> ''), lambda w: CASE w[1] WHEN 'ß' THEN 'SS' ELSE upper(w[1]) END || w[2:]), ' '), '') AS title FROM documents"

STARTS, STOPS = ["```json\n", "```", "", "  ```SQL  "], ["\n```", "```  ", "", "\n"]


def _fenced(v: Views):
    k = F.col("conv_id") + F.col("turn")
    return v.table("conversations").select("conv_id", "turn", F.md5(text.without_fences(F.concat(_pick(STARTS, k), F.coalesce("text", F.lit("")), _pick(STOPS, F.floor(k / 4))))).alias("body"))


def _escaped(values: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in values) + "]"


_FENCED = rf"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(trim(({_escaped(STARTS)})[(conv_id + turn) % 4 + 1] || coalesce(text, '') || ({_escaped(STOPS)})[((conv_id + turn) // 4) % 4 + 1]), '^```[a-zA-Z]*\s*', ''), '\s*```$', ''))) AS body FROM conversations"

LINES = ["## Roadmap", " # Search Audit Report 2024", "## Deep_Dives", "Keep this", "Most users never scroll past position 3. And so", ""]


def _sections(v: Views):
    """Each turn of a conversation between headings and stock sentences."""
    k = F.col("conv_id") + F.col("turn")
    body = F.concat_ws("\n", _pick(LINES, k), F.coalesce("text", F.lit("")), _pick(LINES, k + 1), F.lit(""), F.lit(""), F.lit(""), _pick(LINES, k + 3), _pick(LINES, k + 5))
    return v.table("conversations").select("conv_id", "turn", F.md5(text.section_text(body)).alias("body"))


def _cleaned(expression: str) -> str:
    for s in text.SCROLL_SENTENCES:
        expression = f"replace({expression}, {_quoted(s)}, '')"
    return expression


_SECTIONS = rf"""WITH t AS (SELECT conv_id, turn, concat_ws(chr(10), {_sql_pick(LINES, '(conv_id + turn)')}, coalesce(text, ''), {_sql_pick(LINES, '(conv_id + turn + 1)')}, '', '', '', {_sql_pick(LINES, '(conv_id + turn + 3)')}, {_sql_pick(LINES, '(conv_id + turn + 5)')}) AS t FROM conversations),
  l AS (SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(t, '\r\n|[\n\r]'), lambda x: NOT list_contains({_list(text.REDUNDANT_HEADINGS)}, lower(trim(x))) AND NOT starts_with(lower(trim(x)), '# search audit report')), chr(10)) AS t FROM t)
  SELECT conv_id, turn, md5(regexp_replace(regexp_replace({_cleaned('t')}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS body FROM l"""

SAID = ["our Founder", "VP of Product", "digital Commerce", "CMO", "nobody", "a product Director"]


def _evidence(v: Views):
    k = F.col("conv_id") + F.col("turn")
    return v.table("conversations").select("conv_id", "turn", scoring.says_role(_pick([*scoring.ROLE_WORDS, "OTHER"], F.col("conv_id")), F.concat_ws(" ", "text", _pick(SAID, k))).alias("says"))


_EVIDENCE = "SELECT conv_id, turn, CASE " + " ".join(f"WHEN conv_id % 5 = {i} THEN len(list_filter({_list(words)}, lambda w: contains(t, w))) > 0" for i, words in enumerate(scoring.ROLE_WORDS.values())) + f" ELSE false END AS says FROM (SELECT conv_id, turn, lower(concat_ws(' ', text, {_sql_pick(SAID, '(conv_id + turn)')})) AS t FROM conversations)"

DOMAINS = ["x.example", "gmail.com", "nodot", "b@c.example", "u003e.example", "pic.png", ""]


def _statuses(v: Views):
    """Addresses made from each document's first word, with verdicts of a provider."""
    k = F.col("doc_id")
    local = F.when(k % 4 == 0, _pick(mail.GENERIC_INBOXES[:5], k)).otherwise(F.coalesce(F.get(_words(), 0), F.lit("")))
    address = F.concat(F.lit(" "), local, F.lit("@"), _pick(DOMAINS, F.floor(k / 4)))
    return v.table("documents").select("doc_id", mail.status(address, k % 3 == 0, _pick(["valid", "invalid", "accept_all", "unknown"], k), k % 8 == 0).alias("status"))


_STATUSES = rf"""WITH a AS (SELECT doc_id AS k, lower(trim(' ' || CASE WHEN doc_id % 4 = 0 THEN {_sql_pick(mail.GENERIC_INBOXES[:5], 'doc_id')} ELSE coalesce(({WORDS})[1], '') END || '@' || {_sql_pick(DOMAINS, '(doc_id // 4)')})) AS a FROM documents),
  p AS (SELECT *, string_split(a, '@') AS s FROM a),
  g AS (SELECT k, len(s) = 2 AND s[1] <> '' AND s[2] <> '' AND NOT list_contains({_list(mail.PERSONAL_DOMAINS)}, s[2]) AND contains(s[2], '.') AND NOT contains(a, 'u003e') AND length(s[1]) <= 64 AND length(s[2]) <= 100 AND NOT regexp_matches(s[2], '\.(png|jpg)$') AND (k % 8 = 0 OR NOT list_contains({_list(mail.GENERIC_INBOXES)}, s[1])) AS sound FROM p)
  SELECT k AS doc_id, CASE WHEN NOT sound OR k % 4 = 1 THEN 'invalid' WHEN k % 4 = 0 THEN 'verified' WHEN k % 3 = 0 THEN 'guessed' ELSE 'risky' END AS status FROM g"""

_PAGE = """'<p><a class="x" href="mailto:L' || p_partkey || '@x.example?subject=a">mail</a> v' || p_partkey || '@y.example, b' || p_partkey || ' [at] z.example s' || p_partkey || ' @ w.example V' || p_partkey || '@Y.EXAMPLE g' || p_partkey || '@gmail.com <script>no' || p_partkey || '@q.example</script></p>'"""
_CONTACTS = rf"""WITH p AS (SELECT p_partkey, {_PAGE} AS html FROM part),
  s AS (SELECT *, replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'g'), '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' ') AS shown FROM p),
  e AS (SELECT p_partkey, list_concat(list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*["'']mailto:([^"''?]*)', 1), lambda x: struct_pack(e := lower(trim(x)), s := 'MAILTO')), list_transform(regexp_extract_all(shown, {_quoted(extract.ADDRESS)}), lambda x: struct_pack(e := lower(trim(x)), s := 'VISIBLE_TEXT')),
      list_transform(list_concat(regexp_extract_all(shown, {_quoted(extract.BRACKETED)}), regexp_extract_all(shown, {_quoted(extract.SPACED)})), lambda x: struct_pack(e := lower(trim(regexp_replace(regexp_replace(x, '(?i)\s*[\[\(]\s*at\s*[\]\)]\s*', '@', 'g'), '\s+@\s+', '@', 'g'))), s := 'OBFUSCATED_TEXT'))) AS l FROM s),
  u AS (SELECT p_partkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM e)
  SELECT p_partkey, x.e AS email, x.s AS source FROM u WHERE length(x.e) BETWEEN 5 AND 100 AND len(string_split(x.e, '@')) >= 2 AND NOT list_contains({_list(mail.PERSONAL_DOMAINS)}, split_part(x.e, '@', 2)) AND split_part(x.e, '@', 1) <> '' AND split_part(x.e, '@', 2) <> '' QUALIFY row_number() OVER (PARTITION BY p_partkey, x.e ORDER BY i) = 1"""
_PROFILE_LINKS = f"""WITH p AS (SELECT page_id, html || '<a href="https://www.linkedin.com/in/p-' || page_id || '/">x</a> https://linkedin.com/company/c?y https://www.linkedin.com/in/p-' || page_id AS page FROM pages),
  u AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(page, {_quoted(extract.PROFILE)}), lambda x: rtrim(x, '/')))) AS url FROM p)
  SELECT page_id, url, CASE WHEN contains(lower(url), '/in/') THEN 'PERSON_PROFILE' WHEN contains(lower(url), '/company/') THEN 'COMPANY_PAGE' ELSE 'OTHER' END AS type FROM u"""

CATALOGUE = {
    "contact_page_emails": (lambda v: v.spread("part", "p_partkey").select("p_partkey", F.inline(extract.page_emails(reports._contact_page()))), _CONTACTS),
    "profile_links": (checks._profiles, _PROFILE_LINKS),
    "person_names": (_names, _NAMES),
    "profile_names": (_profiles, _PROFILES),
    "link_types": (lambda v: v.table("pages").select("page_id", web.link_type(_linked("page_id")).alias("type")), _LINK_TYPES),
    "same_site": (_bases, _SAME),
    "skipped_links": (_skipped, _SKIPPED),
    "title_words": (_titles, _TITLES),
    "unfenced": (_fenced, _FENCED),
    "section_texts": (_sections, _SECTIONS),
    "role_evidence": (_evidence, _EVIDENCE),
    "email_status": (_statuses, _STATUSES),
}
