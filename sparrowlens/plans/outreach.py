"""Named queries on outreach, enrichment, sessions, pages and streams, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import email as mail
from ..functions import text
from ..operators import enrichment, outreach, sessions
from ..sources.views import CATEGORIES, COMPANY_STATUSES, STAGES, Views
from ..streaming import events as streams

TODAY = "1999-06-15"


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


WITH = f"""WITH companies AS (
  SELECT n_nationkey AS id, n_name AS name, 'https://www.' || lower(replace(n_name, '_', '-')) || '.example.com/shop' AS website,
    ({_sql_list(COMPANY_STATUSES)})[n_nationkey % 8 + 1] AS status, CASE WHEN n_nationkey % 6 <> 0 THEN r_name END AS platform,
    printf('2024-01-%02dT00:00:00Z', n_nationkey + 1) AS updated_at, CASE WHEN n_nationkey % 5 = 0 THEN 'https://reports.example.com/' || n_nationkey END AS report_url
  FROM nation JOIN region ON n_regionkey = r_regionkey),
contacts AS (
  SELECT c_custkey AS id, c_name AS name, c_nationkey AS company_id, CASE WHEN c_custkey % 17 <> 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email, c_mktsegment AS role,
    CASE WHEN c_custkey % 11 = 0 THEN 'unsubscribed' WHEN c_custkey % 13 = 0 THEN 'bounced' ELSE 'active' END AS status, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS opt_out,
    CASE c_custkey % 4 WHEN 1 THEN 'verified' WHEN 2 THEN 'risky' WHEN 3 THEN 'guessed' END AS email_status, c_acctbal AS score FROM customer),
enrollments AS (
  SELECT o_orderkey AS id, o_custkey AS contact_id, o_orderkey % 5 AS sequence_id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'paused' END AS status,
    ({_sql_list(STAGES)})[CAST(o_orderpriority[1] AS INT) + 1] AS deal_stage, strftime(o_orderdate, '%Y-%m-%d') AS started_at, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS ab_variant, o_orderkey % 3 AS experiment_id FROM orders),
raw AS (SELECT *, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'replied' WHEN l_returnflag = 'R' THEN 'bounced' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'sent' WHEN l_returnflag = 'A' THEN 'skipped' WHEN l_linestatus = 'F' THEN 'sent' ELSE 'pending' END AS status FROM lineitem),
evs AS (
  SELECT l_orderkey AS enrollment_id, l_linenumber AS step_order, status, strftime(l_shipdate, '%Y-%m-%d') AS scheduled_date, CASE WHEN status IN ('sent','replied','bounced') THEN strftime(l_shipdate, '%Y-%m-%d') END AS sent_at,
    CASE WHEN status = 'replied' THEN strftime(l_shipdate + INTERVAL 2 DAY, '%Y-%m-%d') END AS replied_at, CAST(l_quantity AS INT) % 3 AS open_count, CAST(l_quantity AS INT) % 2 AS click_count FROM raw)
"""
_CODE = """CASE WHEN trim(coalesce(email, '')) = '' THEN 'NO_EMAIL' WHEN status = 'unsubscribed' THEN 'UNSUBSCRIBED' WHEN status = 'bounced' THEN 'BOUNCED' WHEN opt_out = 1 THEN 'OPTED_OUT'
  WHEN email_status <> 'verified' THEN 'EMAIL_NOT_VERIFIED' WHEN email_status IS NULL THEN 'OK_LEGACY_UNVERIFIED' ELSE 'OK' END"""
_STEPS = f"""WITH steps AS (SELECT conv_id AS session_id, turn AS step, 'P' || (conv_id % 5) AS persona_key, conv_id % 4 * 25 + 10 AS basket_value,
  CASE length(text) % 3 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'PARTIAL' ELSE 'NOTHING' END AS state,
  CASE WHEN conv_id % 9 <> 0 THEN ({_sql_list(CATEGORIES)})[length(text) % 26 + 1] END AS category FROM conversations),
m AS (SELECT *, count(*) FILTER (state <> 'FOUND') OVER (PARTITION BY session_id ORDER BY step) AS miss FROM steps),
s AS (SELECT session_id, persona_key, basket_value, min(step) FILTER (state = 'FOUND') AS found, min(step) FILTER (state <> 'FOUND' AND miss = 3) AS lim, count(*) AS queries, bool_or(state = 'PARTIAL') AS partial FROM m GROUP BY 1, 2, 3),
sessions AS (SELECT session_id, persona_key, basket_value, CASE WHEN found IS NOT NULL AND (lim IS NULL OR found < lim) THEN 'CONVERTED' WHEN partial THEN 'SPLIT_BASKET' ELSE 'ABANDONED' END AS outcome,
  CAST(least(3, (SELECT count(*) FROM steps x WHERE x.session_id = s.session_id AND x.state <> 'FOUND' AND (s.found IS NULL OR x.step < s.found))) AS INT) AS reformulations, queries FROM s)
"""
_RATE = "CAST(CASE WHEN sent > 0 THEN floor(100.0 * {c} / sent + 0.5) ELSE 0 END AS BIGINT) AS {n}"


def _registry(v: Views):
    """A report registry: regions' names and every fourth nation, some without a url."""
    nation = v.table("nation").where("n_nationkey % 4 = 0").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("https://r.example.com/"), F.lower("n_name"))).alias("url"))
    return nation.unionByName(v.table("region").select(F.col("r_name").alias("name"), F.concat(F.lit("https://r.example.com/"), F.lower("r_name")).alias("url")))


_REGISTRY = "reg AS (SELECT n_name AS name, CASE WHEN n_nationkey % 8 = 0 THEN '' ELSE 'https://r.example.com/' || lower(n_name) END AS url FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT r_name, 'https://r.example.com/' || lower(r_name) FROM region)"


def _prospects(v: Views):
    role = lambda k: F.struct(F.when(F.col("c_custkey") % k != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % (k + 1) == 0, F.lit("x")).alias("link"), F.when(F.col("c_custkey") % (k + 2) == 0, F.lit("a@b.example")).alias("email"))
    return v.table("customer").select(F.col("c_custkey").alias("row_key"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("company_name"), F.when(F.col("c_custkey") % 9 != 0, F.lit("https://x.example")).alias("website_url"), F.when(F.col("c_custkey") % 8 != 0, F.lit("DE")).alias("country"), F.lower("c_mktsegment").alias("category"),
        F.create_map(*[x for i, r in enumerate(enrichment.ROLE_SCORES) for x in (F.lit(r), role(i + 2))]).alias("roles"))


_PLAN = """WITH roles(role, k, base) AS (VALUES ('CEO', 2, 25), ('HEAD_OF_ECOMMERCE', 3, 20), ('HEAD_OF_PRODUCT', 4, 12), ('HEAD_OF_GROWTH', 5, 8)),
r AS (SELECT c_custkey AS row_key, role, base, c_custkey % 10 <> 0 AS company, c_custkey % 9 <> 0 AS site, c_custkey % 8 <> 0 AS country, c_custkey % k <> 0 AS n, c_custkey % (k + 1) = 0 AS l, c_custkey % (k + 2) = 0 AS e, lower(c_mktsegment) AS category, role = 'CEO' AS ceo FROM customer CROSS JOIN roles),
t AS (SELECT *, CASE WHEN NOT company THEN 'SKIP_NO_COMPANY_NAME' WHEN NOT site THEN 'SKIP_NO_WEBSITE' WHEN n AND (l OR NOT ceo) AND e THEN 'SKIP_COMPLETE' ELSE 'READY' END AS status FROM r),
tasks AS (SELECT row_key, role, status, CASE WHEN status = 'READY' THEN list_filter([CASE WHEN NOT n THEN 'NAME' END, CASE WHEN ceo AND NOT l THEN 'LINK' END, CASE WHEN NOT e THEN 'EMAIL' END], lambda x: x IS NOT NULL) ELSE [] END AS missing,
  CAST(CASE WHEN status = 'READY' THEN 70 + base + CASE WHEN NOT n THEN 15 ELSE 0 END + CASE WHEN ceo AND NOT l THEN 10 ELSE 0 END + CASE WHEN NOT e THEN 15 ELSE 0 END + CASE WHEN n AND NOT e THEN 8 ELSE 0 END + CASE WHEN ceo AND l AND NOT e THEN 8 ELSE 0 END
   + CASE WHEN country THEN 5 ELSE 0 END + CASE WHEN regexp_matches(category, 'fashion|electronics|home|beauty|marketplace') THEN 4 ELSE 0 END ELSE 0 END AS INT) AS priority FROM t)
"""


def _addresses(v: Views):
    word = F.split("p_name", " ")
    first, last = F.get(word, 0), F.get(word, 1)
    kind = F.col("p_partkey") % 5
    local = F.when(kind == 0, F.concat(first, F.lit("."), last)).when(kind == 1, F.concat(F.left(first, F.lit(1)), last)).when(kind == 2, F.lit("info")).when(kind == 3, F.concat(first, last)).otherwise(first)
    domain = F.when(F.col("p_partkey") % 13 == 0, "gmail.com").otherwise(F.concat(F.lit("d"), (F.col("p_partkey") % 40).cast("string"), F.lit(".example")))
    return v.table("part").select("p_partkey", F.col("p_name").alias("name"), domain.alias("domain"), F.concat(local, F.lit("@"), domain).alias("email"))


_ADDR = """WITH a AS (SELECT p_partkey, p_name AS name, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l, CASE WHEN p_partkey % 13 = 0 THEN 'gmail.com' ELSE 'd' || (p_partkey % 40) || '.example' END AS domain FROM part),
adr AS (SELECT p_partkey, name, f, l, domain, CASE p_partkey % 5 WHEN 0 THEN f || '.' || l WHEN 1 THEN f[1] || l WHEN 2 THEN 'info' WHEN 3 THEN f || l ELSE f END AS local FROM a)
"""


def _webhooks(v: Views):
    kind = F.when(F.col("event_type") == "view", "email.opened").when(F.col("event_type") == "click", "email.clicked").when(F.col("event_type") == "error", "email.bounced").otherwise("email.sent")
    return v.table("events").select("ts", kind.alias("type"), F.col("user_id").alias("provider_id"), F.col("event_id").alias("delivery_id"))


def _actions(v: Views):
    known = v.table("events").select(F.col("user_id").alias("provider_id")).distinct().withColumn("event_id", F.col("provider_id") * 10)
    return streams.routed(_webhooks(v), known)


_VOTES = (
    _ADDR
    + """, sound AS (SELECT local || '@' || domain AS email, local, domain FROM adr WHERE domain <> 'gmail.com' AND local <> 'info'), names AS (SELECT DISTINCT domain, name, f, l FROM adr),
    named AS (SELECT * FROM (SELECT s.domain, email, CASE WHEN local = f || '.' || l THEN 'FIRST_LAST' WHEN local = f || l THEN 'FIRSTLAST' WHEN local = f[1] || l THEN 'F_LAST' WHEN local = f[1] || '.' || l THEN 'F.DOT.LAST' WHEN local = f THEN 'FIRST' WHEN local = l THEN 'LAST'
      WHEN starts_with(local, f[1]) AND ends_with(local, l) AND len(local) > len(l) THEN 'F_LAST' END AS pattern FROM sound s JOIN names USING (domain)) WHERE pattern IS NOT NULL),
    shaped AS (SELECT * FROM (SELECT domain, email, CASE WHEN regexp_matches(local, '^[a-z]{2,}\\.[a-z]{2,}$') THEN 'FIRST_LAST' WHEN regexp_matches(local, '^[a-z]\\.[a-z]{2,}$') THEN 'F.DOT.LAST' END AS pattern FROM sound WHERE domain NOT IN (SELECT domain FROM named)) WHERE pattern IS NOT NULL),
    votes AS (SELECT domain, pattern, count(*) AS votes, min(email) AS first, bool_or(by_name) AS by_name FROM (SELECT *, true AS by_name FROM named UNION ALL SELECT *, false FROM shaped) GROUP BY 1, 2),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY votes DESC, first, pattern) AS n FROM votes) WHERE n = 1)
    SELECT domain, coalesce(pattern, 'UNKNOWN') AS pattern, coalesce(votes, 0) AS votes, CAST(CASE WHEN pattern IS NULL THEN 30 ELSE 50 + CASE WHEN votes >= 2 THEN 25 ELSE 0 END + CASE WHEN addresses >= 2 THEN 10 ELSE 0 END + CASE WHEN by_name THEN 15 ELSE 0 END END AS INT) AS confidence
    FROM (SELECT domain, count(*) AS addresses FROM sound GROUP BY 1) LEFT JOIN best USING (domain)"""
)
_WIDE = "lower(text)"
for _letter, _pair in text.WIDE_ACCENTS.items():
    _WIDE = f"replace({_WIDE}, '{_letter}', '{_pair}')"

CATALOGUE = {
    "companies_page": (lambda v: outreach.companies_page(outreach.contacts_count(v.companies(), v.contacts()), search="nation_1", descending=True, limit=8), WITH + ", n AS (SELECT company_id, count(*) AS contacts_count FROM contacts GROUP BY 1) SELECT c.*, coalesce(contacts_count, 0) AS contacts_count FROM companies c LEFT JOIN n ON n.company_id = c.id WHERE contains(lower(name), 'nation_1') OR contains(website, 'nation_1') ORDER BY status = 'not-interested', updated_at DESC, id LIMIT 8"),
    "companies_by_tag": (lambda v: outreach.with_any_tag(v.companies(), v.table("supplier").select(F.col("s_nationkey").alias("company_id"), (F.col("s_suppkey") % 20).alias("tag_id")), 3), WITH + "SELECT * FROM companies WHERE id IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 20 = 3)"),
    "contacts_count": (lambda v: outreach.contacts_count(v.companies(), v.contacts()).select("id", "contacts_count"), WITH + "SELECT id, (SELECT count(*) FROM contacts c WHERE c.company_id = companies.id) AS contacts_count FROM companies"),
    "contact_company_left": (lambda v: v.contacts().join(v.companies().select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left").select("id", "name", "company"), WITH + "SELECT c.id, c.name, o.name AS company FROM contacts c LEFT JOIN companies o ON o.id = c.company_id"),
    "has_report_flag": (lambda v: outreach.with_report_flag(v.companies(), _registry(v)).select("id", "has_report"), WITH + f", {_REGISTRY}, k AS (SELECT DISTINCT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM reg WHERE url <> '') SELECT id, report_url IS NOT NULL OR regexp_replace(lower(name), '[^a-z0-9]', '', 'g') IN (SELECT k FROM k) OR regexp_replace(split_part(regexp_replace(website, '^https?://(www\\.)?', ''), '.', 1), '[^a-z0-9]', '', 'g') IN (SELECT k FROM k) AS has_report FROM companies"),
    "report_full_outer": (lambda v: outreach.merged_reports(v.companies(), _registry(v)), WITH + f", {_REGISTRY}, a AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, name, report_url AS url FROM companies WHERE report_url IS NOT NULL), b AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, name, url FROM reg WHERE url <> '') SELECT coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS name, coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NOT NULL THEN 'company' ELSE 'registry' END AS origin FROM a FULL JOIN b ON a.key = b.key"),
    "outreach_guard": (lambda v: outreach.readiness(v.contacts()).select("id", "code", "ready"), WITH + f"SELECT id, {_CODE} AS code, starts_with({_CODE}, 'OK') AS ready FROM contacts"),
    "dashboard_scalars": (
        lambda v: outreach.dashboard(v.companies(), v.contacts(), v.outreach_events(), v.enrollments(), TODAY),
        WITH
        + f"""SELECT (SELECT count(*) FROM companies) AS total_companies, (SELECT count(*) FROM companies WHERE status = 'meeting-booked') AS meetings_booked, (SELECT count(*) FROM contacts) AS total_contacts,
        count(*) FILTER (status IN ('sent','replied')) AS emails_sent, count(*) FILTER (status IN ('sent','replied') AND sent_at >= '{TODAY[:8]}01') AS emails_sent_this_month,
        (SELECT count(*) FROM evs e JOIN enrollments n ON n.id = e.enrollment_id WHERE e.status = 'pending' AND n.status = 'active' AND scheduled_date <= '{TODAY}') AS tasks_due_today,
        CAST(floor(100.0 * count(*) FILTER (status = 'replied') / count(*) FILTER (status IN ('sent','replied')) + 0.5) AS BIGINT) AS response_rate FROM evs""",
    ),
    "status_distribution": (lambda v: outreach.counts_by(v.companies(), F.col("status"), "status"), WITH + "SELECT status, count(*) AS count FROM companies GROUP BY 1"),
    "platform_distribution": (lambda v: outreach.counts_by(v.companies(), outreach.platform_name(F.col("platform")), "platform", 10), WITH + "SELECT coalesce(nullif(platform, ''), 'Unknown') AS platform, count(*) AS count FROM companies GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "recent_activity": (
        lambda v: outreach.recent_activity(v.outreach_events(), v.enrollments(), v.contacts(), v.companies()),
        WITH
        + """SELECT CASE WHEN e.status = 'replied' THEN 'reply' ELSE 'sent' END AS type, coalesce(c.name, 'Unknown') || ' (' || coalesce(o.name, '') || ') - Step ' || step_order AS description, coalesce(replied_at, sent_at) AS date
        FROM evs e LEFT JOIN enrollments n ON n.id = e.enrollment_id LEFT JOIN contacts c ON c.id = n.contact_id LEFT JOIN companies o ON o.id = c.company_id WHERE e.status IN ('sent','replied') ORDER BY 3 DESC, 2, 1 LIMIT 10""",
    ),
    "step_funnel": (lambda v: outreach.step_funnel(v.outreach_events()), WITH + f"SELECT *, {_RATE.format(c='opened', n='open_rate')}, {_RATE.format(c='clicked', n='click_rate')}, {_RATE.format(c='replied', n='reply_rate')} FROM (SELECT step_order, count(*) FILTER (status IN ('sent','replied')) AS sent, count(*) FILTER (open_count > 0) AS opened, count(*) FILTER (click_count > 0) AS clicked, count(*) FILTER (status = 'replied') AS replied FROM evs GROUP BY 1)"),
    "ab_variant_stats": (lambda v: outreach.variant_stats(v.enrollments(), v.outreach_events()), WITH + ", p AS (SELECT enrollment_id, count(*) FILTER (status IN ('sent','replied')) AS s, count(*) FILTER (status = 'replied') AS r FROM evs GROUP BY 1) SELECT experiment_id, ab_variant, count(*) AS enrolled, CAST(coalesce(sum(s), 0) AS BIGINT) AS sent, CAST(coalesce(sum(r), 0) AS BIGINT) AS replied FROM enrollments n LEFT JOIN p ON p.enrollment_id = n.id GROUP BY 1, 2"),
    "pipeline_board": (lambda v: outreach.pipeline_board(v.enrollments(), STAGES), WITH + f", d AS (SELECT unnest({_sql_list(STAGES)}) AS deal_stage, CAST(unnest(range(6)) AS INT) AS place) SELECT d.deal_stage, place, count(e.id) AS count FROM d LEFT JOIN enrollments e ON e.deal_stage = d.deal_stage GROUP BY 1, 2"),
    "contact_timeline": (lambda v: outreach.timeline(v.outreach_events()), WITH + "SELECT enrollment_id, step_order, 'email_sent' AS type, sent_at AS date FROM evs WHERE sent_at IS NOT NULL UNION ALL SELECT enrollment_id, step_order, 'email_replied', replied_at FROM evs WHERE replied_at IS NOT NULL UNION ALL SELECT enrollment_id, step_order, 'email_bounced', sent_at FROM evs WHERE status = 'bounced'"),
    "due_tasks": (lambda v: outreach.due_tasks(v.outreach_events(), v.enrollments(), v.contacts(), TODAY), WITH + f"SELECT e.enrollment_id, n.contact_id, e.step_order, e.scheduled_date, e.scheduled_date < '{TODAY}' AS overdue FROM evs e JOIN enrollments n ON n.id = e.enrollment_id JOIN contacts c ON c.id = n.contact_id WHERE e.status = 'pending' AND n.status = 'active' AND scheduled_date <= '{TODAY}' AND c.id IN (SELECT id FROM contacts WHERE starts_with({_CODE}, 'OK'))"),
    "schedule_dates": (
        lambda v: outreach.schedule(v.spark.range(20).select((F.col("id") % 5).alias("sequence_id"), (F.floor(F.col("id") / 5) + 1).cast("int").alias("step_order"), (F.col("id") % 7).cast("int").alias("delay_days")), v.enrollments().select("id", "sequence_id", "started_at")),
        WITH + ", steps AS (SELECT i % 5 AS sequence_id, CAST(i // 5 + 1 AS INT) AS step_order, i % 7 AS d FROM range(20) t(i)), a AS (SELECT sequence_id, step_order, CAST(sum(d) OVER (PARTITION BY sequence_id ORDER BY step_order) AS INT) AS after FROM steps) SELECT id, step_order, strftime(CAST(started_at AS DATE) + after, '%Y-%m-%d') AS scheduled_date FROM enrollments JOIN a USING (sequence_id)",
    ),
    "first_open": (lambda v: streams.counters(_actions(v)).drop("bounced"), "SELECT user_id * 10 AS event_id, count(*) FILTER (event_type = 'view') AS open_count, min(ts) FILTER (event_type = 'view') AS opened_at, count(*) FILTER (event_type = 'click') AS click_count, min(ts) FILTER (event_type = 'click') AS clicked_at FROM events WHERE event_type IN ('view','click','error') GROUP BY 1"),
    "enrollment_state": (
        lambda v: streams.enrollment_state(v.outreach_events()),
        WITH + "SELECT enrollment_id, state, CASE WHEN state IN ('replied','bounced') THEN p ELSE 0 END AS skipped, CASE WHEN state = 'active' THEN coalesce(last, 0) + 1 END AS next_step FROM (SELECT *, CASE WHEN r > 0 THEN 'replied' WHEN b > 0 THEN 'bounced' WHEN p = 0 THEN 'completed' ELSE 'active' END AS state FROM (SELECT enrollment_id, count(*) FILTER (status = 'replied') AS r, count(*) FILTER (status = 'bounced') AS b, count(*) FILTER (status = 'pending') AS p, max(step_order) FILTER (status IN ('sent','replied')) AS last FROM evs GROUP BY 1))",
    ),
    "windowed_events": (lambda v: streams.windowed(v.table("events")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "user_sessions": (lambda v: streams.user_sessions(v.table("events")).select("user_id", F.col("session_window.start").alias("start"), "n"), "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"),
    "hash_split": (lambda v: outreach.split_variants(v.contacts().select("id"), 7), "SELECT c_custkey AS id, CASE WHEN ('0x' || left(md5(c_custkey || '|7'), 8))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS variant FROM customer"),
    "task_plan": (lambda v: enrichment.role_tasks(_prospects(v)), _PLAN + "SELECT * FROM tasks"),
    "task_summary": (lambda v: enrichment.task_summary(enrichment.role_tasks(_prospects(v))), _PLAN + "SELECT role, status, count(*) AS n, count(*) FILTER (status = 'READY') AS ready FROM tasks GROUP BY GROUPING SETS ((role), (status), ())"),
    "fill_rate": (lambda v: enrichment.fill_rates(v.contacts(), ["name", "email", "email_status"]), WITH + " SELECT 'name' AS \"column\", count(name) AS filled, CAST(floor(100.0 * count(name) / count(*) + 0.5) AS BIGINT) AS percent FROM contacts UNION ALL SELECT 'email', count(email), CAST(floor(100.0 * count(email) / count(*) + 0.5) AS BIGINT) FROM contacts UNION ALL SELECT 'email_status', count(email_status), CAST(floor(100.0 * count(email_status) / count(*) + 0.5) AS BIGINT) FROM contacts"),
    "email_gate": (lambda v: _addresses(v).select("p_partkey", F.coalesce(mail.gate(F.col("email")), F.lit("OK")).alias("gate")), _ADDR + "SELECT p_partkey, CASE WHEN domain = 'gmail.com' THEN 'PERSONAL_DOMAIN' WHEN local = 'info' THEN 'ROLE_INBOX' ELSE 'OK' END AS gate FROM adr"),
    "email_pattern": (lambda v: _addresses(v).select("p_partkey", mail.classify(mail.parts(F.col("email"))[0], F.col("name")).alias("pattern")), _ADDR + "SELECT p_partkey, CASE WHEN local = f || '.' || l THEN 'FIRST_LAST' WHEN local = f || l THEN 'FIRSTLAST' WHEN local = f[1] || l THEN 'F_LAST' WHEN local = f[1] || '.' || l THEN 'F.DOT.LAST' WHEN local = f THEN 'FIRST' WHEN local = l THEN 'LAST' WHEN starts_with(local, f[1]) AND ends_with(local, l) AND len(local) > len(l) THEN 'F_LAST' ELSE 'UNKNOWN' END AS pattern FROM adr"),
    "email_candidates": (lambda v: _addresses(v).select("p_partkey", F.posexplode(mail.candidates(F.col("name"), F.col("domain"))).alias("place", "candidate")), _ADDR + "SELECT p_partkey, CAST(place - 1 AS INT) AS place, cs[place] AS candidate FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS place FROM (SELECT p_partkey, list_filter(c, lambda x, i: list_position(c, x) = i) AS cs FROM (SELECT p_partkey, [f || '.' || l || '@' || domain, f || l || '@' || domain, f || '@' || domain, f[1] || '.' || l || '@' || domain, f[1] || l || '@' || domain] AS c FROM adr WHERE domain <> 'gmail.com')))"),
    "email_pattern_vote": (lambda v: enrichment.pattern_votes(_addresses(v).select("email"), _addresses(v).select("domain", "name").distinct()), _VOTES),
    "session_outcomes": (lambda v: sessions.outcomes(v.session_steps()), _STEPS + "SELECT * FROM sessions"),
    "persona_aggregate": (lambda v: sessions.persona_aggregate(sessions.outcomes(v.session_steps())), _STEPS + "SELECT persona_key, count(*) AS sessions, count(*) FILTER (outcome = 'CONVERTED') AS converted, count(*) FILTER (outcome = 'SPLIT_BASKET') AS split_basket, count(*) FILTER (outcome = 'ABANDONED') AS abandoned, round_even(count(*) FILTER (outcome = 'CONVERTED') / count(*), 2) AS conversion_rate, round_even(avg(reformulations), 1) AS avg_reformulations, CAST(sum(CASE WHEN outcome <> 'CONVERTED' THEN basket_value ELSE 0 END) AS BIGINT) AS revenue_lost FROM sessions GROUP BY GROUPING SETS ((persona_key), ())"),
    "state_pivot": (lambda v: sessions.state_distribution(v.session_steps()), _STEPS + "SELECT persona_key, count(*) FILTER (state = 'FOUND') AS \"FOUND\", count(*) FILTER (state = 'PARTIAL') AS \"PARTIAL\", count(*) FILTER (state = 'NOTHING') AS \"NOTHING\" FROM steps GROUP BY 1"),
    "entry_friction": (lambda v: sessions.entry_friction(v.session_steps()), _STEPS + "SELECT persona_key, round_even(avg(CASE WHEN state <> 'FOUND' THEN 1.0 ELSE 0.0 END), 2) AS entry_friction FROM steps WHERE step = 0 GROUP BY 1"),
    "category_failure": (lambda v: sessions.category_failure(v.session_steps()), _STEPS + "SELECT coalesce(category, 'UNKNOWN') AS category, round_even(avg(CASE WHEN state <> 'FOUND' THEN 1.0 ELSE 0.0 END), 2) AS failure_rate, count(*) AS total FROM steps GROUP BY 1"),
    "deep_reformulators": (lambda v: sessions.outcomes(v.session_steps()).where("reformulations >= 3").agg(F.count("*").alias("n")), _STEPS + "SELECT count(*) AS n FROM sessions WHERE reformulations >= 3"),
    "remaining_anti": (lambda v: enrichment.remaining(v.queries().select("query_id"), v.scored().select("query_id").distinct(), ["query_id"]), "SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "token_intersection": (lambda v: v.table("part").select("p_partkey", F.round(enrichment.token_overlap(F.col("p_name"), F.lit("small blue ring")), 6).alias("overlap")), "SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, ' ')), ['small','blue','ring'])) / least(len(list_distinct(string_split(p_name, ' '))), 3), 6) AS overlap FROM part"),
    "page_domain": (lambda v: v.table("pages").select("page_id", mail.domain_of(F.col("url")).alias("domain")), "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages"),
    "nav_links": (lambda v: v.table("pages").select("page_id", F.posexplode(F.regexp_extract_all(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1), F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("place", "label")), "SELECT page_id, CAST(i AS INT) AS place, l[i + 1] AS label FROM (SELECT page_id, l, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS l FROM pages))"),
    "document_emails": (lambda v: v.table("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0)))).alias("email")), "SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+'))) AS email FROM documents"),
    "accent_folding": (lambda v: v.table("documents").select("doc_id", F.md5(text.without_accents(F.col("text"))).alias("folded")), f"SELECT doc_id, md5(translate({_WIDE}, '{text.ACCENTED}', '{text.UNACCENTED}')) AS folded FROM documents"),
    "balanced_counts": (lambda v: enrichment.balanced(v.spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, place int"), 60), f"SELECT c AS category, CAST(2 + CASE WHEN i < 8 THEN 1 ELSE 0 END AS INT) AS target FROM (SELECT unnest({_sql_list(CATEGORIES)}) AS c, unnest(range(26)) AS i)"),
}
