"""Named queries on contacts, imports, reminders and message transitions, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, web
from ..operators import contacts, outreach
from ..sources import files
from ..sources.views import Views
from ..streaming import enrollments
from .outreach import _CODE, TODAY
from .outreach import WITH as OUTREACH


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


HEADERS = [" Company ", "URL", "niche", "CMS", "Search", "Headcount", "ARR", "li", "X", "fb", "memo", "Stage", "audit", "Location", "locale", "Fax", ""]
_FIELDS = " ".join(f"WHEN list_contains({_list(aliases)}, h) THEN '{field}'" for field, aliases in contacts.HEADER_ALIASES.items())


def _headers(v: Views):
    return v.table("supplier").select("s_suppkey", F.get(F.array(*map(F.lit, HEADERS)), (F.col("s_suppkey") % len(HEADERS)).cast("int")).alias("header"))


def _import(v: Views):
    """Rows of an import made from customers: blanks, unknown states, and company names in other writing."""
    k = F.col("c_custkey")
    company = F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("n_name"), F.lit(" "))).when(k % 7 == 0, "Nowhere").when(k % 5 == 0, "  ").otherwise(F.lower("n_name"))
    rows = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        (k + 1).alias("row"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("c_name"))).alias("name"), F.when(k % 17 != 0, F.concat(F.col("c_name"), F.lit("@example.com"))).alias("email"),
        F.col("c_mktsegment").alias("role"), F.get(F.array(*map(F.lit, ["active", "bounced", "vip", "", "replied"])), (k % 5).cast("int")).alias("status"), company.alias("company_name"))
    twice = v.companies().unionByName(v.companies().where("id < 5").withColumn("id", F.col("id") + 1000))
    return contacts.import_contacts(rows, twice)


_IMPORT = (
    OUTREACH
    + """, src AS (SELECT c_custkey + 1 AS row, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 17 <> 0 THEN c_name || '@example.com' END AS email, c_mktsegment AS role,
      ['active', 'bounced', 'active', NULL, 'replied'][c_custkey % 5 + 1] AS status,
      CASE WHEN c_custkey % 3 = 0 THEN upper(n_name) WHEN c_custkey % 7 = 0 THEN 'Nowhere' WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(n_name) END AS company_name
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
    byname AS (SELECT lower(name) AS key, CASE WHEN max(id) < 5 THEN max(id) + 1000 ELSE max(id) END AS company_id FROM companies GROUP BY 1),
    done AS (SELECT src.*, company_id, name IS NOT NULL AND email IS NOT NULL AS imported,
      CASE WHEN name IS NULL THEN 'Row ' || row || ': Missing required field "name". Skipped.' WHEN email IS NULL THEN 'Row ' || row || ' ("' || name || '"): Missing required field "email". Skipped.'
      WHEN company_name IS NOT NULL AND company_id IS NULL THEN 'Row ' || row || ' ("' || name || '"): Company "' || company_name || '" not found — contact imported without company link.' END AS error
      FROM src LEFT JOIN byname ON key = lower(company_name)) """
)


def _reminders(v: Views):
    k = F.col("o_orderkey")
    return v.table("orders").where(k % 4 == 0).select(k.alias("id"), F.col("o_custkey").alias("contact_id"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due_date"), F.when(k % 8 == 0, F.lit(1)).when(k % 3 == 0, F.lit(0)).alias("is_completed"), F.col("o_orderdate").alias("created_at"))


def _tasks(v: Views):
    due = outreach.due_tasks(v.outreach_events(), v.enrollments(), v.contacts(), TODAY)
    named = v.contacts().select(F.col("id").alias("contact_id"), "company_id").join(v.companies().select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id", "left")
    return due.join(named, "contact_id", "left").withColumn("send_hour", F.when(F.col("enrollment_id") % 3 != 0, (F.col("enrollment_id") % 24).cast("int")))


_TASKS = (
    OUTREACH
    + f""", due AS (SELECT e.enrollment_id, n.contact_id, e.step_order, e.scheduled_date, e.scheduled_date < '{TODAY}' AS overdue FROM evs e JOIN enrollments n ON n.id = e.enrollment_id
      WHERE e.status = 'pending' AND n.status = 'active' AND scheduled_date <= '{TODAY}' AND n.contact_id IN (SELECT id FROM contacts WHERE starts_with({_CODE}, 'OK'))),
    tasks AS (SELECT due.*, o.name AS company_name, CASE WHEN enrollment_id % 3 <> 0 THEN CAST(enrollment_id % 24 AS INT) END AS send_hour FROM due LEFT JOIN contacts c ON c.id = contact_id LEFT JOIN companies o ON o.id = c.company_id) """
)


def _requests(v: Views):
    return v.table("events").where("event_type = 'error'").select(F.col("user_id").alias("contact_id"), "ts")


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def _messages(v: Views):
    """Messages numbered within their enrollment, with what happened to each; all are open at first but those of even quantity, which were sent."""
    lines = v.table("lineitem").select("l_orderkey", *_ORDER, "l_returnflag", "l_linestatus")
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    returned, line = F.col("l_returnflag"), F.col("l_linestatus")
    action = F.when((returned == "R") & (line == "F"), "replied").when(returned == "R", "bounced").when((returned == "A") & (line == "O"), "skipped").when(line == "F", "sent")
    status = F.when(F.col("l_quantity").cast("int") % 5 == 0, "sent").otherwise("pending")
    return lines.select(F.col("l_orderkey").alias("enrollment_id"), step.alias("step_order"), status.alias("status"), action.alias("action"), F.col("l_shipdate").alias("ts"), step.alias("ord"))


def _transitions(v: Views):
    own = _messages(v)
    return contacts.transitions(own.select("enrollment_id", "step_order", "status"), own.where("action is not null").select("enrollment_id", "step_order", "action", "ts", "ord"))


STATES = ["enrollment_id", "status", "current_step", "completed_at", "deal_stage", "skipped"]


def _streamed(v: Views):
    """The same actions as a stream in several micro-batches, in no order of time; some of them are delivered again at last."""
    folder, own = files.shared_folder(v.spark, "enrollments"), _messages(v)
    own.select("enrollment_id", "step_order", "status").write.parquet(f"{folder}/messages")
    actions = own.where("action is not null").select("enrollment_id", "step_order", "action", "ts", F.col("ord").cast("long").alias("ord"))
    part = F.pmod(F.xxhash64("enrollment_id", "ord"), F.lit(4))
    actions.withColumn("turn", part).unionAll(actions.withColumn("turn", F.lit(4)).where(part == 1)).repartitionByRange("turn", "enrollment_id").drop("turn").write.parquet(f"{folder}/actions")
    n = len(v.spark.read.parquet(f"{folder}/actions").inputFiles())
    return enrollments.run(v.spark, f"{folder}/messages", f"{folder}/actions", f"{folder}/stream", "enrollment_id long, step_order int, action string, ts timestamp, ord long", max(1, -(-n // 4)))


def _statuses(v: Views):
    return contacts.contact_statuses(v.contacts().select("id", "status"), v.enrollments(), _transitions(v))


_TRANSITIONS = f"""WITH m AS (SELECT l_orderkey AS enrollment_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS INT) AS step_order, CASE WHEN CAST(l_quantity AS INT) % 5 = 0 THEN 'sent' ELSE 'pending' END AS status,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'replied' WHEN l_returnflag = 'R' THEN 'bounced' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'skipped' WHEN l_linestatus = 'F' THEN 'sent' END AS action, l_shipdate AS ts FROM lineitem),
  a AS (SELECT *, (SELECT count(*) FROM m o WHERE o.enrollment_id = m.enrollment_id AND o.status = 'pending') AS open FROM m WHERE action IS NOT NULL),
  s AS (SELECT *, sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) OVER w AS gone, coalesce(bool_or(action IN ('replied', 'bounced')) OVER (PARTITION BY enrollment_id ORDER BY ts, step_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM a WINDOW w AS (PARTITION BY enrollment_id ORDER BY ts, step_order ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT *, CASE WHEN action IN ('replied', 'bounced') THEN action WHEN action = 'sent' AND (ended OR gone >= open) THEN 'completed' END AS sets, row_number() OVER (PARTITION BY enrollment_id ORDER BY ts, step_order) AS n FROM s)
  SELECT enrollment_id, coalesce(arg_max(sets, CASE WHEN sets IS NOT NULL THEN n END), 'active') AS status, CAST(arg_max(step_order + 1, CASE WHEN action = 'sent' THEN n END) AS INT) AS current_step, max(ts) FILTER (sets IN ('replied', 'completed')) AS completed_at,
    max(CASE WHEN action = 'replied' THEN 'replied' END) AS deal_stage, CASE WHEN bool_or(action IN ('replied', 'bounced')) THEN max(open) - count(*) FILTER (status = 'pending') ELSE 0 END AS skipped FROM t GROUP BY 1"""


_STATUSES = OUTREACH + ", " + _TRANSITIONS[len("WITH ") : _TRANSITIONS.index("\n  SELECT enrollment_id, coalesce")] + """,
  e AS (SELECT enrollments.contact_id, arg_max(action, t.ts::VARCHAR || action) AS last_action, max(t.ts) AS at FROM t JOIN enrollments ON enrollments.id = t.enrollment_id WHERE action IN ('replied', 'bounced') GROUP BY 1)
  SELECT c.id, coalesce(e.last_action, c.status) AS status, e.at AS updated_at FROM contacts c LEFT JOIN e ON e.contact_id = c.id"""


def _activity(v: Views):
    mail = v.outreach_events().join(v.enrollments().select(F.col("id").alias("enrollment_id"), "contact_id", "sequence_id"), "enrollment_id")
    prefix = F.concat(F.lit("Sequence "), F.col("sequence_id").cast("string"), F.lit(" — Step "), F.col("step_order").cast("string"))
    after = lambda count: F.when(F.col(count) > 0, F.col("sent_at"))
    notes = v.table("orders").select(F.col("o_custkey").alias("contact_id"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    return contacts.activity({
        "email_sent": (mail, F.col("sent_at"), F.concat(prefix, F.lit(" sent"))),
        "email_opened": (mail, after("open_count"), F.concat(prefix, F.lit(" opened"))),
        "email_clicked": (mail, after("click_count"), F.concat(prefix, F.lit(" link clicked"))),
        "email_replied": (mail, F.col("replied_at"), F.concat(prefix, F.lit(" — replied"))),
        "email_bounced": (mail, F.when(F.col("status") == "bounced", F.col("sent_at")), F.concat(prefix, F.lit(" bounced"))),
        "comment": (notes.where("o_orderkey % 10 = 0"), F.col("day"), F.col("o_orderpriority")),
        "reminder": (notes.where("o_orderkey % 4 = 0"), F.col("day"), F.col("o_orderpriority")),
    })


_PREFIX = "'Sequence ' || sequence_id || ' — Step ' || step_order"
_ACTIVITY = (
    OUTREACH
    + f""", mail AS (SELECT e.*, contact_id, sequence_id FROM evs e JOIN enrollments n ON n.id = e.enrollment_id), every AS (
    SELECT contact_id, 'email_sent' AS type, sent_at AS date, {_PREFIX} || ' sent' AS description FROM mail UNION ALL SELECT contact_id, 'email_opened', CASE WHEN open_count > 0 THEN sent_at END, {_PREFIX} || ' opened' FROM mail
    UNION ALL SELECT contact_id, 'email_clicked', CASE WHEN click_count > 0 THEN sent_at END, {_PREFIX} || ' link clicked' FROM mail UNION ALL SELECT contact_id, 'email_replied', replied_at, {_PREFIX} || ' — replied' FROM mail
    UNION ALL SELECT contact_id, 'email_bounced', CASE WHEN status = 'bounced' THEN sent_at END, {_PREFIX} || ' bounced' FROM mail UNION ALL SELECT o_custkey, 'comment', strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT o_custkey, 'reminder', strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority FROM orders WHERE o_orderkey % 4 = 0) SELECT * FROM every WHERE date IS NOT NULL"""
)


def _vars(v: Views):
    k = F.col("p_partkey")
    values = F.create_map(F.lit("score"), F.when(k % 3 != 0, k.cast("string")), F.lit("worst_query"), F.when(k % 2 == 0, F.col("p_name")).otherwise(""), F.lit("other"), F.lit("x"))
    return v.table("part").select("p_partkey", contacts.audit_variables(values).alias("vars")).select("p_partkey", F.col("vars").isNull().alias("none"), F.try_element_at("vars", F.lit("score")).alias("score"), F.try_element_at("vars", F.lit("worst_query")).alias("worst_query"), F.try_element_at("vars", F.lit("other")).alias("other"))


STATUSES = ["valid", "invalid", "disposable", "accept_all", "verified", "likely_to_engage", "odd"]


def _results(v: Views):
    k = F.col("s_suppkey")
    status = F.get(F.array(*map(F.lit, ["verified", "risky", "invalid", "none"])), (k % 4).cast("int"))
    outcome = F.when(k % 11 == 0, "error").when(k % 4 == 3, "not_found").otherwise("found")
    reasons = F.filter(F.array(F.when(k % 5 == 0, "gate: PERSONAL_DOMAIN"), F.when(k % 7 == 0, "ROLE_INBOX"), F.lit("looked up")), lambda r: r.isNotNull())
    return v.table("supplier").select(F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider"), outcome.alias("outcome"), status.alias("status"), reasons.alias("reasons"), (k % 2).alias("credits"))


CATALOGUE = {
    "import_mapping": (lambda v: _headers(v).select("s_suppkey", contacts.suggested_field(F.col("header")).alias("field")), f"SELECT s_suppkey, CASE {_FIELDS} END AS field FROM (SELECT s_suppkey, lower(trim(({_list(HEADERS)})[s_suppkey % {len(HEADERS)} + 1])) AS h FROM supplier)"),
    "import_contacts": (lambda v: _import(v).where("imported").select("row", "name", "email", "role", "status", "company_id"), _IMPORT + "SELECT row, name, email, role, status, company_id FROM done WHERE imported"),
    "import_errors": (lambda v: _import(v).where("error is not null").select("row", "error"), _IMPORT + "SELECT row, error FROM done WHERE error IS NOT NULL"),
    "contacts_search": (lambda v: contacts.page_with_total(contacts.search_contacts(v.contacts().select("id", "name", "email", "role", "status", "company_id"), search="R.0", status="active", role="BUILDING"), [F.desc("id")], 3, 20), OUTREACH + ", hit AS (SELECT id, name, email, role, status, company_id FROM contacts WHERE (contains(lower(name), 'r.0') OR contains(lower(email), 'r.0')) AND status = 'active' AND role = 'BUILDING') SELECT *, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY id DESC LIMIT 20 OFFSET 3"),
    "unsubscribed_page": (lambda v: contacts.page_with_total(contacts.search_contacts(v.contacts().select("id", "name", "email", "status"), search="#0", status="unsubscribed"), ["name"], 0, 10), OUTREACH + ", hit AS (SELECT id, name, email, status FROM contacts WHERE (contains(lower(name), '#0') OR contains(email, '#0')) AND status = 'unsubscribed') SELECT *, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY name LIMIT 10"),
    "enrol_picker": (lambda v: contacts.search_contacts(v.contacts(), search="02").join(v.enrollments().select(F.col("contact_id").alias("id")), "id", "left_anti").orderBy("name").limit(8).select("id", "name"), OUTREACH + "SELECT id, name FROM contacts WHERE (contains(lower(name), '02') OR contains(email, '02')) AND id NOT IN (SELECT contact_id FROM enrollments) ORDER BY name LIMIT 8"),
    "company_contacts": (lambda v: v.contacts().where("company_id = 7").orderBy(F.lower("name"), "name").select("id", "name"), OUTREACH + "SELECT id, name FROM contacts WHERE company_id = 7"),
    "reminders_due": (lambda v: contacts.reminders(_reminders(v), completed=False, due_by="1997-06-30").select("id", "contact_id", "title", "due_date"), "SELECT o_orderkey AS id, o_custkey AS contact_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS due_date FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') <= '1997-06-30'"),
    "reminders_completed": (lambda v: contacts.reminders(_reminders(v), completed=True).agg(F.count("*").alias("n"), F.min("due_date").alias("first")), "SELECT count(*) AS n, min(strftime(o_orderdate, '%Y-%m-%d')) AS first FROM orders WHERE o_orderkey % 8 = 0"),
    "tasks_sorted": (lambda v: contacts.in_task_order(_tasks(v), 100).select("place", "enrollment_id", "step_order", "scheduled_date", "company_name"), _TASKS + "SELECT CAST(row_number() OVER w AS INT) AS place, enrollment_id, step_order, scheduled_date, company_name FROM tasks WINDOW w AS (ORDER BY scheduled_date, coalesce(send_hour, 9), company_name, enrollment_id, step_order) ORDER BY place LIMIT 100"),
    "tasks_by_company": (lambda v: contacts.tasks_by_company(_tasks(v)), _TASKS + "SELECT company_name, count(*) AS tasks, count(*) FILTER (overdue) AS overdue, min(scheduled_date) AS first_due FROM tasks GROUP BY 1"),
    "audit_variables": (_vars, "SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 2 <> 0 AS none, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS score, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS worst_query, CAST(NULL AS VARCHAR) AS other FROM part"),
    "unsubscribed_contacts": (lambda v: contacts.unsubscribed(v.contacts(), _requests(v)).select("id", "status", "opt_out", "opt_out_at"), OUTREACH + ", r AS (SELECT user_id, max(ts) AS last_at FROM events WHERE event_type = 'error' GROUP BY 1) SELECT id, CASE WHEN last_at IS NOT NULL THEN 'unsubscribed' ELSE status END AS status, CASE WHEN last_at IS NOT NULL THEN 1 ELSE opt_out END AS opt_out, last_at AS opt_out_at FROM contacts LEFT JOIN r ON user_id = id"),
    "paused_enrollments": (lambda v: contacts.paused(v.enrollments(), _requests(v)).select("id", "status", "paused_at"), OUTREACH + ", r AS (SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'error' GROUP BY 1) SELECT id, CASE WHEN first_at IS NOT NULL AND status = 'active' THEN 'paused' ELSE status END AS status, CASE WHEN status = 'active' THEN first_at END AS paused_at FROM enrollments LEFT JOIN r ON user_id = contact_id"),
    "resumed_enrollments": (lambda v: contacts.resumed_enrollments(contacts.paused(v.enrollments(), _requests(v))).groupBy("status").agg(F.count("*").alias("n"), F.count("paused_at").alias("paused")), OUTREACH + "SELECT CASE WHEN status = 'paused' THEN 'active' ELSE status END AS status, count(*) AS n, 0 AS paused FROM enrollments GROUP BY 1"),
    "message_transitions": (lambda v: _transitions(v).select(*STATES), _TRANSITIONS),
    "streamed_transitions": (lambda v: _streamed(v).select(*STATES).withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz")), _TRANSITIONS),
    "contact_statuses": (_statuses, _STATUSES),
    "contact_activity": (_activity, _ACTIVITY),
    "resume_shift": (
        lambda v: outreach.resumed(v.table("events").select("event_id", F.date_format(F.date_add("ts", 3), "yyyy-MM-dd").alias("scheduled_date"), F.col("ts").cast("timestamp").alias("paused_at")), F.lit("2024-02-03 04:05:06").cast("timestamp")).select("event_id", "pause_days", "new_date"),
        "SELECT event_id, CAST(d AS INT) AS pause_days, strftime(CAST(ts AS DATE) + 3 + CAST(d AS INT), '%Y-%m-%d') AS new_date FROM (SELECT event_id, ts, ceil((epoch_us(TIMESTAMP '2024-02-03 04:05:06') - epoch_us(ts)) / 86400000000) AS d FROM events)",
    ),
    "decision_counts": (lambda v: contacts.decision_counts(v.table("orders").select(F.col("o_orderpriority").alias("decision"))), "SELECT o_orderpriority AS decision, count(*) AS n FROM orders GROUP BY 1"),
    "verdict_terms": (
        lambda v: v.table("supplier").select("s_suppkey", contacts.verdict(F.when(F.col("s_suppkey") % 2 == 0, "directory").otherwise("network"), F.get(F.array(*map(F.lit, STATUSES)), (F.col("s_suppkey") % 7).cast("int"))).alias("verdict")),
        f"SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s = 'valid' THEN 'valid' WHEN s IN ('invalid', 'disposable', 'webmail') THEN 'invalid' WHEN s = 'accept_all' THEN s ELSE 'unknown' END ELSE CASE s WHEN 'verified' THEN 'valid' WHEN 'likely_to_engage' THEN 'unknown' ELSE 'unverified' END END AS verdict FROM (SELECT s_suppkey, ({_list(STATUSES)})[s_suppkey % 7 + 1] AS s FROM supplier)",
    ),
    "provider_tally": (
        lambda v: contacts.provider_tally(_results(v)),
        "SELECT *, floor(verified * 1000 / attempted + 0.5) / 10 AS usable_rate FROM (SELECT 'p' || (s_suppkey % 3) AS provider, count(*) AS attempted, count(*) FILTER (s_suppkey % 11 <> 0 AND s_suppkey % 4 <> 3) AS found, count(*) FILTER (s_suppkey % 4 = 0) AS verified, count(*) FILTER (s_suppkey % 4 = 1) AS risky, count(*) FILTER (s_suppkey % 4 = 2) AS invalid, count(*) FILTER (s_suppkey % 5 = 0) AS personal_rejected, count(*) FILTER (s_suppkey % 7 = 0) AS role_rejected, count(*) FILTER (s_suppkey % 11 = 0) AS errors, CAST(sum(s_suppkey % 2) AS BIGINT) AS credits_used FROM supplier GROUP BY 1)",
    ),
    "xml_text": (lambda v: v.table("pages").select("page_id", F.md5(text.xml_escaped(F.col("html"))).alias("escaped")), "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM pages"),
    "unwrapped_urls": (
        lambda v: v.table("pages").select("page_id", web.unwrapped(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://www.bing.com/ck/a?x=1&u="), F.when(F.col("page_id") % 3 == 1, "a1").otherwise(""), F.regexp_replace(F.translate(F.base64(F.col("url").cast("binary")), "+/", "-_"), r"[=\r\n]", ""), F.lit("&y=2")))).alias("url")),
        "SELECT page_id, url FROM pages",
    ),
}
