"""Contacts: imports with their errors, searches, reminders, child lists, unsubscriptions and message transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import platform_sentence

# Names of columns that mean a field of a company; the first field in this order counts.
HEADER_ALIASES = {
    "name": ["company", "company name", "company_name", "name", "organization", "org"],
    "website": ["website", "url", "domain", "web", "site", "homepage"],
    "industry": ["industry", "vertical", "niche", "sector", "category"],
    "platform": ["platform", "ecommerce platform", "cms", "shop platform"],
    "search_solution": ["search", "search solution", "search engine", "search provider"],
    "size_estimate": ["size", "employees", "company size", "headcount", "employee count"],
    "revenue_estimate": ["revenue", "annual revenue", "arr", "turnover"],
    "social_linkedin": ["linkedin", "linkedin url", "li"],
    "social_twitter": ["twitter", "twitter url", "x", "x url"],
    "social_facebook": ["facebook", "facebook url", "fb"],
    "notes": ["notes", "comments", "description", "memo"],
    "status": ["status", "stage", "pipeline stage"],
    "report_url": ["report", "report url", "report_url", "audit url", "audit"],
    "country": ["country", "country name", "location"],
    "language": ["language", "lang", "locale"],
}
# States of a contact, and the variables of an audit that a message may use.
CONTACT_STATUSES = ["active", "bounced", "unsubscribed", "replied"]
AUDIT_KEYS = ["score", "query_count", "cap_count", "top3rate", "outside3rate", "zero_result_rate", "worst_query", "worst_pos", "wrong_product", "worst_example"]


def suggested_field(header: Column) -> Column:
    """The field that a column's header names, or null."""
    low = F.lower(F.trim(header))
    return F.coalesce(*[F.when(low.isin(aliases), field) for field, aliases in HEADER_ALIASES.items()])


def import_contacts(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Checked rows of an import (row, name, email, role, status, company_name): cleaned fields, ``company_id`` and ``error``.

    Blank fields are null. Rows without a name or an email have an error and aren't ``imported``. An
    unknown status is active, a blank one stays null. Companies are found by their trimmed lower-case
    name, of several with one name the last by id; one that isn't found is an error, but the contact comes.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    clean = rows.select("row", *[blank(F.col(c)).alias(c) for c in ("name", "email", "role", "status", "company_name")])
    by_name = companies.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max("id").alias("company_id"))
    found = clean.join(by_name, F.lower("company_name") == F.col("key"), "left").drop("key")
    status = F.when(F.col("status").isNull() | F.col("status").isin(CONTACT_STATUSES), F.col("status")).otherwise("active")
    at = F.concat(F.lit("Row "), F.col("row").cast("string"))
    quoted = F.concat(at, F.lit(' ("'), F.col("name"), F.lit('"): '))
    error = (
        F.when(F.col("name").isNull(), F.concat(at, F.lit(': Missing required field "name". Skipped.')))
        .when(F.col("email").isNull(), F.concat(quoted, F.lit('Missing required field "email". Skipped.')))
        .when(F.col("company_name").isNotNull() & F.col("company_id").isNull(), F.concat(quoted, F.lit('Company "'), F.col("company_name"), F.lit('" not found — contact imported without company link.')))
    )
    return found.withColumns({"status": status, "error": error, "imported": F.col("name").isNotNull() & F.col("email").isNotNull()})


def search_contacts(contacts: DataFrame, search: str | None = None, status: str | None = None, company_id=None, role: str | None = None) -> DataFrame:
    """Contacts whose name or email holds the text, whatever its case, and that have the given values; None sets no condition."""
    out = contacts
    if search:
        q = F.lit(search.lower())
        out = out.where(F.contains(F.lower("name"), q) | F.coalesce(F.contains(F.lower("email"), q), F.lit(False)))
    for column, value in (("status", status), ("company_id", company_id), ("role", role)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def page_with_total(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the rows by an order, with ``total``: how many there are without paging."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # one row


def reminders(items: DataFrame, completed: bool | None = None, due_by: str | None = None) -> DataFrame:
    """Reminders by due date and age; ``completed`` None takes both kinds, and the due date is inclusive."""
    out = items if completed is None else items.where(F.coalesce("is_completed", F.lit(0)) == int(completed))
    return (out if due_by is None else out.where(F.col("due_date") <= due_by)).orderBy("due_date", "created_at")


def in_task_order(tasks: DataFrame, first: int | None = None) -> DataFrame:
    """Tasks by date, hour (nine if none is set) and company; ``place`` numbers the ``first`` ones."""
    hour = F.coalesce("send_hour", F.lit(9))
    ordered = tasks.orderBy("scheduled_date", hour, "company_name", "enrollment_id", "step_order")
    return ordered if first is None else ordered.limit(first).withColumn("place", F.row_number().over(Window.orderBy("scheduled_date", hour, "company_name", "enrollment_id", "step_order")))


def tasks_by_company(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("company_name").agg(F.count("*").alias("tasks"), F.count_if("overdue").alias("overdue"), F.min("scheduled_date").alias("first_due"))


def audit_variables(values: Column) -> Column:
    """Of a map the audit variables with a non-empty text; null if there is none."""
    kept = F.map_filter(values, lambda k, v: k.isin(AUDIT_KEYS) & (F.coalesce(v, F.lit("")) != ""))
    return F.when(F.size(kept) > 0, kept)


def task_variables(values: Column, solution: Column) -> Column:
    """The audit variables of a task: those with a text, two of them by a second name too, and the sentence on the search platform; never null."""
    kept = F.map_filter(F.coalesce(values, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(AUDIT_KEYS) & (F.coalesce(v, F.lit("")) != ""))
    second = F.map_filter(F.create_map(*[x for new, old in {"top_3_rate": "top3rate", "outside_3_rate": "outside3rate"}.items() for x in (F.lit(new), F.try_element_at(kept, F.lit(old)))]), lambda k, v: v.isNotNull())
    return F.map_concat(kept, second, F.create_map(F.lit("search_platform_sentence"), platform_sentence(solution)))


def unsubscribed(contacts: DataFrame, requests: DataFrame) -> DataFrame:
    """Contacts after requests (contact_id, ts) to unsubscribe: the last one counts."""
    last = requests.groupBy(F.col("contact_id").alias("id")).agg(F.max("ts").alias("opt_out_at"))
    hit = F.col("opt_out_at").isNotNull()
    return contacts.join(last, "id", "left").withColumns({"status": F.when(hit, "unsubscribed").otherwise(F.col("status")), "opt_out": F.when(hit, 1).otherwise(F.col("opt_out"))})


def paused(enrollments: DataFrame, requests: DataFrame) -> DataFrame:
    """Enrollments after requests to unsubscribe: active ones of the contact are paused from the first request on."""
    first = requests.groupBy("contact_id").agg(F.min("ts").alias("ts"))
    hit = F.col("ts").isNotNull() & (F.col("status") == "active")
    return enrollments.join(first, "contact_id", "left").withColumns({"paused_at": F.when(hit, F.col("ts")), "status": F.when(hit, "paused").otherwise(F.col("status"))}).drop("ts")


def resumed_enrollments(enrollments: DataFrame) -> DataFrame:
    """Paused enrollments are active again; others stay as they are."""
    return enrollments.withColumns({"status": F.when(F.col("status") == "paused", "active").otherwise(F.col("status")), "paused_at": F.lit(None).cast("timestamp")})


def transitions(messages: DataFrame, actions: DataFrame) -> DataFrame:
    """State of each enrollment after actions (enrollment_id, step_order, action, ts, ord) in order of time.

    ``messages``: enrollment_id, step_order, initial status. ``sent`` moves to the step after it,
    and completes the enrollment if no other message is open by then; ``replied`` and ``bounced`` end
    it and skip what is pending, and a reply sets the stage. The last action that sets a status
    decides; ``contact_status`` and ``contact_at`` tell the last reply or bounce, which the contact
    takes over (see ``contact_statuses``), a reply rather than a bounce of the same time. Windows go over one enrollment's actions.
    """
    open_now = F.col("status").isin("pending", "scheduled")
    base = messages.groupBy("enrollment_id").agg(F.count_if(open_now).alias("open"))
    own = messages.select("enrollment_id", "step_order", open_now.alias("was_open"))
    order = Window.partitionBy("enrollment_id").orderBy("ts", "ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    touched = Window.partitionBy("enrollment_id", "step_order").orderBy("ts", "ord")
    each = actions.join(own, ["enrollment_id", "step_order"]).join(base, "enrollment_id")
    each = each.withColumn("fresh", (F.row_number().over(touched) == 1) & F.col("was_open"))
    each = each.withColumns({"gone": F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "ended": F.coalesce(F.max(F.col("action").isin("replied", "bounced")).over(before), F.lit(False))})
    completes = (F.col("action") == "sent") & (F.col("ended") | (F.col("gone") >= F.col("open")))
    sets = F.when(F.col("action").isin("replied", "bounced"), F.col("action")).when(completes, "completed")
    at = F.struct("ts", "ord")
    last = lambda value, when: F.max_by(value, F.when(when, at))
    out = each.withColumn("sets", sets).groupBy("enrollment_id").agg(
        F.max(F.struct(F.when(F.col("sets").isNotNull(), at).alias("at"), F.col("sets").alias("s"))).alias("last"),
        last(F.col("step_order") + 1, F.col("action") == "sent").alias("current_step"),
        F.max(F.when(F.col("sets").isin("replied", "completed"), F.col("ts"))).alias("completed_at"),
        F.max(F.when(F.col("action") == "replied", "replied")).alias("deal_stage"),
        F.max(F.when(F.col("action").isin("replied", "bounced"), F.struct("ts", "action"))).alias("contact"),
        F.max("open").alias("open"),
        F.count_if("fresh").alias("touched"),
        F.max(F.col("action").isin("replied", "bounced")).alias("ended"),
    )
    return out.select("enrollment_id", F.coalesce("last.s", F.lit("active")).alias("status"), "current_step", "completed_at", "deal_stage", F.when(F.col("ended"), F.col("open") - F.col("touched")).otherwise(0).alias("skipped"), F.col("contact.action").alias("contact_status"), F.col("contact.ts").alias("contact_at"))


def contact_statuses(contacts: DataFrame, enrollments: DataFrame, states: DataFrame) -> DataFrame:
    """``contacts`` (id, status) after the states of their enrollments: the last reply or bounce of any sets status and ``updated_at``.

    ``enrollments``: id, contact_id. ``states``: enrollment_id, contact_status, contact_at, as ``transitions`` and the
    stream of ``streaming.enrollments`` give them. At one time a reply goes before a bounce. Contacts without
    either stay as they are, ``updated_at`` null.
    """
    own = states.where("contact_status is not null").join(enrollments.select(F.col("id").alias("enrollment_id"), "contact_id"), "enrollment_id")
    last = own.groupBy(F.col("contact_id").alias("_c")).agg(F.max(F.struct("contact_at", "contact_status")).alias("_l"))
    both = contacts.join(last, F.col("id") == F.col("_c"), "left")
    return both.withColumns({"status": F.coalesce("_l.contact_status", "status"), "updated_at": F.col("_l.contact_at")}).drop("_c", "_l")


def activity(kinds: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """One timeline of several kinds: contact_id, type, date, description; rows without a date are left out."""
    out = None
    for kind, (rows, date, description) in kinds.items():
        part = rows.select("contact_id", F.lit(kind).alias("type"), date.alias("date"), description.alias("description")).where("date is not null")
        out = part if out is None else out.unionByName(part)
    return out


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("n"))


# What providers' verdicts mean; others are the default, which comes last.
VERDICTS = {
    "directory": ({"valid": "valid", "invalid": "invalid", "disposable": "invalid", "webmail": "invalid", "accept_all": "accept_all"}, "unknown"),
    "network": ({"verified": "valid", "unverified": "unverified", "likely_to_engage": "unknown"}, "unverified"),
}


def verdict(provider: Column, status: Column) -> Column:
    """A provider's own status in common terms; null for providers that aren't known."""
    each = lambda known, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), status), F.lit(other))
    return F.coalesce(*[F.when(provider == name, each(*rule)) for name, rule in VERDICTS.items()])


def provider_tally(results: DataFrame) -> DataFrame:
    """Per provider: attempts by outcome and status, rejected ones, credits, and the share of verified ones with one decimal.

    ``results``: provider, outcome, status, reasons (array), credits.
    """
    one = lambda cond: F.count_if(cond)
    why = lambda word: F.exists("reasons", lambda r: F.contains(r, F.lit(word)))
    out = results.groupBy("provider").agg(
        F.count("*").alias("attempted"), one(F.col("outcome") == "found").alias("found"), *[one(F.col("status") == s).alias(s) for s in ("verified", "risky", "invalid")],
        one(why("PERSONAL_DOMAIN")).alias("personal_rejected"), one(why("ROLE_INBOX")).alias("role_rejected"), one(F.col("outcome") == "error").alias("errors"), F.sum("credits").alias("credits_used"))
    return out.withColumn("usable_rate", F.floor(F.col("verified") * 1000 / F.col("attempted") + 0.5) / 10)
