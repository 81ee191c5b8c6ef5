"""Outreach analytics over linked entities: filters, funnels, dashboards, timelines and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_up, percent
from ..functions.text import normal_key, website_key


def readiness(contacts: DataFrame) -> DataFrame:
    """``code`` and ``ready``: the first rule that applies decides."""
    code = (
        F.when(F.trim(F.coalesce("email", F.lit(""))) == "", "NO_EMAIL")
        .when(F.col("status") == "unsubscribed", "UNSUBSCRIBED")
        .when(F.col("status") == "bounced", "BOUNCED")
        .when(F.col("opt_out") == 1, "OPTED_OUT")
        .when(F.col("email_status") != "verified", "EMAIL_NOT_VERIFIED")
        .when(F.col("email_status").isNull(), "OK_LEGACY_UNVERIFIED")
        .otherwise("OK")
    )
    return contacts.withColumn("code", code).withColumn("ready", F.startswith(F.col("code"), F.lit("OK")))


def contacts_count(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Companies with how many contacts they have, counted before the join."""
    n = contacts.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    return companies.join(n, "id", "left").withColumn("contacts_count", F.coalesce("n", F.lit(0))).drop("n")


def companies_page(companies: DataFrame, search: str | None = None, status: str | None = None, platform: str | None = None, has_report: bool | None = None, sort: str = "updated_at", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of companies; those that aren't interested come last in either direction, ties by id."""
    out = companies
    if search:
        q = F.lit(search.lower())
        out = out.where(F.contains(F.lower("name"), q) | F.coalesce(F.contains(F.lower("website"), q), F.lit(False)))
    if status:
        out = out.where(F.col("status") == status)
    if platform:
        out = out.where(F.col("platform") == platform)
    if has_report is not None:
        out = out.where(F.coalesce("has_report", F.lit(False)) == has_report)
    key = F.col(sort)
    return out.orderBy(F.coalesce(F.col("status") == "not-interested", F.lit(False)), key.desc() if descending else key.asc(), "id").offset(offset).limit(limit)


def with_report_flag(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """``has_report``: an own url, or a registry key equal to the name's or the website's."""
    keys = registry.where(F.coalesce("url", F.lit("")) != "").select(normal_key(F.col("name")).alias("k")).distinct()
    by_name = companies.join(keys, normal_key(companies.name) == keys.k, "left").withColumnRenamed("k", "by_name")
    both = by_name.join(keys, website_key(by_name.website) == keys.k, "left")
    return both.withColumn("has_report", F.col("report_url").isNotNull() | F.col("by_name").isNotNull() | F.col("k").isNotNull()).drop("by_name", "k")


def with_any_tag(companies: DataFrame, bridge: DataFrame, tag_id) -> DataFrame:
    return companies.join(bridge.where(F.col("tag_id") == tag_id), companies.id == bridge.company_id, "left_semi")


def merged_reports(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """Reports of companies and of the registry by key; where both know one, the company's counts."""
    own = companies.where("report_url is not null").select(normal_key(F.col("name")).alias("key"), F.col("name").alias("own_name"), F.col("report_url").alias("own_url"))
    other = registry.where(F.coalesce("url", F.lit("")) != "").select(normal_key(F.col("name")).alias("key"), F.col("name").alias("other_name"), "url")
    return own.join(other, "key", "full_outer").select("key", F.coalesce("own_name", "other_name").alias("name"), F.coalesce("own_url", "url").alias("url"), F.when(F.col("own_url").isNotNull(), "company").otherwise("registry").alias("origin"))


def dashboard(companies: DataFrame, contacts: DataFrame, events: DataFrame, enrollments: DataFrame, today: str) -> DataFrame:
    """One row of totals; each source is aggregated once to one row."""
    sent = F.col("status").isin("sent", "replied")
    month = F.lit(today[:8] + "01")
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    of_companies = companies.agg(F.count("*").alias("total_companies"), one(F.col("status") == "meeting-booked").alias("meetings_booked"))
    of_contacts = contacts.agg(F.count("*").alias("total_contacts"))
    active = enrollments.where("status = 'active'").select(F.col("id").alias("enrollment_id"))
    due = events.where((F.col("status") == "pending") & (F.col("scheduled_date") <= today)).join(active, "enrollment_id", "left_semi").agg(F.count("*").alias("tasks_due_today"))
    of_events = events.agg(one(sent).alias("emails_sent"), one(sent & (F.col("sent_at") >= month)).alias("emails_sent_this_month"), one(F.col("status") == "replied").alias("replies"))
    row = of_companies.join(of_contacts).join(of_events).join(due)  # one row each
    return row.withColumn("response_rate", half_up(percent(F.col("replies"), F.col("emails_sent")))).drop("replies")


def counts_by(rows: DataFrame, key: Column, name: str, limit: int | None = None) -> DataFrame:
    out = rows.groupBy(key.alias(name)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), name)
    return out.limit(limit) if limit else out


def platform_name(platform: Column) -> Column:
    return F.coalesce(F.nullif(platform, F.lit("")), F.lit("Unknown"))


def recent_activity(events: DataFrame, enrollments: DataFrame, contacts: DataFrame, companies: DataFrame, k: int = 10) -> DataFrame:
    """The k latest sent or answered messages with contact and company."""
    date = F.coalesce("replied_at", "sent_at")
    last = events.where(F.col("status").isin("sent", "replied") & date.isNotNull()).withColumn("date", date)
    joined = (
        last.join(enrollments.select(F.col("id").alias("enrollment_id"), "contact_id"), "enrollment_id", "left")
        .join(contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("contact"), "company_id"), "contact_id", "left")
        .join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left")
    )
    text = F.format_string("%s (%s) - Step %d", F.coalesce("contact", F.lit("Unknown")), F.coalesce("company", F.lit("")), F.col("step_order"))
    return joined.select(F.when(F.col("status") == "replied", "reply").otherwise("sent").alias("type"), text.alias("description"), "date").orderBy(F.desc("date"), "description", "type").limit(k)


def step_funnel(events: DataFrame) -> DataFrame:
    """Sent, opened, clicked and answered messages of each step with whole-number rates of those sent."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    out = events.groupBy("step_order").agg(one(F.col("status").isin("sent", "replied")).alias("sent"), one(F.col("open_count") > 0).alias("opened"), one(F.col("click_count") > 0).alias("clicked"), one(F.col("status") == "replied").alias("replied"))
    rate = lambda c: half_up(percent(F.col(c), F.col("sent")))
    return out.withColumns({"open_rate": rate("opened"), "click_rate": rate("clicked"), "reply_rate": rate("replied")})


def variant_stats(enrollments: DataFrame, events: DataFrame) -> DataFrame:
    """Per experiment and variant: enrolled, sent and answered; events are counted before they are joined."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    per = events.groupBy("enrollment_id").agg(one(F.col("status").isin("sent", "replied")).alias("s"), one(F.col("status") == "replied").alias("r"))
    joined = enrollments.join(per, enrollments.id == per.enrollment_id, "left")
    return joined.groupBy("experiment_id", "ab_variant").agg(F.count("*").alias("enrolled"), F.coalesce(F.sum("s"), F.lit(0)).alias("sent"), F.coalesce(F.sum("r"), F.lit(0)).alias("replied"))


def pipeline_board(enrollments: DataFrame, stages: list[str]) -> DataFrame:
    """Enrollments of each stage in the fixed order, also of stages that have none."""
    spark = enrollments.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(stages)], "deal_stage string, place int")
    n = enrollments.groupBy("deal_stage").agg(F.count("*").alias("n"))
    return dim.join(n, "deal_stage", "left").select("deal_stage", "place", F.coalesce("n", F.lit(0)).alias("count")).orderBy("place")


def timeline(events: DataFrame) -> DataFrame:
    """What happened in each enrollment, a row per kind and date; one scan, unpivoted."""
    each = F.array(
        F.struct(F.lit("email_sent").alias("type"), F.col("sent_at").alias("date")),
        F.struct(F.lit("email_replied").alias("type"), F.col("replied_at").alias("date")),
        F.struct(F.lit("email_bounced").alias("type"), F.when(F.col("status") == "bounced", F.col("sent_at")).alias("date")),
    )
    return events.select("enrollment_id", "step_order", F.inline(each)).where("date is not null")


def schedule(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """The date of each step: the start plus the delays up to it."""
    total = F.sum("delay_days").over(Window.partitionBy("sequence_id").orderBy("step_order").rowsBetween(Window.unboundedPreceding, 0))
    return starts.join(steps.withColumn("after", total.cast("int")), "sequence_id").select("id", "step_order", F.date_format(F.date_add(F.to_date("started_at"), F.col("after")), "yyyy-MM-dd").alias("scheduled_date"))


def resumed(paused: DataFrame, now: Column) -> DataFrame:
    """Dates moved by the days of the pause, begun days counting whole."""
    days = F.ceil((F.unix_micros(now) - F.unix_micros("paused_at")) / F.lit(86_400_000_000)).cast("int")
    return paused.withColumn("pause_days", days).withColumn("new_date", F.date_format(F.date_add(F.to_date("scheduled_date"), F.col("pause_days")), "yyyy-MM-dd"))


def due_tasks(events: DataFrame, enrollments: DataFrame, contacts: DataFrame, today: str) -> DataFrame:
    """Pending messages of active enrollments that are due and whose contact may be written to."""
    ready = readiness(contacts).where("ready").select(F.col("id").alias("contact_id"))
    active = enrollments.where("status = 'active'").select(F.col("id").alias("enrollment_id"), "contact_id")
    due = events.where((F.col("status") == "pending") & (F.col("scheduled_date") <= today))
    return due.join(active, "enrollment_id").join(ready, "contact_id", "left_semi").select("enrollment_id", "contact_id", "step_order", "scheduled_date", (F.col("scheduled_date") < today).alias("overdue"))


def split_variants(rows: DataFrame, seed: int) -> DataFrame:
    """A and B by the MD5 of id and seed; the halves differ by chance, as each row decides for itself."""
    hashed = F.conv(F.left(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))), F.lit(8)), 16, 10).cast("long")
    return rows.withColumn("variant", F.when(hashed % 2 == 0, "A").otherwise("B"))


def child_lists(rows: DataFrame, parent: str, order: list[Column], parents: DataFrame | None = None) -> DataFrame:
    """Rows by their parent with their ``place`` (from 1) in its list: comments of a contact, enrollments of a sequence, steps of a sequence.

    ``order`` says what comes first; it should end with a unique column. With ``parents`` (a table that has the
    column ``parent``) only their lists. Rows without a parent are in no list.
    """
    own = rows.where(F.col(parent).isNotNull())
    if parents is not None:
        own = own.join(parents.select(F.col(parent).alias("_p")).distinct(), F.col(parent) == F.col("_p"), "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def looked_up(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """For each row of ``ids`` (column ``key``) the row of that key, nulls if there is none; of several the first by all columns."""
    others = [c for c in rows.columns if c != key]
    once = rows.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*others)).alias("_r"))
    return ids.join(once, F.col(key) == F.col("_k"), "left").select(*[c for c in ids.columns], *[F.col(f"_r.{c}").alias(c) for c in others if c not in ids.columns])


def sequences_with_steps(sequences: DataFrame, steps: DataFrame) -> DataFrame:
    """Sequences with their ``steps`` as a list in order, the oldest sequence first; those without steps have an empty list.

    ``sequences``: id, name, created_at. ``steps``: sequence_id, step_order, subject.
    """
    own = steps.groupBy(F.col("sequence_id").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("step_order", "subject"))).alias("steps"))
    none = F.array().cast("array<struct<step_order:int,subject:string>>")
    kind = dict(steps.dtypes)["step_order"]
    none = none.cast(f"array<struct<step_order:{kind},subject:string>>")
    return sequences.join(own, F.col("id") == F.col("_s"), "left").select("id", "name", "created_at", F.coalesce("steps", none).alias("steps")).orderBy("created_at", "id")
