"""Lead enrichment: task plans, address votes, waterfalls, profiles of filled columns and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import email as mail
from .review import name_overlap

# Roles with their base score, and category words that raise a task.
ROLE_SCORES = {"CEO": 25, "HEAD_OF_ECOMMERCE": 20, "HEAD_OF_PRODUCT": 12, "HEAD_OF_GROWTH": 8}
BOOSTED_CATEGORIES = ["fashion", "electronics", "home", "beauty", "marketplace"]


def _filled(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def role_tasks(rows: DataFrame) -> DataFrame:
    """A task per row and role: status, missing fields and priority.

    ``rows``: row_key, company_name, website_url, country, category and ``roles``, a map from role
    to a struct of name, link and email; only the first role keeps a link.
    """
    each = rows.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ROLE_SCORES])))
    own = F.element_at("roles", F.col("role"))
    ceo = F.col("role") == "CEO"
    gap = lambda field, cond=None: F.when(~_filled(own[field]) & (cond if cond is not None else F.lit(True)), F.lit(field.upper()))
    missing = F.filter(F.array(gap("name"), gap("link", ceo), gap("email")), lambda m: m.isNotNull())
    status = F.when(~_filled(F.col("company_name")), "SKIP_NO_COMPANY_NAME").when(~_filled(F.col("website_url")), "SKIP_NO_WEBSITE").when(F.size(missing) == 0, "SKIP_COMPLETE").otherwise("READY")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_SCORES.items() for x in kv]), F.col("role"))
    lacks = lambda m: F.array_contains("missing", m)
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    boost = F.coalesce(F.lower("category").rlike("|".join(BOOSTED_CATEGORIES)), F.lit(False))
    score = 70 + base + points(lacks("NAME"), 15) + points(lacks("LINK"), 10) + points(lacks("EMAIL"), 15) + points(_filled(own["name"]) & lacks("EMAIL"), 8) + points(ceo & _filled(own["link"]) & lacks("EMAIL"), 8) + points(_filled(F.col("country")), 5) + points(boost, 4)
    out = each.withColumn("status", status).withColumn("missing", F.when(F.col("status") == "READY", missing).otherwise(F.array().cast("array<string>")))
    return out.withColumn("priority", F.when(F.col("status") == "READY", score).otherwise(0)).select("row_key", "role", "status", "missing", "priority")


def task_summary(tasks: DataFrame) -> DataFrame:
    """Counts by role, by status and in all, in one pass over grouping sets."""
    return tasks.groupingSets([["role"], ["status"], []], "role", "status").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "READY", 1).otherwise(0)).alias("ready"))


def fill_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have a value in each column, and the share in whole percent, in one pass."""
    one = rows.agg(F.count("*").alias("_n"), *[F.sum(F.when(_filled(F.col(c).cast("string")), 1).otherwise(0)).alias(c) for c in columns])
    long = one.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])))
    return long.select("column", "filled", F.coalesce(F.floor(F.try_divide(F.col("filled") * 100.0, F.col("_n")) + 0.5), F.lit(0)).cast("long").alias("percent"))


def pattern_votes(emails: DataFrame, names: DataFrame) -> DataFrame:
    """The address pattern of each domain with its votes: addresses against the known names of the domain.

    Domains without a match by name take the patterns that their addresses' forms suggest. Most
    votes win, ties go to the pattern of the least address. Equal addresses and names are counted before they
    meet, and they meet by what a name's addresses are or end with, not all with all of a domain.
    """
    local, domain = mail.parts(F.col("email"))
    sound = emails.where(mail.gate(F.col("email")).isNull()).select(F.lower("email").alias("email"), local.alias("local"), domain.alias("domain"))
    sound = sound.groupBy("domain", "local").agg(F.count("*").alias("n"), F.min("email").alias("email"))
    first, last = mail.name_parts(F.col("name"))
    people = names.groupBy("domain", first.alias("first"), last.alias("last")).agg(F.count("*").alias("m")).where("first is not null")
    theirs, own = people.withColumn("key", F.explode(mail.name_keys(F.col("first"), F.col("last")))), sound.withColumn("key", F.explode(mail.local_keys(F.col("local"))))
    met = own.join(theirs, ["domain", "key"]).withColumn("pattern", mail.pattern_of(F.col("local"), F.col("first"), F.col("last")))
    whole = F.col("local").isin(*[mail.build(F.col("first"), F.col("last"), p) for p in mail.PATTERNS])  # such a pair meets by an ending too
    named = met.where((F.col("pattern") != "UNKNOWN") & (whole == F.startswith("key", F.lit("=")))).select("domain", "email", "pattern", (F.col("n") * F.col("m")).alias("n"))
    shaped = sound.join(named.select("domain").distinct(), "domain", "left_anti").select("domain", "email", mail.guess_structure(F.col("local")).alias("pattern"), "n").where("pattern <> 'UNKNOWN'")
    votes = named.withColumn("by_name", F.lit(True)).unionByName(shaped.withColumn("by_name", F.lit(False))).groupBy("domain", "pattern").agg(F.sum("n").alias("votes"), F.min("email").alias("first"), F.max("by_name").alias("by_name"))
    best = votes.groupBy("domain").agg(F.min(F.struct((-F.col("votes")).alias("v"), "first", "pattern", "by_name")).alias("b"))
    seen = sound.groupBy("domain").agg(F.sum("n").alias("addresses"))
    confidence = 50 + F.when(F.col("b.v") <= -2, 25).otherwise(0) + F.when(F.col("addresses") >= 2, 10).otherwise(0) + F.when(F.col("b.by_name"), 15).otherwise(0)
    return seen.join(best, "domain", "left").select("domain", F.coalesce("b.pattern", F.lit("UNKNOWN")).alias("pattern"), F.coalesce(-F.col("b.v"), F.lit(0)).alias("votes"), F.when(F.col("b").isNull(), 30).otherwise(confidence).alias("confidence"))


def waterfall(attempts: DataFrame, accepted: list[str] = ["verified"]) -> DataFrame:  # noqa: B006
    """Of each contact's attempts the first accepted one, else the best by status, the earliest first."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"verified": 4, "risky": 3, "guessed": 2, "invalid": 1}.items() for x in kv]), F.col("status"))
    found = attempts.where("outcome = 'found' and email is not null").withColumn("ok", F.col("status").isin(accepted))
    order = F.struct((~F.col("ok")).alias("a"), F.when(F.col("ok"), 0).otherwise(-F.coalesce(rank, F.lit(0))).alias("b"), F.col("ord").alias("c"))
    return found.groupBy("contact_id").agg(F.min_by(F.struct("provider", "email", "status"), order).alias("w")).select("contact_id", "w.*")


def enriched_emails(contacts: DataFrame, attempts: DataFrame, accepted: list[str] = ["verified"], reverify: bool = False, allow_role: bool = False) -> DataFrame:  # noqa: B006
    """The address of each contact: the one it has if that can be kept, else the best of the providers' attempts.

    ``contacts``: contact_id, company_domain, company_website, existing_email, existing_status. ``attempts`` as in
    ``waterfall``. An existing address that passes the gate is kept if it is verified, and also
    otherwise (status as known, else risky) unless ``reverify`` asks providers for it; contacts without
    a domain are left alone. Gives contact_id, ``email``, ``status``, ``source`` (existing_crm, provider, none) and ``provider``.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    domain = F.when(text("company_domain") != "", text("company_domain")).otherwise(F.when(text("company_website") != "", mail.domain_of(F.col("company_website"))).otherwise(""))
    sound = (text("existing_email") != "") & mail.gate(F.col("existing_email"), allow_role).isNull()
    kept = sound & ((F.coalesce("existing_status", F.lit("")) == "verified") | F.lit(not reverify))
    own = contacts.withColumns({"_d": domain, "_kept": kept}).join(waterfall(attempts, accepted).select(F.col("contact_id").alias("_c"), "provider", F.col("email").alias("_e"), F.col("status").alias("_s")), F.col("contact_id") == F.col("_c"), "left")
    source = F.when(F.col("_d") == "", "none").when(F.col("_kept"), "existing_crm").when(F.col("_e").isNotNull(), "provider").otherwise("none")
    own = own.withColumn("source", source)
    of = lambda crm, other: F.when(F.col("source") == "existing_crm", crm).when(F.col("source") == "provider", other)
    return own.select("contact_id", of(text("existing_email"), F.col("_e")).alias("email"), of(F.coalesce("existing_status", F.lit("risky")), F.col("_s")).alias("status"), "source", of(F.lit(None), F.col("provider")).alias("provider"))


def review_queue(items: DataFrame) -> DataFrame:
    """Items once per row, role and bucket, by priority, bucket and score."""
    keep = F.row_number().over(Window.partitionBy("row_key", "role", "bucket").orderBy("ord"))
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {"HIGH": 0, "MEDIUM": 1, "LOW": 2}.items() for x in kv]), F.col("priority")), F.lit(3))
    return items.withColumn("n", keep).where("n = 1").drop("n").orderBy(place, "bucket", F.desc("score"), "row_key", "role")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words of two characters or more of two names over the words of the shorter one; 0 if a name is null."""
    return F.coalesce(name_overlap(a, b), F.lit(0.0))


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet: resuming reads the checkpoint table and leaves it out."""
    return wanted.join(done, keys, "left_anti")


def balanced(categories: DataFrame, n: int) -> DataFrame:
    """n dealt over categories (category, place) in order: the first ones get one more if it doesn't divide.

    The categories are a short list, which meets in one row.
    """
    listed = categories.agg(F.array_sort(F.collect_list(F.struct("place", "category"))).alias("c"))
    each = listed.select(F.size("c").alias("total"), F.posexplode("c").alias("at", "x"))
    return each.select("x.category", (F.floor(F.lit(n) / F.col("total")) + F.when(F.col("at") < F.lit(n) % F.col("total"), 1).otherwise(0)).cast("int").alias("target"))


def quota(existing: DataFrame, incoming: DataFrame, targets: DataFrame) -> DataFrame:
    """Of new queries the first of each category, as far as existing ones leave room."""
    have = existing.groupBy("category").agg(F.count("*").alias("have"))
    fresh = incoming.join(existing.select(F.lower("query").alias("q")).distinct(), F.lower(incoming["query"]) == F.col("q"), "left_anti")
    place = F.row_number().over(Window.partitionBy("category").orderBy("ord"))
    return fresh.withColumn("n", place).join(targets, "category").join(have, "category", "left").where(F.col("n") <= F.col("target") - F.coalesce("have", F.lit(0))).select("category", "query")
