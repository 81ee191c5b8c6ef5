"""Review of found people: buckets for reviewers, what their decisions approve, confidence of addresses, names that match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Buckets whose approval covers the address, and decisions that approve a name, link or address.
EMAIL_BUCKETS = ["EMAIL_INFERRED_WEAK", "EMAIL_UNRESOLVED_BUT_DOMAIN_KNOWN"]
APPROVES = {
    "APPROVE_CANDIDATE": ["NAME", "LINKEDIN", "EMAIL"],
    "APPROVE_ROLE_ONLY": ["NAME"],
    "APPROVE_ROLE_AND_LINKEDIN": ["NAME", "LINKEDIN"],
    "APPROVE_EMAIL_ONLY": ["EMAIL"],
}
# Workbook columns of a role's fields; those that differ by region by region.
FIELD_COLUMNS = {
    ("CEO", "NAME"): {"US": "CEO / Founder Name", "EU": "CEO / MD Name"},
    ("CEO", "LINKEDIN"): "CEO LinkedIn Profile",
    ("CEO", "EMAIL"): "CEO Email",
    ("HEAD_OF_PRODUCT", "NAME"): "Head of Product (Name)",
    ("HEAD_OF_PRODUCT", "EMAIL"): "Head of Product Email",
    ("HEAD_OF_ECOMMERCE", "NAME"): "Head of Ecommerce (Name)",
    ("HEAD_OF_ECOMMERCE", "EMAIL"): "Head of Ecommerce Email",
    ("HEAD_OF_GROWTH", "NAME"): "Head of Growth / CMO (Name)",
    ("HEAD_OF_GROWTH", "EMAIL"): "Head of Growth / CMO Email",
}
#: The least shared part of the shorter name's words.
OVERLAP = 0.66


def _said(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def manual_approvals(decisions: DataFrame) -> DataFrame:
    """Per decision the fields that it approves and the issues that block it.

    ``decisions``: reviewId, bucket, humanDecision, candidateName, candidateLinkedin,
    candidateEmail. A decision needs what it names: only a whole candidate may lack a link or
    address, and its address counts in address buckets alone. Other decisions approve nothing.
    """
    d = F.col("humanDecision")
    named = {"NAME": "candidateName", "LINKEDIN": "candidateLinkedin", "EMAIL": "candidateEmail"}
    wants = lambda f: d.isin([k for k, v in APPROVES.items() if f in v])
    covered = lambda f: (d != "APPROVE_CANDIDATE") | (F.col("bucket").isin(EMAIL_BUCKETS) if f == "EMAIL" else F.lit(True))
    needed = lambda f: F.lit(True) if f == "NAME" else d != "APPROVE_CANDIDATE"
    kept = lambda a: F.filter(F.array(*a), lambda x: x.isNotNull())
    approved = kept([F.when(wants(f) & _said(c) & covered(f), F.lit(f)) for f, c in named.items()])
    issues = kept([F.when(wants(f) & ~_said(c) & needed(f), F.concat(d, F.lit(f" but no {c}"))) for f, c in named.items()])
    return decisions.select("reviewId", d.alias("decision"), approved.alias("approved"), issues.alias("issues"))


def follow_up_actions(decisions: DataFrame) -> DataFrame:
    """A row for each field that a decision approves: what is written to which column, or that there is none.

    ``decisions``: reviewId, source_file, role, humanDecision, notes, candidateName, candidateLinkedin, candidateEmail, and
    ``approved`` (see ``manual_approvals``). Files whose name starts with EU have European columns,
    others American ones. Fields without a text go; null notes leave no evidence.
    """
    named = {"NAME": "candidateName", "LINKEDIN": "candidateLinkedin", "EMAIL": "candidateEmail"}
    each = decisions.select("*", F.explode("approved").alias("field"))
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(c)) for f, c in named.items()])
    region = F.when(F.startswith(F.coalesce("source_file", F.lit("")), F.lit("EU")), "EU").otherwise("US")
    columns = F.create_map(*[F.lit(x) for (role, field), c in FIELD_COLUMNS.items() for r in ("US", "EU") for x in (f"{role}|{field}|{r}", c[r] if isinstance(c, dict) else c)])
    column = F.try_element_at(columns, F.concat_ws("|", F.coalesce("role", F.lit("")), "field", region))
    there = column.isNotNull()
    notes = F.nullif(F.trim(F.coalesce("notes", F.lit(""))), F.lit(""))
    told = F.filter(F.when(there, F.array(F.concat(F.lit("reviewId: "), F.col("reviewId").cast("string")), F.concat(F.lit("decision: "), F.col("humanDecision")), notes)).otherwise(F.array(F.concat(F.lit("Manually approved: "), F.col("humanDecision")), notes)), lambda x: x.isNotNull())
    reason = F.when(there, F.concat(F.lit("Manually approved via "), F.col("humanDecision"))).otherwise(F.concat_ws(" ", F.lit("No workbook column for"), "role", "field"))
    out = each.withColumn("new_value", value).where(F.trim(F.coalesce("new_value", F.lit(""))) != "")
    return out.select("reviewId", "role", "field", F.coalesce(column, F.concat_ws("_", "role", "field")).alias("column_name"), F.when(there, "WRITE_CELL").otherwise("SKIP_COLUMN_MISSING").alias("action"), "new_value", reason.alias("reason"), F.lit("MANUAL_REVIEW").alias("confidence"), told.alias("evidence"))


def review_items(found: DataFrame) -> DataFrame:
    """The buckets that each row and role falls into, with the priority of each: a row may have several or none.

    ``found``: row_key, role, role_status, full_name, link, role_score, plausibility, email_status,
    email_label, chosen_email, existing_name, domain_emails, written (whether a cell was
    written) and ``held``, the cells that kept their value as structs of old and new value.
    """
    candidate = F.col("full_name").isNotNull()
    resolved = F.col("role_status").isin("RESOLVED_STRONG", "RESOLVED_PROBABLE")
    plausible, weak = F.col("plausibility") == "PLAUSIBLE", F.col("role_status") == "UNRESOLVED_WEAK"
    same = lambda a, b: F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))
    probable = (F.col("role_status") == "RESOLVED_PROBABLE") & plausible & ~F.col("written") & ~(candidate & same(F.col("existing_name"), F.col("full_name")))
    doubtful = weak & candidate & F.col("plausibility").isin("PLAUSIBLE", "SUSPICIOUS")
    email = F.coalesce("email_status", F.lit("UNRESOLVED"))
    strong_first = F.when(F.col("role_status") == "RESOLVED_STRONG", "HIGH").otherwise("MEDIUM")
    rules = [
        ("ROLE_PROBABLE_NOT_WRITTEN", probable, F.lit("HIGH")),
        ("ROLE_WEAK_WITH_CANDIDATE", doubtful, F.when(plausible, "MEDIUM").otherwise("LOW")),
        ("INVALID_PERSON_BUT_HIGH_SIGNAL", (F.col("plausibility") == "IMPLAUSIBLE") & candidate & (F.col("role_score") >= 60), F.lit("LOW")),
        ("EMAIL_INFERRED_WEAK", plausible & (email == "RESOLVED_INFERRED") & (F.col("email_label") == "WEAK") & _said("chosen_email") & resolved, strong_first),
        ("EMAIL_UNRESOLVED_BUT_DOMAIN_KNOWN", plausible & candidate & resolved & (email == "UNRESOLVED") & (F.col("domain_emails") > 0), F.lit("MEDIUM")),
        ("SEARCH_GOOD_LINKEDIN_BUT_ROLE_UNCLEAR", candidate & F.contains("link", F.lit("/in/")) & plausible & (weak | (F.col("role_status") == "RESOLVED_PROBABLE")) & (F.col("role_score") >= 40) & ~F.coalesce(probable | doubtful, F.lit(False)), F.lit("HIGH")),
    ]
    one = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("bucket"), priority.alias("priority"))) for name, cond, priority in rules])
    held = F.transform(F.filter("held", lambda h: ~same(h["old"], h["new"])), lambda h: F.struct(F.lit("EXISTING_CELL_BLOCKED_NEW_VALUE").alias("bucket"), strong_first.alias("priority")))
    every = F.concat(F.filter(one, lambda x: x.isNotNull()), F.when(candidate & F.col("held").isNotNull(), held).otherwise(F.array().cast("array<struct<bucket:string,priority:string>>")))
    asked = found.where(candidate | (F.col("role_status") != "UNRESOLVED_NONE"))
    return asked.select("row_key", "role", F.inline(every))


def review_summary(items: DataFrame) -> DataFrame:
    """Counts of review items by bucket, by priority, by role and in all, in one pass."""
    return items.groupingSets([["bucket"], ["priority"], ["role"], []], "bucket", "priority", "role").agg(F.count("*").alias("n"))


def inferred_confidence(score: Column, role_status: Column, personal: Column, at_domain: Column, pattern: Column, name_words: Column) -> tuple[Column, Column, Column]:
    """(status, score, label) of an address made from a pattern.

    ``personal`` and ``at_domain`` count addresses of the domain that are a person's, and all.
    Without a person's address the label is never STRONG; at 0 or less the address is unresolved.
    """
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    total = (
        score
        + F.when(role_status == "RESOLVED_STRONG", 20).when(role_status == "RESOLVED_PROBABLE", 10).otherwise(0)
        + points(personal >= 2, 15)
        - points((pattern == "UNKNOWN") & (personal == 0), 25)
        - F.when((personal == 0) & (at_domain > 0), 20).when(personal == 0, 15).otherwise(0)
        - points(name_words.isNull() | (name_words > 3), 15)
    )
    label = F.when(total <= 0, F.lit(None)).when((total >= 90) & (personal > 0), "STRONG").when(total >= 70, "PROBABLE").otherwise("WEAK")
    return F.when(total <= 0, "UNRESOLVED").otherwise("RESOLVED_INFERRED"), total, label


def best_entries(people: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Of each domain's people the one of greatest confidence whose position holds a word of the role, ties by ``ord``."""
    roles = F.filter(F.array(*[F.when(F.lower("position").rlike("|".join(words)), F.lit(role)) for role, words in keywords.items()]), lambda r: r.isNotNull())
    each = people.withColumn("role", F.explode(roles))
    best = F.min_by(F.struct("email", "position", "confidence"), F.struct((-F.col("confidence")).alias("c"), F.col("ord").alias("o")))
    return each.groupBy("domain", "role").agg(best.alias("b")).select("domain", "role", "b.*")


def first_with_email(people: DataFrame) -> DataFrame:
    """The first person of each row with an address, else the first."""
    order = F.struct((F.coalesce(F.col("email"), F.lit("")) == "").alias("none"), "ord")
    return people.groupBy("row_key").agg(F.min_by(F.struct("name", "email"), order).alias("b")).select("row_key", "b.*")


def name_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def name_overlap(a: Column, b: Column) -> Column:
    """Shared words of two characters or more over the words of the shorter name."""
    words = lambda c: F.array_distinct(F.split(name_key(c), " "))
    shared = F.size(F.filter(F.array_intersect(words(a), words(b)), lambda w: F.length(w) > 1))
    return shared / F.least(F.size(words(a)), F.size(words(b)))


def name_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (row_key, left_name, right_name) of a row whose names are alike: equal, or sharing two thirds of the words.

    Names meet over a word that they share or over the whole name, so no row's names are all
    compared with one another; each pair is returned once.
    """
    keys = lambda c: F.array_distinct(F.concat(F.filter(F.split(name_key(c), " "), lambda w: F.length(w) > 1), F.array(F.concat(F.lit("="), name_key(c)))))
    side = lambda df, out: df.select("row_key", F.col("full_name").alias(out)).distinct().withColumn("k", F.explode(keys(F.col(out))))
    pairs = side(left, "left_name").join(side(right, "right_name"), ["row_key", "k"]).drop("k").distinct()
    return pairs.where((name_key(F.col("left_name")) == name_key(F.col("right_name"))) | (name_overlap(F.col("left_name"), F.col("right_name")) >= OVERLAP))
