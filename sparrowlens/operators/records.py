"""Rows of the outreach tables as they are taken in: what each field must be, defaults, and a reason for each row that is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+\-]@([A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}$"
COMPANY_STATUSES = ["prospect", "contacted", "in-sequence", "replied", "meeting-booked", "won", "lost", "not-interested"]
CONTACT_STATUSES = ["active", "bounced", "unsubscribed", "replied"]

#: By table and field: ``text`` (message if it lacks one), ``email`` (message; ``None``: it may be null), ``among`` (the
#: values), ``whole`` (least and most, None for no bound); ``default`` where a field isn't given. Fields that aren't named may be anything.
RULES: dict[str, dict[str, dict]] = {
    "company": {"name": {"text": "Company name is required"}, "status": {"among": COMPANY_STATUSES, "default": "prospect"}},
    "contact": {"company_id": {"text": "Company is required"}, "name": {"text": "Contact name is required"}, "email": {"email": "Valid email is required"}, "status": {"among": CONTACT_STATUSES, "default": "active"}},
    "sequence": {"name": {"text": "Sequence name is required"}, "is_active": {"whole": (0, 1), "default": "1"}, "from_email": {"email": None}},
    "step": {"step_order": {"whole": (1, None), "required": True}, "delay_days": {"whole": (0, None), "default": "0"}},
    "enrollment": {"sequence_id": {"text": "Sequence is required"}, "contact_id": {"text": "Contact is required"}, "send_hour": {"whole": (0, 23)}},
    "reminder": {"title": {"text": "Title is required"}, "due_date": {"text": "Due date is required"}, "is_completed": {"whole": (0, 1)}},
    "tag": {"name": {"text": "Tag name is required"}},
}


def _fault(value: Column, name: str, rule: dict, partial: bool) -> Column:
    """Why a value is refused, or null. With ``partial`` a field that isn't given is fine."""
    given = value.isNotNull()
    if "text" in rule:
        return F.when((value == "") | (F.lit(not partial) & ~given), rule["text"])
    if "email" in rule:
        return F.when(given & ~value.rlike(EMAIL) | F.lit(not partial and rule["email"] is not None) & ~given, rule["email"] or f"{name} is no address")
    if "among" in rule:
        return F.when(given & ~value.isin(rule["among"]), f"{name} is none of {', '.join(rule['among'])}")
    least, most = rule["whole"]
    number = value.try_cast("bigint")
    sound = value.rlike(r"^-?\d+$") & number.isNotNull() & (number >= least) & (F.lit(True) if most is None else number <= most)
    return F.when(given & ~F.coalesce(sound, F.lit(False)), f"{name} is no whole number from {least}" + ("" if most is None else f" to {most}")).when(F.lit(bool(rule.get("required")) and not partial) & ~given, f"{name} is required")


def validated(rows: DataFrame, table: str, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows with defaults, bad rows with ``errors``) of a table of texts; fields that ``rows`` lacks count as not given.

    With ``partial`` (an update) nothing is required and there are no defaults. Good rows have whole
    numbers as longs; columns without a rule come through.
    """
    rules = RULES[table]
    missing = [f for f in rules if f not in rows.columns]
    full = rows.withColumns({f: F.lit(None).cast("string") for f in missing}) if missing and not partial else rows
    own = {f: r for f, r in rules.items() if f in full.columns}
    faults = F.filter(F.array(*[_fault(F.col(f).cast("string"), f, r, partial) for f, r in own.items()]), lambda e: e.isNotNull())
    checked = full.withColumn("errors", faults)
    value = lambda f, r: F.coalesce(F.col(f), F.lit(r["default"])) if "default" in r and not partial else F.col(f)
    typed = {f: value(f, r).try_cast("bigint") if "whole" in r else value(f, r) for f, r in own.items()}
    return checked.where(F.size("errors") == 0).drop("errors").withColumns(typed), checked.where(F.size("errors") > 0)


def role_decisions(tasks: DataFrame, scored: DataFrame) -> DataFrame:
    """For each task (row_key, role) who is chosen: ``name``, ``link``, ``score``, ``status`` and ``alternates``, the next three names.

    ``scored`` are clusters with name, link, score and status, as ``scoring.cluster_scores`` gives the
    last two. The best score wins, ties by name. Nobody is chosen at a score of 0 or less; the first
    three are alternates then. Tasks without clusters are UNRESOLVED_NONE.
    """
    person = F.struct((-F.col("score")).alias("order"), F.coalesce("name", F.lit("")).alias("name"), "link", "score", "status")
    best = scored.groupBy(F.col("row_key").alias("_k"), F.col("role").alias("_r")).agg(F.array_sort(F.collect_list(person)).alias("c"))
    own = tasks.join(best, (F.col("row_key") == F.col("_k")) & (F.col("role") == F.col("_r")), "left")
    top = F.get("c", 0)
    chosen = F.coalesce(top["status"] != "UNRESOLVED_NONE", F.lit(False))
    names = F.transform(F.slice(F.coalesce("c", F.slice(F.array(F.lit(None).cast(dict(best.dtypes)["c"][6:-1])), 1, 0)), F.when(chosen, 2).otherwise(1), F.lit(3)), lambda x: x["name"])
    pick = lambda f: F.when(chosen, top[f])
    return own.select("row_key", "role", pick("name").alias("name"), pick("link").alias("link"), F.when(chosen, top["score"]).alias("score"), F.coalesce(top["status"], F.lit("UNRESOLVED_NONE")).alias("status"), names.alias("alternates"))
