"""Aggregates of simulated search sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even


def outcomes(steps: DataFrame, tolerance: int = 3) -> DataFrame:
    """Each session's outcome: FOUND before misses reach the tolerance converts.

    One aggregation by session: the first step that found something and the step of the miss that
    used up the tolerance are compared, so order needs no fold.
    """
    found = F.min(F.when(F.col("state") == "FOUND", F.col("step")))
    misses = F.sort_array(F.collect_list(F.when(F.col("state") != "FOUND", F.col("step"))))  # steps of one session
    out = steps.groupBy("session_id", "persona_key", "basket_value").agg(found.alias("found"), misses.alias("misses"), F.count("*").alias("queries"), F.max(F.when(F.col("state") == "PARTIAL", 1).otherwise(0)).alias("partial"))
    limit = F.get("misses", F.lit(tolerance - 1))
    converted = F.col("found").isNotNull() & (limit.isNull() | (F.col("found") < limit))
    used = F.least(F.lit(tolerance), F.size(F.filter("misses", lambda m: F.col("found").isNull() | (m < F.col("found")))))
    return out.select("session_id", "persona_key", "basket_value", F.when(converted, "CONVERTED").when(F.col("partial") == 1, "SPLIT_BASKET").otherwise("ABANDONED").alias("outcome"), used.alias("reformulations"), "queries")


def persona_aggregate(sessions: DataFrame) -> DataFrame:
    """Outcomes, rates and lost baskets for each persona and for all (null persona)."""
    one = lambda *o: F.sum(F.when(F.col("outcome").isin(*o), 1).otherwise(0))
    n = F.count("*")
    lost = F.sum(F.when(F.col("outcome") != "CONVERTED", F.col("basket_value")).otherwise(0))
    return sessions.groupingSets([["persona_key"], []], "persona_key").agg(
        n.alias("sessions"), one("CONVERTED").alias("converted"), one("SPLIT_BASKET").alias("split_basket"), one("ABANDONED").alias("abandoned"),
        half_even(one("CONVERTED") / n, 2).alias("conversion_rate"), half_even(F.avg("reformulations"), 1).alias("avg_reformulations"), lost.alias("revenue_lost"))


def state_distribution(steps: DataFrame) -> DataFrame:
    return steps.groupBy("persona_key").pivot("state", ["FOUND", "PARTIAL", "NOTHING"]).count().na.fill(0)


def entry_friction(steps: DataFrame) -> DataFrame:
    """The share of sessions whose first query didn't find what was meant."""
    first = steps.groupBy("session_id", "persona_key").agg(F.min_by("state", "step").alias("state"))
    return first.groupBy("persona_key").agg(half_even(F.avg(F.when(F.col("state") != "FOUND", 1.0).otherwise(0.0)), 2).alias("entry_friction"))


def category_failure(steps: DataFrame) -> DataFrame:
    return steps.groupBy(F.coalesce("category", F.lit("UNKNOWN")).alias("category")).agg(half_even(F.avg(F.when(F.col("state").isin("PARTIAL", "NOTHING"), 1.0).otherwise(0.0)), 2).alias("failure_rate"), F.count("*").alias("total")).orderBy(F.desc("failure_rate"), "category")
