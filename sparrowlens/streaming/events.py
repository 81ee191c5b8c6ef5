"""Message events as streams: routing, counters and windows. Each takes a stream or a stored table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Provider event types and what they mean; others are ignored.
ROUTES = {"email.bounced": "bounced", "email.complained": "bounced", "email.opened": "opened", "email.clicked": "clicked", "email.link_clicked": "clicked"}


def routed(deliveries: DataFrame, known: DataFrame) -> DataFrame:
    """Deliveries of known messages with their action; unknown messages and types are left out."""
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.col("type"))
    return deliveries.withColumn("action", action).where("action is not null").join(known, "provider_id")


def counters(actions: DataFrame, key: str = "event_id") -> DataFrame:
    """Opens and clicks of each message and when each came first (update mode on a stream)."""
    when = lambda a, v: F.when(F.col("action") == a, v)
    return actions.groupBy(key).agg(F.count(when("opened", 1)).alias("open_count"), F.min(when("opened", F.col("ts"))).alias("opened_at"), F.count(when("clicked", 1)).alias("click_count"), F.min(when("clicked", F.col("ts"))).alias("clicked_at"), F.max(when("bounced", F.lit(True))).alias("bounced"))


def deduplicated(deliveries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """An extension: deliveries that come again within the watermark are dropped; of a stored table all that come again."""
    if not deliveries.isStreaming:
        return deliveries.dropDuplicates(["delivery_id"])
    return deliveries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["delivery_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums in tumbling or sliding windows with a watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """An extension: sessions of a user that end after a gap."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def enrollment_state(events: DataFrame) -> DataFrame:
    """State of each enrollment from all its events: a reply or bounce ends it and skips what is pending."""
    one = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    out = events.groupBy("enrollment_id").agg(one("replied").alias("replied"), one("bounced").alias("bounced"), one("pending").alias("pending"), F.max(F.when(F.col("status").isin("sent", "replied"), F.col("step_order"))).alias("last_step"))
    state = F.when(F.col("replied") > 0, "replied").when(F.col("bounced") > 0, "bounced").when(F.col("pending") == 0, "completed").otherwise("active")
    ended = F.col("state").isin("replied", "bounced")
    return out.withColumn("state", state).select("enrollment_id", "state", F.when(ended, F.col("pending")).otherwise(0).alias("skipped"), F.when(F.col("state") == "active", F.coalesce("last_step", F.lit(0)) + 1).alias("next_step"))
