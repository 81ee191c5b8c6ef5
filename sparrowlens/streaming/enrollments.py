"""Enrollments as a stream: the state of each after whatever was sent, answered, bounced or skipped so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contacts import transitions

STATE = "enrollment_id long, status string, current_step int, completed_at timestamp, deal_stage string, skipped long, contact_status string, contact_at timestamp"
NAMES = [field.split()[0] for field in STATE.split(", ")]
#: Keeps state on disk, so that it may be larger than memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def streamed(actions: DataFrame) -> DataFrame:
    """``enrollment_id`` and ``actions``, all so far, of each enrollment that a micro-batch touches (update mode).

    ``actions``, a stream: enrollment_id, step_order, action, ts and ord, a number that an action keeps when it is
    delivered again. Keyed state holds each action once and is as large as the actions are.
    """
    rows = actions.select(F.col("enrollment_id").cast("long").alias("enrollment_id"), F.struct(F.col("ord").cast("long").alias("ord"), F.col("step_order").cast("int").alias("step_order"), "action", F.col("ts").cast("timestamp").alias("ts")).alias("a"))
    return rows.groupBy("enrollment_id").agg(F.collect_set("a").alias("actions"))


def states(messages: DataFrame, touched: DataFrame) -> DataFrame:
    """``STATE`` of each enrollment of ``touched`` (rows of ``streamed``), as it is after everything so far.

    ``messages``: enrollment_id, step_order, initial status, known when the stream starts. Actions count in order of ts
    and ord, also ones that come late; those of unknown messages or enrollments say nothing. The last row of
    an enrollment is what ``operators.contacts.transitions`` gives for all actions together.
    """
    found = transitions(messages, touched.select("enrollment_id", F.inline("actions")))
    kinds = [field.split() for field in STATE.split(", ")]
    return found.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds])


def run(spark: SparkSession, messages: DataFrame, actions_path: str, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Stream the Parquet files of ``actions_path``, ``files`` to a micro-batch, and return the last state of each enrollment.

    Changes and the query's checkpoint are written below ``folder``. Started again with the same folder it goes
    on where it ended; a micro-batch that is done again replaces what it wrote.
    """
    own = spark.newSession()
    own.conf.set(*STORE)
    source = own.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(actions_path)
    held = own.read.parquet(messages) if isinstance(messages, str) else messages

    def keep(batch: DataFrame, number: int) -> None:
        states(held, batch).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    query = streamed(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.schema(STATE + ", batch long").parquet(f"{folder}/changes")
    last = changes.groupBy("enrollment_id").agg(F.max_by(F.struct(*NAMES[1:]), "batch").alias("s"))
    return last.select("enrollment_id", *[F.col(f"s.{n}").alias(n) for n in NAMES[1:]])
