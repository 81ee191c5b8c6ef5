"""States of enrollments as a stream: late and repeated actions, unknown messages, a second start."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparrowlens.operators import contacts
from sparrowlens.streaming import enrollments

SCHEMA = "enrollment_id long, step_order int, action string, ts timestamp, ord long"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    messages, actions = [], []
    for e in range(60):
        n = rng.randrange(0, 6)
        messages += [(e, s, rng.choice(["pending", "scheduled", "sent", "skipped"])) for s in range(1, n + 1)]
        for _ in range(rng.randrange(0, 7)):  # some on steps that don't exist, some at one time
            actions.append((e, rng.randrange(1, 8), rng.choice(["sent", "sent", "replied", "bounced", "skipped"]), datetime(2024, 1, 1) + timedelta(days=rng.randrange(0, 9)), len(actions)))
    actions += [(999, 1, "sent", datetime(2024, 1, 1), 10_000)]  # of an enrollment that isn't known
    known = spark.createDataFrame(messages, "enrollment_id long, step_order int, status string")
    known.write.parquet(f"{tmp_path}/messages")
    rng.shuffle(actions)
    cuts = [actions[:80], actions[80:], actions[20:120]]  # the third delivers again

    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/actions")

    for rows in cuts:
        write(rows)
    run = lambda: {tuple(r) for r in enrollments.run(spark, f"{tmp_path}/messages", f"{tmp_path}/actions", f"{tmp_path}/stream", SCHEMA).select(*names).collect()}
    every = spark.createDataFrame(actions, SCHEMA)
    batch = contacts.transitions(known, every)
    names = batch.columns
    want = {tuple(r) for r in batch.collect()}
    assert run() == want and len(want) > 30 and {w[1] for w in want} == {"active", "completed", "replied", "bounced"}
    assert spark.read.parquet(f"{tmp_path}/stream/changes").select("batch").distinct().count() == 3
    assert run() == want  # nothing new: nothing changes
    late = [(e, 1, "replied", datetime(2023, 12, 31), 20_000 + e) for e in range(0, 60, 3)]  # before everything else
    write(late)
    want = {tuple(r) for r in contacts.transitions(known, every.unionAll(spark.createDataFrame(late, SCHEMA))).collect()}
    assert run() == want


def test_contacts_take_over_the_last_answer(spark):
    people = spark.createDataFrame([(1, "active"), (2, "active"), (3, "unsubscribed")], "id long, status string")
    own = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "id long, contact_id long")
    day = lambda n: datetime(2024, 1, n)
    states = spark.createDataFrame([(10, "bounced", day(3)), (11, "replied", day(2)), (12, None, None), (13, "replied", day(1)), (99, "replied", day(1))], "enrollment_id long, contact_status string, contact_at timestamp")
    got = contacts.contact_statuses(people, own, states).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "bounced", day(3)), (2, "active", None), (3, "unsubscribed", None)]
    assert contacts.contact_statuses(people.where(F.lit(False)), own, states).collect() == []


def test_a_reply_goes_before_a_bounce_of_the_same_time(spark, tmp_path):
    at = datetime(2024, 1, 1)
    known = spark.createDataFrame([(1, 1, "pending"), (1, 2, "pending"), (2, 1, "pending"), (2, 2, "pending")], "enrollment_id long, step_order int, status string")
    actions = spark.createDataFrame([(1, 1, "replied", at, 1), (1, 2, "bounced", at, 2), (2, 1, "bounced", at, 1), (2, 2, "replied", at, 2)], SCHEMA)
    actions.write.parquet(f"{tmp_path}/actions")
    for states in (contacts.transitions(known, actions), enrollments.run(spark, known, f"{tmp_path}/actions", f"{tmp_path}/stream", SCHEMA)):
        got = states.orderBy("enrollment_id").select("status", "contact_status", "contact_at").collect()
        assert [tuple(r) for r in got] == [("bounced", "replied", at), ("replied", "replied", at)]


def test_states_come_without_a_call_for_each_enrollment(spark):
    known = spark.createDataFrame([(1, 1, "pending"), (2, 1, "pending")], "enrollment_id long, step_order int, status string")
    touched = spark.range(1, 2).select(F.col("id").alias("enrollment_id"), F.expr("array(named_struct('ord', 1L, 'step_order', 1, 'action', 'sent', 'ts', timestamp'2024-01-01'))").alias("actions"))
    found = enrollments.states(known, touched)
    assert [tuple(r)[:3] for r in found.collect()] == [(1, "completed", 2)]
    assert not {"Python", "Pandas"} & set(found._jdf.queryExecution().toString().replace("In", " ").split())
