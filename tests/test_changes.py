"""Changes merged batch by batch against a plain dictionary, with batches that come again."""

import random

from pyspark.sql import functions as F

from sparrowlens.streaming import changes

ENTITIES = "id long, name string, score int, note string"


def plain(entities, links, rows):
    entities, links = dict(entities), set(links)
    for _, op, i, fields, targets in sorted(rows, key=lambda r: r[0]):
        if i is None:
            continue
        if op == "upsert":
            old = entities.get(i, (None, None, None))
            value = lambda k, old: fields[k] if fields and k in fields else old
            score = value("score", old[1])
            entities[i] = (value("name", old[0]), int(score) if score is not None else None, old[2])
        elif op == "delete":
            entities.pop(i, None)
            links = {p for p in links if p[0] != i}
        elif op in ("link", "set_links", "unlink"):
            if op == "set_links":
                links = {p for p in links if p[0] != i}
            for t in targets or []:
                (links.discard if op == "unlink" else links.add)((i, t))
    return entities, {p for p in links if p[0] in entities}


def batch_of(rng, start):
    rows = []
    for n in range(rng.randrange(0, 40)):
        op = rng.choice(["upsert", "upsert", "delete", "link", "unlink", "set_links", "other"])
        fields = {k: v for k, v in (("name", rng.choice(["a", "b", None])), ("score", rng.choice(["1", "2", None])), ("note", "never")) if rng.random() < 0.6}
        rows.append((start + n, op, rng.choice([None, *range(12)]), fields if op == "upsert" else None, rng.choice([None, [], [1], [1, 2, 2], [3, None]]) if op != "upsert" else None))
    return rows


def state(store):
    entities, links = store.read()
    return {r.id: (r.name, r.score, r.note) for r in entities.collect()}, {(r.id, r.target) for r in links.collect()}


def test_batches(spark, tmp_path):
    rng = random.Random(4)
    entities, links = {i: (f"n{i}", i, f"note{i}") for i in range(6)}, {(0, 1), (0, 2), (5, 3)}
    store = changes.Store(spark, f"file://{tmp_path}/store", ENTITIES, ["name", "score"])
    store.start(spark.createDataFrame([(k, *v) for k, v in entities.items()], ENTITIES), spark.createDataFrame(list(links), "id long, target long"))
    for number in range(6):
        rows = batch_of(rng, 0)
        rows = [(o, op, i, f, [t for t in ts if t is not None] if ts and number % 2 else ts) for o, op, i, f, ts in rows]
        # a link of an unknown entity is only made if the entity is there after the batch
        frame = spark.createDataFrame(rows, changes.CHANGE)
        store.merge(frame, number)
        entities, links = plain(entities, {p for p in links}, [(o, op, i, f, [t for t in ts or [] if t is not None]) for o, op, i, f, ts in rows])
        assert state(store) == (entities, links), number
        if number % 2:
            store.merge(frame, number)  # again
            assert state(store) == (entities, links)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    store = changes.Store(spark, f"file://{tmp_path}/store", ENTITIES, ["name", "score"])
    store.start(spark.createDataFrame([], ENTITIES), spark.createDataFrame([], "id long, target long"))

    def write(rows):
        spark.createDataFrame(rows, changes.CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    source = lambda: spark.readStream.schema(changes.CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write([(1, "upsert", 1, {"name": "one"}, None), (2, "link", 1, None, [7, 8]), (3, "upsert", 2, {"name": "two", "other": "x"}, None)])
    write([(4, "unlink", 1, None, [7]), (5, "delete", 2, None, None), (6, "upsert", 3, {"score": "3"}, None)])
    changes.follow(store, source(), f"file://{tmp_path}/cp")
    want = {1: ("one", None, None), 3: (None, 3, None)}
    assert state(store) == (want, {(1, 8)}) and store.last() == 1
    changes.follow(store, source(), f"file://{tmp_path}/cp")
    assert store.last() == 1
    write([(7, "set_links", 1, None, [9]), (8, "upsert", 1, {"name": None, "score": "5"}, None)])
    changes.follow(store, source(), f"file://{tmp_path}/cp")
    assert state(store) == ({1: (None, 5, None), 3: (None, 3, None)}, {(1, 9)}) and store.last() == 2
    assert store.read(0)[0].where(F.col("id") == 2).count() == 1  # earlier snapshots are still there
