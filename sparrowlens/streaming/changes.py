"""Changes of entities and their links as a stream of batches, each merged once whatever happens to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: What a change may be: ``upsert`` (the ``fields`` that are set), ``delete`` (with all links), ``link`` and ``unlink`` of
#: ``targets``, ``set_links`` (these targets and no others). Changes of a batch count in order of ``ord``.
CHANGE = "ord long, op string, id long, fields map<string,string>, targets array<long>"


def _after_delete(changes: DataFrame) -> DataFrame:
    """Changes of an entity from its last delete of the batch on; ``gone`` tells whether there was one."""
    own = Window.partitionBy("id")
    at = F.max(F.when(F.col("op") == "delete", F.col("ord"))).over(own)
    return changes.withColumn("_d", at).withColumn("gone", F.col("_d").isNotNull()).where("_d is null or ord >= _d").drop("_d")


def merged(entities: DataFrame, links: DataFrame, changes: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities and links after one batch of ``changes`` (``CHANGE``).

    ``entities``: id and columns, of which a change may set the ``allowed`` ones (as text, cast to their
    type; a field that is named with null becomes null); other fields are passed over. An upsert of
    an unknown id makes it. ``links``: id, target, each pair once. A delete takes an entity's links with it;
    links of an entity that isn't there are not made. Rows with null ids or other kinds of changes say nothing.
    """
    known = changes.where("id is not null and op in ('upsert', 'delete', 'link', 'unlink', 'set_links')")
    live = _after_delete(known)
    deleted = live.where("op = 'delete'").select("id").distinct()
    upserts = live.where("op = 'upsert'")
    made = upserts.select("id").distinct()
    last = lambda c: F.max(F.when(F.map_contains_key("fields", c), F.struct("ord", F.try_element_at("fields", F.lit(c)).alias("v"))))
    put = upserts.groupBy("id").agg(*[last(c).alias(c) for c in allowed])
    left = entities.join(deleted, "id", "left_anti")
    own = left.join(put.select(F.col("id").alias("_i"), *[F.col(c).alias(f"_p_{c}") for c in allowed]), F.col("id") == F.col("_i"), "left")
    kinds = dict(entities.dtypes)
    changed = own.select("id", *[F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in allowed else F.col(c) for c in entities.columns if c != "id"])
    fresh = put.join(made, "id", "left_semi").join(left.select("id"), "id", "left_anti")
    fresh = fresh.select("id", *[(F.col(f"{c}.v").cast(kinds[c]) if c in allowed else F.lit(None).cast(kinds[c])).alias(c) for c in entities.columns if c != "id"])
    now = changed.select(*entities.columns).unionByName(fresh.select(*entities.columns))

    linking = live.where("op in ('link', 'unlink', 'set_links')")
    cleared = linking.where("op = 'set_links'").groupBy("id").agg(F.max("ord").alias("from"))
    steps = linking.join(cleared, "id", "left").where("from is null or ord >= from")
    pairs = steps.select("id", "ord", F.explode(F.array_distinct("targets")).alias("target"), (F.col("op") != "unlink").alias("on")).where("target is not null")
    final = pairs.groupBy("id", "target").agg(F.max_by("on", "ord").alias("on"))
    kept = links.join(deleted, "id", "left_anti").join(cleared.select("id"), "id", "left_anti").join(final.select("id", "target"), ["id", "target"], "left_anti")
    after = kept.select("id", "target").unionByName(final.where("on").select("id", "target")).distinct()
    return now, after.join(now.select("id"), "id", "left_semi")


class Store:
    """Snapshots of entities and links below ``folder``, one for each batch.

    Batch n is made of the last snapshot before it and replaces what an earlier try of it wrote, so
    a batch that comes again changes nothing. A snapshot counts once both of its tables are whole.
    Earlier snapshots stay until they are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, entities: str, allowed: list[str]):
        self.spark, self.folder, self.entities, self.allowed = spark, folder.rstrip("/"), entities, allowed

    def start(self, entities: DataFrame, links: DataFrame) -> None:
        """The snapshot before the first batch."""
        self._write(-1, entities, links)

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _write(self, batch: int, entities: DataFrame, links: DataFrame) -> None:
        entities.write.mode("overwrite").parquet(self._path("entities", batch))
        links.write.mode("overwrite").parquet(self._path("links", batch))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._path("done", batch))

    def last(self, before: int | None = None) -> int:
        """The number of the last whole batch (before another), from the names of its files."""
        done = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.folder}/done")
        number = F.regexp_extract("path", r"/batch=(-?\d+)/", 1).cast("long")
        found = done.select(number.alias("n")).where("true" if before is None else f"n < {before}").agg(F.max("n")).first()[0]
        if found is None:
            raise ValueError(f"{self.folder} has no snapshot")
        return found

    def read(self, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Entities and links after a batch, the last one by default."""
        number = self.last() if batch is None else batch
        return self.spark.read.schema(self.entities).parquet(self._path("entities", number)), self.spark.read.schema("id long, target long").parquet(self._path("links", number))

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Merge a batch of changes: the function for ``foreachBatch``."""
        entities, links = self.read(self.last(batch))
        self._write(batch, *merged(entities, links, changes, self.allowed))


def follow(store: Store, changes: DataFrame, checkpoint: str) -> None:
    """Merge a stream of changes (``CHANGE``) into a store until all that is there is merged."""
    query = changes.writeStream.foreachBatch(lambda batch, number: store.merge(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
