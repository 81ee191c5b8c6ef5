"""Small helpers that several pipeline operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a group that one task numbers.
SLICE_ROWS = 1 << 13
#: Rows that Python workers get at once.
BATCH = 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) a fresh local folder is set;
    a cluster without the setting raises, as executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sparrowlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _bound_batches(spark: SparkSession) -> None:
    """Texts may be long: Python gets BATCH rows at once where the session keeps Spark's default of 10,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows never recomputes ``df``, even after an executor is lost.
    """
    _bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(rows: int, slice_rows: int = SLICE_ROWS) -> int:
    """How many slices a group of up to ``rows`` rows is numbered in: one holds about ``slice_rows`` at most."""
    return max(1, -(-rows // slice_rows))


def gapless_rank(df: DataFrame, groups: list[str], spread: Column, order: list[Column], out: str, chunks: Column | int) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... without gathering a group in one task.

    Rows are spread over ``chunks`` slices of their group (see ``slices``; it may depend on the
    group); a slice is numbered by a window of its own and starts where the slices before it end.
    Only a count for each slice meets.
    """
    chunk = F.pmod(spread, chunks if isinstance(chunks, Column) else F.lit(chunks)).cast("int")
    counts = df.groupBy(*groups, chunk.alias("_chunk")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = df.withColumn("_chunk", chunk)
    local = local.withColumn("_local", F.row_number().over(Window.partitionBy(*groups, "_chunk").orderBy(*order)))
    joined = local.join(starts, [F.col(g).eqNullSafe(F.col(f"_g{i}")) if df.schema[g].nullable else F.col(g) == F.col(f"_g{i}") for i, g in enumerate(groups)] + [F.col("_chunk") == F.col("_c")])
    return joined.withColumn(out, (F.col("_start") + F.col("_local") - 1).cast("long")).drop("_chunk", "_local", "_c", "_start", *[f"_g{i}" for i in range(len(groups))])


def best_of(found: DataFrame, k: int, parts: int, fan: int = 64) -> DataFrame:
    """The k least ``neg`` of each query, ties to the lesser ``vec_id``: query_id, rank (from 1), vec_id, neg.

    ``found`` has query_id, neg, vec_id and ``part``, a number below ``parts``. An id counts once,
    by its least ``neg``. Parts are reduced ``fan`` at a time, so that a list never holds more than
    the k best of that many, whatever the number of parts that a query was searched in.
    """
    while True:
        parts = -(-parts // fan)
        found = found.withColumn("part", F.floor(F.col("part") / fan))
        once = found.groupBy("query_id", "part", "vec_id").agg(F.min("neg").alias("neg"))
        lists = once.groupBy("query_id", "part").agg(F.slice(F.sort_array(F.collect_list(F.struct("neg", "vec_id"))), 1, k).alias("best"))
        found = lists.select("query_id", "part", F.posexplode("best").alias("at", "b")).select("query_id", "part", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.neg").alias("neg"))
        if parts <= 1:
            return found.select("query_id", "rank", "vec_id", "neg")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
