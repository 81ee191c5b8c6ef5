"""Files in and out: tables of text with trimmed headers, checked review decisions, runs, and merged snapshots."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.web import link_type

# Columns that a file of review decisions must have.
REVIEW_COLUMNS = ["reviewId", "workbook", "rowIndex", "company", "role", "bucket", "priority", "candidateName", "candidateLinkedin", "candidateEmail", "humanDecision"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Strings by a header row: headers trimmed, quoted line ends kept, empty lines left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return named.where(F.coalesce(*[F.col(f"`{c}`") for c in named.columns]).isNotNull())


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in that order; arrays are joined with semicolons."""
    kinds = dict(rows.dtypes)
    rows.select(*[F.array_join(c, "; ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]).write.csv(path, header=True, escape='"')


def export_all(sections: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Several tables below one folder, each as CSV files with its columns in order: ``sections`` maps a name to rows and columns."""
    for name, (rows, columns) in sections.items():
        write_csv(rows, f"{path.rstrip('/')}/{name}-export", columns)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """name and url of a JSON list of reports, those with a url; a file that isn't there or is no such list gives no rows."""
    schema = "name string, url string"
    try:
        spark.read.text(path).limit(1).collect()
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED").where("coalesce(url, '') <> ''")


def review_decisions(raw: DataFrame, valid: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a reason) of review decisions; columns that are missing raise.

    A blank decision is SKIP, decisions are upper-case, row numbers are whole numbers at the start
    of a field, and rows without id, company and role are left out of both.
    """
    if missing := [c for c in REVIEW_COLUMNS if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    clean = raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in raw.columns])
    clean = clean.where(~((F.col("reviewId") == "") & (F.col("company") == "") & (F.col("role") == "")))
    clean = clean.withColumn("humanDecision", F.coalesce(F.nullif(F.upper("humanDecision"), F.lit("")), F.lit("SKIP")))
    number = F.regexp_extract("rowIndex", r"^[+-]?\d+", 0).try_cast("int")
    error = F.when(F.col("reviewId") == "", "missing reviewId").when(number.isNull(), "invalid rowIndex").when(~F.col("humanDecision").isin("SKIP", *valid), "invalid humanDecision")
    checked = clean.withColumn("error", error)
    return checked.where("error is null").drop("error").withColumn("rowIndex", number), checked.where("error is not null")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` where driver and executors share files (``spark.checkpoint.dir``).

    Only on one machine and without that setting it is a temporary one; a cluster without it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sparrowlens-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a shared folder and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a folder or pattern with the name of the file that each came from."""
    return spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("source_file"))


def merge_snapshot(current: DataFrame, changes: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """The next snapshot: allowed columns take the change unless it is null; rows with new keys are added.

    ``changes`` has a row per key at most. Columns outside ``allowed`` never change, and a new row
    has them null.
    """
    put = [c for c in allowed if c in changes.columns]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in put])
    both = current.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in put else F.col(c) for c in current.columns])


def replace_links(links: DataFrame, owners: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """Links after the sets of some owners are replaced: theirs go, the wanted ones come, others stay."""
    return links.join(owners.select(owner).distinct(), owner, "left_anti").unionByName(wanted.select(*links.columns).distinct())


def report_slugs(companies: DataFrame, registry: DataFrame, tries: int = 8) -> DataFrame:
    """A slug for each company: that of the registry, else its name and four digits from its hash that no other has.

    ``companies``: company. ``registry``: company, slug. Of a company's ``tries`` numbers the first
    that is free is taken, so a slug is the same in every run. Companies that have none of those free
    go through all 9000 numbers; only if all are taken the slug is null.
    """
    have = registry.where("slug <> ''").groupBy("company").agg(F.min("slug").alias("known"))
    own = companies.select("company").distinct().join(have, "company", "left")
    taken = registry.select("slug").distinct()

    def first_free(wanting: DataFrame, n: int) -> DataFrame:
        hashed = lambda *parts: F.conv(F.left(F.md5(F.concat_ws("-", *parts)), F.lit(8)), 16, 10).cast("long")
        number = lambda i: hashed(F.col("company"), i.cast("string")) % 9000 if n < 9000 else (hashed(F.col("company")) + i) % 9000
        tried = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.col("company"), F.lit("-"), (number(i) + 1000).cast("string")))
        fresh = wanting.select("company", F.posexplode(tried).alias("turn", "slug")).join(taken, "slug", "left_anti")
        return fresh.groupBy("company").agg(F.min_by("slug", "turn").alias("made"))

    wanting = own.where("known is null").select("company")
    made = first_free(wanting, tries)
    made = made.unionByName(first_free(wanting.join(made, "company", "left_anti"), 9000))
    return own.join(made, "company", "left").select("company", F.coalesce("known", "made").alias("slug"))


def cache_key(*parts: Column) -> Column:
    """The key of a cached answer: MD5 of its parts with bars between them, nulls as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def cached(wanted: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """What ``cache`` (key, value, stored_at) has of ``wanted``, with the latest value of each key, and the rest, which is still to be asked for."""
    last = cache.groupBy(F.col(key).alias("_k")).agg(F.max_by("value", "stored_at").alias("value"))
    both = wanted.join(last.withColumn("_hit", F.lit(True)), F.col(key) == F.col("_k"), "left").drop("_k")
    return both.where("_hit").drop("_hit"), both.where("_hit is null").drop("_hit", "value")


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts, each key (whatever its case) from the first part that has it."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    columns = parts[0].columns
    return every.groupBy(F.lower(key).alias("_k")).agg(F.min(F.struct("_part", *columns)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in columns])


# The form of a search engine's answer, as far as it is read.
ANSWER = "struct<web:struct<results:array<struct<title:string,url:string,description:string,meta_url:struct<hostname:string,path:string>>>>>"


def search_results(answers: DataFrame) -> DataFrame:
    """Results of search answers (query, body as JSON) with rank from 1, a snippet of 300 characters, a shown address and the type of a profile link.

    Answers that are no JSON or hold no results give no rows.
    """
    parsed = answers.select("query", F.posexplode(F.from_json("body", ANSWER)["web"]["results"]).alias("place", "r"))
    host, path, url = F.col("r.meta_url.hostname"), F.col("r.meta_url.path"), F.col("r.url")
    whole = (F.coalesce(host, F.lit("")) != "") & (F.coalesce(path, F.lit("")) != "")
    return parsed.select("query", (F.col("place") + 1).alias("rank"), F.coalesce("r.title", F.lit("")).alias("title"), F.left(F.coalesce("r.description", F.lit("")), F.lit(300)).alias("snippet"), url.alias("url"), F.when(whole, F.concat(host, path)).otherwise(url).alias("display_url"), link_type(url).alias("link_type"))


def read_posts(spark: SparkSession, path: str, required: tuple[str, ...] = ("title", "excerpt", "date")) -> DataFrame:
    """Posts of a folder of ``.md`` and ``.mdx`` files, newest first: slug, front (map of the front matter's plain lines) and content.

    A post without one of the required texts raises.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md*").select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("file").rlike(r"\.mdx?$"))
    head = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*\s*:"))
    pair = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)\s*:", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^\w+\s*:\s*(.*?)\s*$", 1), "^([\"'])(.*)\\1$", "$2").alias("v")))
    posts = raw.select(F.regexp_replace("file", r"\.mdx?$", "").alias("slug"), F.map_from_entries(pair).alias("front"), F.regexp_replace("value", r"(?s)^---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)", "").alias("content"))
    lacking = F.filter(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.try_element_at(F.col("front"), k), F.lit("")) == "")
    checked = F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("post "), F.col("slug"), F.lit(" lacks "), F.array_join(lacking, ", "))).cast("map<string,string>")).otherwise(F.col("front"))
    return posts.withColumn("front", checked).orderBy(F.desc(F.try_to_timestamp(F.try_element_at(F.col("front"), F.lit("date")))), "slug")
