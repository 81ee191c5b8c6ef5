"""Results and queries of an audit: cleaning, validation, tiers, twins with accents, ladders and samples."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.web import is_junk_title

# Scores of a first result below which it misses, and categories that aren't about accents.
MISS, CONFOUNDING = 0.40, ["TYPO", "MERGED_WORDS", "SPLIT_WORD", "PARTIAL_QUERY"]


def clean_results(results: DataFrame) -> DataFrame:
    """Results whose titles aren't junk, ranked anew from 1 in each query (``rank``)."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("original_rank"))
    return results.where(~is_junk_title(F.col("title"))).withColumn("rank", place)


def valid_queries(raw: DataFrame, categories: list[str]) -> DataFrame:
    """Generated queries (ord, category, query, rationale) of known categories, trimmed, each text once.

    Texts that differ in case only are one, the first by ``ord`` stays; a missing rationale is
    made from the category. Nulls count as empty.
    """
    query = F.trim(F.coalesce("query", F.lit("")))
    reason = F.trim(F.coalesce("rationale", F.lit("")))
    sound = raw.where(F.col("category").isin(categories)).withColumn("query", query).where("query <> ''")
    row = F.struct("ord", "category", "query", F.when(reason == "", F.concat(F.lit("Tests "), F.col("category"), F.lit(" behaviour"))).otherwise(reason).alias("rationale"))
    return sound.groupBy(F.lower("query").alias("_k")).agg(F.min_by(row, "ord").alias("r")).select("r.*")


def missing_quota(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Categories that have fewer queries than their target, and how many they lack."""
    have = queries.groupBy("category").agg(F.count("*").alias("have"))
    return targets.join(have, "category", "left").select("category", (F.col("target") - F.coalesce("have", F.lit(0))).alias("missing")).where("missing > 0")


def commercial_tier(n_results: Column, failure_mode: Column, top_score: Column) -> Column:
    """A (the customer is lost), B (ranking is imperfect) or C."""
    lost = (n_results == 0) | (failure_mode == "CONSTRAINT_DROPPED") | F.coalesce(top_score < MISS, F.lit(False))
    return F.when(lost, "A").when(failure_mode == "POOR_RANKING", "B").otherwise("C")


def risk_bucket(n_results: Column, failure_mode: Column, top_score: Column) -> Column:
    return F.when((n_results == 0) | (failure_mode == "CONSTRAINT_DROPPED"), "revenue_risk").when(top_score < MISS, "catastrophic").otherwise("working")


def tier_summary(judged: DataFrame) -> DataFrame:
    """Queries of each tier by capability, and the share of tier A in whole percent."""
    tier = commercial_tier(F.col("n_results"), F.col("failure_mode"), F.col("top_score"))
    own = judged.select("capability", tier.alias("tier"))
    count = lambda t: F.sum(F.when(F.col("tier") == t, 1).otherwise(0))
    out = own.groupBy("capability").agg(F.count("*").alias("total"), *[count(t).alias(f"tier_{t.lower()}") for t in "ABC"])
    return out.withColumn("bounce_share", F.floor(F.col("tier_a") * 100.0 / F.col("total") + 0.5).cast("long"))


def stripped(text: Column) -> Column:
    """Texts without combining marks (canonical decomposition, marks dropped); Spark has no such function."""

    @F.pandas_udf("string")
    def strip(texts):
        return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), na_action="ignore")

    return strip(text)


def accent_twins(judged: DataFrame) -> DataFrame:
    """Queries with accents beside the query without them: both buckets, the twin's null if nobody asked it.

    Each text counts once (its greatest query_id). The two sides meet on the text without accents,
    so no pairs are compared.
    """
    bucket = risk_bucket(F.col("n_results"), F.col("failure_mode"), F.col("top_score"))
    one = judged.groupBy("query").agg(F.max_by(F.struct("category", bucket.alias("bucket")), "query_id").alias("r")).select("query", "r.*")
    accented = one.where(F.col("query").rlike("[^\\x00-\\x7F]") & ~F.col("category").isin(CONFOUNDING)).withColumn("twin", stripped(F.col("query"))).where("twin <> query")
    plain = one.select(F.col("query").alias("twin"), F.col("bucket").alias("twin_bucket"))
    return accented.join(plain, "twin", "left").select(F.col("query").alias("accented"), "bucket", F.col("twin").alias("stripped"), "twin_bucket")


def query_cloud(queries: DataFrame, limit: int = 26, longest: int = 40) -> DataFrame:
    """A balanced sample: the shortest texts of each category in turn, with a size from their hash.

    A text counts once in each category, whatever its case; in a turn categories come by name.
    ``limit`` is the feature, a report of so many.
    """
    text = F.trim(F.regexp_replace(F.trim("query"), '^"+|"+$', ""))
    own = queries.select("category", text.alias("text")).where((F.length("text") > 0) & (F.length("text") <= longest))
    once = own.groupBy("category", F.lower("text").alias("key")).agg(F.min("text").alias("text"))
    # a category's first ``limit`` texts are enough; Spark keeps so many per task before the shuffle
    turn = F.row_number().over(Window.partitionBy("category").orderBy(F.length("text"), "text"))
    picked = once.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", "category").limit(limit)
    # the 128-bit hash modulo 100 from its four words: powers of 2 ** 32 leave 1, 96, 16 and 36
    word = lambda at: F.conv(F.substring(F.md5("text"), at, 8), 16, 10).cast("long") % 100
    h = (word(25) + 96 * word(17) + 16 * word(9) + 36 * word(1)) % 100
    size = F.when(h < 8, 5).when(h < 24, 4).when(h < 56, 3).when(h < 82, 2).otherwise(1)
    return picked.select("text", "category", "turn", size.alias("size"))


def next_chunk(wanted: DataFrame, done: DataFrame, key: str, size: int = 10) -> DataFrame:
    """The next ``size`` of ``wanted`` (key, place) that aren't ``done``, in order: what a resumed run asks for next."""
    return wanted.join(done.select(key).distinct(), key, "left_anti").orderBy("place", key).limit(size)


def fetch_totals(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row with queries, results and empty; the queries without results) of what was fetched (query, n)."""
    n = F.coalesce("n", F.lit(0))
    return fetched.agg(F.count("*").alias("queries"), F.coalesce(F.sum(n), F.lit(0)).alias("results"), F.count_if(n == 0).alias("empty")), fetched.where(n == 0).select("query")
