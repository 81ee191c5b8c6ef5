"""Canonical views over the stored tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Query categories, and the capability that each belongs to.
CATEGORIES = [
    "DIRECT_MATCH", "BROAD_CATEGORY", "SYNONYM", "TYPO", "SPECIAL_CHARACTER", "MERGED_WORDS", "BRAND_SEARCH", "SPLIT_WORD",
    "NATURAL_LANGUAGE", "PRICE_ANCHORED", "NEGATIVE_INTENT", "UNIT_VARIATION", "PLURAL_SINGULAR", "ABBREVIATION",
    "LOCALE_VARIATION", "SKU_MODEL_NUMBER", "SUBJECTIVE_ATTRIBUTE", "USE_CASE", "SEASONAL_OCCASION", "MULTI_ATTRIBUTE",
    "STOP_WORD_HEAVY", "PARTIAL_QUERY", "LONG_VERBOSE_QUERY", "SEMANTIC_MEANING", "CATEGORY_MAPPING", "FACET_EXTRACTION",
]
CAPABILITIES = {
    "TYPO_TOLERANCE": ["TYPO", "MERGED_WORDS", "SPLIT_WORD", "SPECIAL_CHARACTER", "PARTIAL_QUERY"],
    "LANGUAGE_UNDERSTANDING": ["SYNONYM", "NATURAL_LANGUAGE", "LONG_VERBOSE_QUERY", "STOP_WORD_HEAVY", "SEMANTIC_MEANING"],
    "PRODUCT_DISCOVERY": ["DIRECT_MATCH", "BROAD_CATEGORY", "CATEGORY_MAPPING"],
    "BRAND_MODEL_SEARCH": ["BRAND_SEARCH", "SKU_MODEL_NUMBER", "ABBREVIATION"],
    "FILTERS_CONSTRAINTS": ["PRICE_ANCHORED", "NEGATIVE_INTENT", "MULTI_ATTRIBUTE", "FACET_EXTRACTION", "UNIT_VARIATION"],
    "SHOPPING_CONTEXT": ["USE_CASE", "SUBJECTIVE_ATTRIBUTE", "SEASONAL_OCCASION", "LOCALE_VARIATION", "PLURAL_SINGULAR"],
}
COMPANY_STATUSES = ["not-contacted", "contacted", "replied", "meeting-booked", "in-trial", "won", "lost", "not-interested"]
STAGES = ["contacted", "replied", "meeting-booked", "demo-done", "won", "lost"]


def capability_map():
    """A small literal map from category to capability; it has an entry for each fixed category."""
    return F.create_map(*[F.lit(x) for cap, cats in CAPABILITIES.items() for cat in cats for x in (cat, cap)])


class Views:
    """Lazy views over one folder of stored tables; only the columns that a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table dealt to all cores, for work that is heavy for each row; a small file is read by one task otherwise."""
        parts = max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self.table(name).select(*columns).repartition(parts)

    # search audits
    def queries(self) -> DataFrame:
        """query_id, query, category, capability: a test query per order, its text from the parts in turn."""
        words = self.table("part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query"))
        parts = max(1, words.count())
        orders = self.table("orders").select(F.col("o_orderkey").alias("query_id"), F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("o_orderkey") % 26).cast("int")).alias("category"), (F.col("o_orderkey") % parts).alias("p_partkey"))
        return orders.join(words, "p_partkey").select("query_id", "query", "category", F.element_at(capability_map(), F.col("category")).alias("capability"))

    def scored(self) -> DataFrame:
        """query_id, title, original_rank, relevance_score: a ranked result per lineitem."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount")
        ranked = lines.withColumn("original_rank", F.row_number().over(order))
        parts = self.table("part").select("p_partkey", "p_name")
        return ranked.join(parts, ranked.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("query_id"), F.col("p_name").alias("title"), "original_rank", (F.col("l_discount") * 10).alias("relevance_score"))

    # outreach
    def companies(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        key = F.col("n_nationkey")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            key.alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://www."), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))), F.lit(".example.com/shop")).alias("website"),
            F.get(F.array(*map(F.lit, COMPANY_STATUSES)), (key % 8).cast("int")).alias("status"), F.when(key % 6 != 0, F.col("r_name")).alias("platform"),
            F.format_string("2024-01-%02dT00:00:00Z", key + 1).alias("updated_at"), F.when(key % 5 == 0, F.concat(F.lit("https://reports.example.com/"), key.cast("string"))).alias("report_url"))

    def contacts(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("company_id"), F.when(key % 17 != 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))).alias("email"),
            F.col("c_mktsegment").alias("role"), F.when(key % 11 == 0, "unsubscribed").when(key % 13 == 0, "bounced").otherwise("active").alias("status"),
            F.when(key % 7 == 0, 1).otherwise(0).alias("opt_out"), F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, "verified").when(key % 4 == 2, "risky").otherwise("guessed").alias("email_status"),
            F.col("c_acctbal").alias("score"))

    def enrollments(self) -> DataFrame:
        stage = F.get(F.array(*map(F.lit, STAGES)), F.substring("o_orderpriority", 1, 1).cast("int"))
        status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "completed").otherwise("paused")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("contact_id"), (F.col("o_orderkey") % 5).alias("sequence_id"), status.alias("status"), stage.alias("deal_stage"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("ab_variant"), (F.col("o_orderkey") % 3).alias("experiment_id"))

    def outreach_events(self) -> DataFrame:
        returned, line = F.col("l_returnflag"), F.col("l_linestatus")
        status = F.when((returned == "R") & (line == "F"), "replied").when(returned == "R", "bounced").when((returned == "A") & (line == "F"), "sent").when(returned == "A", "skipped").when(line == "F", "sent").otherwise("pending")
        quantity = F.col("l_quantity").cast("int")
        day = F.date_format("l_shipdate", "yyyy-MM-dd")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("enrollment_id"), F.col("l_linenumber").alias("step_order"), status.alias("status"), day.alias("scheduled_date"),
            F.when(status.isin("sent", "replied", "bounced"), day).alias("sent_at"), F.when(status == "replied", F.date_format(F.date_add("l_shipdate", 2), "yyyy-MM-dd")).alias("replied_at"),
            (quantity % 3).alias("open_count"), (quantity % 2).alias("click_count"))

    # sessions
    def session_steps(self) -> DataFrame:
        """A step per turn of a conversation, with the state that its search had."""
        length = F.length("text")
        state = F.when(length % 3 == 0, "FOUND").when(length % 3 == 1, "PARTIAL").otherwise("NOTHING")
        category = F.when(F.col("conv_id") % 9 != 0, F.get(F.array(*map(F.lit, CATEGORIES)), (length % 26).cast("int")))
        return self.table("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("step"), F.concat(F.lit("P"), (F.col("conv_id") % 5).cast("string")).alias("persona_key"), (F.col("conv_id") % 4 * 25 + 10).alias("basket_value"), state.alias("state"), category.alias("category"))
