"""Search-quality metrics over judged queries and their ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import half_even, half_up, percent
from ..functions.text import family_key, normal_key, phrases, query_terms

# Fixed values.
RELEVANT, WEAK, NO_RESULT_DISPLACEMENT = 0.60, 0.40, 15
SEVERITIES = ["PASS", "MINOR", "MODERATE", "CRITICAL"]
ATTRIBUTE_CATEGORIES = ["MULTI_ATTRIBUTE", "PRICE_ANCHORED", "NEGATIVE_INTENT", "FACET_EXTRACTION", "UNIT_VARIATION"]
SPECIFICITY_CATEGORIES = ["BROAD_CATEGORY", "DIRECT_MATCH", "MULTI_ATTRIBUTE", "USE_CASE", "SYNONYM", "PLURAL_SINGULAR"]
DIVERSITY_CATEGORIES = ["BROAD_CATEGORY", "SYNONYM", "USE_CASE", "PLURAL_SINGULAR"]
HIGH_INTENT_CATEGORIES = ["DIRECT_MATCH", "BRAND_SEARCH", "SKU_MODEL_NUMBER"]


def severity_rank(severity: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def rerank(results: DataFrame) -> DataFrame:
    """Results by relevance, ties in the original order: rank 1 to n beside the original rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "original_rank")
    return results.withColumn("rank", F.row_number().over(order))


def top_original(results: DataFrame, k: int) -> DataFrame:
    """The first k results as shown; ``original_rank`` may have gaps."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("original_rank"))
    return results.withColumn("place", place).where(F.col("place") <= k)


def query_stats(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: results, best relevance, mean of the first three shown, displacement of the best, top result.

    A query's results are sorted once, to number those that are shown first; all else is one
    aggregation, in which the best one is a minimum of structs. Queries without results have 0, 0 and the displacement of the fixed value.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("original_rank"))
    per = (
        results.withColumn("place", place)
        .groupBy("query_id")
        .agg(
            F.count("*").alias("n_results"),
            F.max("relevance_score").alias("max_relevance"),
            F.avg(F.when(F.col("place") <= 3, F.col("relevance_score"))).alias("top3_avg"),
            F.min(F.struct((-F.col("relevance_score")).alias("s"), F.col("original_rank").alias("r")))["r"].alias("best_rank"),
            F.max(F.when(F.col("place") == 1, F.col("relevance_score"))).alias("top_score"),
            F.max(F.when(F.col("place") == 1, F.col("title"))).alias("top_title"),
        )
    )
    return queries.join(per, "query_id", "left").select(
        *queries.columns, F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("max_relevance", F.lit(0.0)).alias("max_relevance"), F.coalesce("top3_avg", F.lit(0.0)).alias("top3_avg"),
        F.coalesce(F.col("best_rank") - 1, F.lit(NO_RESULT_DISPLACEMENT)).cast("int").alias("displacement"), "top_score", "top_title")


def judge(stats: DataFrame) -> DataFrame:
    """Severity and failure mode from the statistics alone."""
    best, moved = F.col("max_relevance"), F.col("displacement")
    severity = F.when(best < 0.25, "CRITICAL").when(moved > 6, "CRITICAL").when(moved > 2, "MODERATE").otherwise("PASS")
    mode = F.when(best < 0.25, "ZERO_RESULTS_OR_GARBAGE").when(moved > 2, "POOR_RANKING").otherwise("OTHER")
    return stats.withColumns({"severity": severity, "failure_mode": mode})


def _counts() -> list[Column]:
    count = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(f"{s.lower()}_count")
    return [count(s) for s in ("CRITICAL", "MODERATE", "MINOR", "PASS")]


def capability_rollup(judged: DataFrame) -> DataFrame:
    """Worst severity, queries and those that don't pass for each capability; unmapped categories are left out."""
    rank = F.max(severity_rank(F.col("severity")))
    out = judged.where(F.col("capability").isNotNull()).groupBy("capability").agg(rank.alias("severity_rank"), F.count("*").alias("total"), F.sum(F.when(F.col("severity") != "PASS", 1).otherwise(0)).alias("non_pass"))
    return out.withColumn("severity", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("severity_rank"))).orderBy(F.desc("severity_rank"), "capability")


def aggregate_stats(judged: DataFrame) -> DataFrame:
    """One row of counts and rates; the rates are of queries with results."""
    shown = F.col("n_results") > 0
    n = F.sum(F.when(shown, 1).otherwise(0))
    rate = lambda cond: percent(F.sum(F.when(shown & cond, 1).otherwise(0)), n)
    weak = shown & (F.col("top_score") < WEAK)
    worst = F.min(F.when(weak, F.struct((-F.col("displacement")).alias("d"), F.col("query_id").alias("q"), F.col("query").alias("query"))))
    return judged.agg(
        F.count("*").alias("total_queries"), *_counts(), rate(F.col("displacement") > 2).alias("pct_top3_irrelevant"),
        F.coalesce(F.try_divide(F.sum(F.when(shown, F.col("displacement") + 1)), n), F.lit(0.0)).alias("avg_best_position"), rate(F.col("top_score") < WEAK).alias("pct_top1_irrelevant"),
        F.coalesce(worst["query"], F.lit("")).alias("worst_example_query"), F.coalesce(-worst["d"], F.lit(0)).alias("worst_example_displacement"))


def failure_modes(judged: DataFrame) -> DataFrame:
    """How many queries that don't pass have each failure mode, the most first."""
    return judged.where("severity <> 'PASS'").groupBy("failure_mode").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "failure_mode")


def purity(results: DataFrame) -> DataFrame:
    """Per query with results: relevant and shown results among the first 3, 5 and 10, and their share."""
    top = top_original(results, 10)
    relevant = F.col("relevance_score") >= RELEVANT
    cols = []
    for k in (3, 5, 10):
        inside = F.col("place") <= k
        cols += [F.sum(F.when(inside & relevant, 1).otherwise(0)).alias(f"top{k}_relevant"), F.sum(F.when(inside, 1).otherwise(0)).alias(f"top{k}_total")]
    out = top.groupBy("query_id").agg(*cols)
    return out.withColumns({f"top{k}_purity": percent(F.col(f"top{k}_relevant"), F.col(f"top{k}_total")) for k in (3, 5, 10)})


def purity_totals(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[percent(F.sum(f"top{k}_relevant"), F.sum(f"top{k}_total")).alias(f"top{k}") for k in (3, 5, 10)])


def top_result_trust(judged: DataFrame) -> DataFrame:
    """Why a query's first result can't be trusted, or null; queries without results fail."""
    top, best = F.col("top_score"), F.col("max_relevance")
    reason = (
        F.when(F.col("n_results") == 0, "No visible result was available.")
        .when(top < WEAK, "The first result is weakly related to the query.")
        .when(top < RELEVANT, "The first result is only a partial answer.")
        .when((best - top >= 0.20) & (F.col("displacement") > 2), "A much stronger result appears lower in the list.")
    )
    return judged.select("query_id", "query", F.coalesce("top_title", F.lit("No results")).alias("top_result"), F.coalesce(top, F.lit(0.0)).alias("top_score"), best.alias("best_score"), reason.alias("reason"))


def trust_rate(trust: DataFrame) -> DataFrame:
    failed = F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0))
    return trust.agg(failed.alias("failed"), F.count("*").alias("total"), percent(failed, F.count("*")).alias("failure_rate"))


def attribute_drift(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per term of an attribute query: in how many of the first five titles it occurs, and so what became of it."""
    asked = queries.where(F.col("category").isin(ATTRIBUTE_CATEGORIES)).withColumn("terms", query_terms(F.col("query"))).where(F.size("terms") >= 2)
    shown = top_original(results, 5).groupBy("query_id").agg(F.collect_list(F.lower("title")).alias("titles"))
    hits = asked.join(shown, "query_id", "left").select("query_id", F.explode("terms").alias("term"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))
    n = F.size(F.filter("titles", lambda t: F.contains(t, F.col("term"))))
    hits = hits.select("query_id", "term", n.alias("hits"), F.size("titles").alias("shown"))
    state = F.when((F.col("shown") > 0) & (F.col("hits") >= F.greatest(F.lit(3), F.floor(F.col("shown") / 2) + 1)), "preserved").when(F.col("hits") > 0, "partial").otherwise("dropped")
    return hits.withColumn("state", state)


def attribute_coverage(drift: DataFrame) -> DataFrame:
    weight = F.when(F.col("state") == "preserved", 1.0).when(F.col("state") == "partial", 0.5).otherwise(0.0)
    return drift.groupBy("query_id").agg(percent(F.sum(weight), F.count("*")).alias("coverage"), F.sum(F.when(F.col("state") == "dropped", 1).otherwise(0)).alias("dropped"))


def common_dropped(drift: DataFrame, k: int = 8) -> DataFrame:
    return drift.where("state = 'dropped'").groupBy("term").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "term").limit(k)


def diversity(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct product families among the first ten results of broad queries with five results or more."""
    top = top_original(results, 10).withColumn("family", F.nullif(family_key(F.col("title")), F.lit("")))
    per = top.groupBy("query_id").agg(F.count("*").alias("n"), F.count("family").alias("result_count"), F.countDistinct("family").alias("unique_families")).where("n >= 5")
    asked = queries.where(F.col("category").isin(DIVERSITY_CATEGORIES)).select("query_id")
    return asked.join(per, "query_id").select("query_id", "unique_families", "result_count", (F.col("result_count") - F.col("unique_families")).alias("duplicate_count"), percent(F.col("unique_families"), F.col("result_count")).alias("diversity_rate"))


def specificity_pairs(queries: DataFrame) -> DataFrame:
    """Queries of which one's terms are properly among the other's, each text once.

    A narrower query holds all of the broader one's terms, so they meet over the broader query's
    rarest term (by the number of queries that hold it) and not over all pairs.
    """
    terms = queries.where(F.col("category").isin(SPECIFICITY_CATEGORIES)).select("query").distinct().withColumn("terms", query_terms(F.col("query"))).where(F.size("terms") > 0)
    narrow = terms.select(F.col("query").alias("narrow"), F.col("terms").alias("narrow_terms"), F.explode("terms").alias("term"))
    held = narrow.groupBy("term").agg(F.count("*").alias("n"))
    each = terms.select(F.col("query").alias("broad"), F.col("terms").alias("broad_terms"), F.explode("terms").alias("term")).join(held, "term")
    broad = each.groupBy("broad", "broad_terms").agg(F.min(F.struct("n", "term")).alias("rarest")).select("broad", "broad_terms", F.col("rarest.term").alias("term"))
    pairs = broad.join(narrow, "term").where((F.size("broad_terms") < F.size("narrow_terms")) & (F.size(F.array_except("broad_terms", "narrow_terms")) == 0))
    return pairs.select("broad", "narrow", F.size("broad_terms").alias("broad_size"), F.size("narrow_terms").alias("narrow_size"))


def chain_breaks(chains: DataFrame, drop: float = 0.15) -> DataFrame:
    """For chains of queries (chain_id, step, query, score): the first whose score falls by more than ``drop``."""
    before = F.lag("score").over(Window.partitionBy("chain_id").orderBy("step"))
    return chains.withColumn("before", before).where(F.col("score") + drop < F.col("before")).groupBy("chain_id").agg(F.min_by("query", "step").alias("break_query"), F.min("step").alias("break_step"))


def proof_of_stock(judged: DataFrame, results: DataFrame, most: int = 6) -> DataFrame:
    """For queries without results: another query that finds a phrase of theirs, with the title that has it.

    A phrase counts if titles of at most ``most`` queries hold it and one of those that are other
    queries holds it too. Of a query's phrases the longest counts, of its finders the shortest.
    Titles are cut into their phrases, each title once, so phrases meet by equality. Phrases that nobody asks for are
    left out before results are counted, and phrases that more queries hold before they meet.
    """
    asked = judged.where("n_results = 0").select("query_id", "query", F.posexplode(phrases(F.col("query"))).alias("at", "phrase")).withColumn("needle", normal_key(F.col("phrase")))
    titles = results.select(F.col("title").alias("_t")).distinct().select("_t", F.explode(phrases(F.col("_t"))).alias("p"))
    titles = titles.select("_t", normal_key(F.col("p")).alias("needle")).join(asked.select("needle").distinct(), "needle", "left_semi")
    held = results.join(titles, F.col("title") == F.col("_t")).groupBy("needle", F.col("query_id").alias("other_id")).agg(F.min_by("title", "original_rank").alias("example_title"))
    rare = held.groupBy("needle").agg(F.count("*").alias("df")).where(F.col("df") <= most).select("needle")
    found = asked.join(rare, "needle").join(held, "needle").join(judged.select(F.col("query_id").alias("other_id"), F.col("query").alias("other")), "other_id")
    direct = found.where((F.col("other") != F.col("query")) & F.contains(normal_key(F.col("other")), F.col("needle")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("at", F.length("other"), "other_id"))
    return direct.withColumn("n", best).where("n = 1").select("query_id", "query", F.col("other").alias("working_variant"), "example_title")


def worst_example(judged: DataFrame) -> DataFrame:
    """The one query that shows the worst failure: its tier and sentence, ties by id."""
    q, top, pos = F.col("query"), F.col("top_title"), F.col("displacement") + 1
    none = F.col("n_results") == 0
    weak = ~none & (F.col("top_score") < RELEVANT)
    buried = ~none & (F.col("displacement") > 2) & (F.col("max_relevance") - F.col("top_score") >= 0.15)
    tier = F.when(none & F.col("category").isin(HIGH_INTENT_CATEGORIES), 2).when(none, 3).when(weak, 4).when(buried, 5)
    key = F.when(none, F.length(q).cast("double")).when(weak, -F.col("top_score")).otherwise(-pos.cast("double"))
    line = F.when(none, F.format_string('A customer searching "%s" gets zero results — a blank page, nothing at all.', q)).when(weak, F.format_string('A customer searching "%s" sees "%s" at the #1 spot — not what they asked for.', q, top)).otherwise(F.format_string('A customer searching "%s" has to scroll to position %d to reach the best-matching product — below %d weaker results.', q, pos, F.col("displacement")))
    return judged.select("query_id", tier.alias("tier"), key.alias("key"), line.alias("sentence")).where("tier is not null").orderBy("tier", "key", "query_id").limit(1).select("query_id", "tier", "sentence")


def top3_miss(judged: DataFrame) -> DataFrame:
    """The share of queries whose best result lies outside the first three, of those with results and of all."""
    out = F.when(F.col("displacement") > 2, 1).otherwise(0)
    shown = F.when(F.col("n_results") > 0, 1).otherwise(0)
    return judged.agg(percent(F.sum(out * shown), F.sum(shown)).alias("with_results"), percent(F.sum(out), F.count("*")).alias("all_queries"))


def quality_score(judged: DataFrame, results: DataFrame) -> DataFrame:
    """0.45 trust + 0.35 best result in the first three + 0.20 purity of the first three, rounded half up."""
    trust = trust_rate(top_result_trust(judged)).select((100 - F.col("failure_rate")).alias("trust"))
    find = top3_miss(judged).select((100 - F.col("with_results")).alias("find_at_3"))
    pure = purity_totals(purity(results)).select(F.col("top3").alias("purity_at_3"))
    one = trust.join(find).join(pure)  # one row each
    return one.withColumn("score", half_up(0.45 * F.col("trust") + 0.35 * F.col("find_at_3") + 0.20 * F.col("purity_at_3")))


def crm_variables(judged: DataFrame) -> DataFrame:
    """Figures that go to outreach: counts by severity, shares of all queries rounded half up."""
    n = F.count("*")
    share = lambda cond: half_up(percent(F.sum(F.when(cond, 1).otherwise(0)), n))
    return judged.agg(n.alias("total"), *_counts(), share(F.col("displacement") > 2).alias("outside_top3_rate"), share(F.col("n_results") == 0).alias("zero_result_rate"))


def sales_context(judged: DataFrame) -> DataFrame:
    """Mean position, shares outside the first three and of ranking failures over all queries, rounded half even."""
    n = F.count("*")
    share = lambda cond: half_even(percent(F.sum(F.when(cond, 1).otherwise(0)), n)).cast("long")
    return judged.agg(n.alias("total_queries"), half_even(F.avg(F.col("displacement") + 1), 1).alias("avg_best_position"), share(F.col("displacement") > 2).alias("pct_outside_top3"), share(F.col("failure_mode") == "POOR_RANKING").alias("pct_ranking_failure"))


def coverage(judged: DataFrame) -> DataFrame:
    """Counts, pass rate and class of each category within its capability."""
    out = judged.where(F.col("capability").isNotNull()).groupBy("capability", "category").agg(F.count("*").alias("total"), *_counts())
    kind = F.when(F.col("critical_count") > 0, "gap").when(F.col("moderate_count") > 0, "mixed").when(F.col("minor_count") > 0, "developing").otherwise("good")
    return out.withColumns({"pass_rate": percent(F.col("pass_count"), F.col("total")), "class": kind})


def improvement_map(judged: DataFrame) -> DataFrame:
    """Severity counts, clean share, most frequent failure mode and headline of each capability, the most urgent first."""
    mapped = judged.where(F.col("capability").isNotNull())
    counts = mapped.groupBy("capability").agg(F.count("*").alias("total"), *_counts())
    modes = mapped.where("severity <> 'PASS'").groupBy("capability", "failure_mode").agg(F.count("*").alias("n"))
    first = modes.groupBy("capability").agg(F.min(F.struct((-F.col("n")).alias("n"), "failure_mode"))["failure_mode"].alias("top_issue"))
    headline = (
        F.when(F.col("critical_count") > 0, F.concat(F.col("critical_count").cast("string"), F.lit(" at risk")))
        .when(F.col("moderate_count") > 0, F.concat(F.col("moderate_count").cast("string"), F.lit(" friction")))
        .when(F.col("minor_count") > 0, F.concat(F.col("minor_count").cast("string"), F.lit(" to polish")))
        .otherwise("clean")
    )
    out = counts.join(first, "capability", "left").withColumns({"top_issue": F.coalesce("top_issue", F.lit("")), "clean_pct": half_even(percent(F.col("pass_count"), F.col("total"))).cast("long"), "headline": headline})
    return out.orderBy(F.desc("critical_count"), F.desc("moderate_count"), F.desc("minor_count"), "pass_count", "capability")


def critical_first(judged: DataFrame, k: int = 5) -> DataFrame:
    """The k worst queries: critical ones by displacement if there are three, else all that don't pass, worst first."""
    n = judged.where("severity = 'CRITICAL'").agg(F.count("*").alias("n_critical"))
    fit = F.when(F.col("n_critical") >= 3, F.col("severity") == "CRITICAL").otherwise(F.col("severity") != "PASS")
    worst = judged.join(F.broadcast(n)).where(fit)
    return worst.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("displacement"), "query_id").limit(k).select("query_id", "severity", "displacement")


def thin_results(judged: DataFrame, thin: int = 5) -> DataFrame:
    """How many queries got no or few results, and whether over half are thin."""
    few = F.sum(F.when(F.col("n_results") < thin, 1).otherwise(0))
    return judged.agg(F.count("*").alias("total"), F.sum(F.when(F.col("n_results") == 0, 1).otherwise(0)).alias("empty"), few.alias("thin"), (few > F.count("*") * 0.5).alias("warn"))
