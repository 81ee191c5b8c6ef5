"""Tables behind reports: grids, coverage, impact cells, ladders of ever narrower queries, and merged people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import query_terms
from ..sources.files import written
from .audit import SPECIFICITY_CATEGORIES
from .review import OVERLAP

# Labels of categories in the order of the coverage table.
COVERAGE_LABELS = {
    "DIRECT_MATCH": "Exact match",
    "BRAND_SEARCH": "Brand name",
    "BROAD_CATEGORY": "Broad category",
    "SYNONYM": "Synonym handling",
    "TYPO": "Typo tolerance",
    "SPECIAL_CHARACTER": "Diacritics / accents",
    "MERGED_WORDS": "Compound-word splitting",
    "SPLIT_WORD": "Split-word recovery",
    "PLURAL_SINGULAR": "Plural / singular",
    "ABBREVIATION": "Abbreviations (UA)",
    "MULTI_ATTRIBUTE": "Multi-attribute filters",
    "PARTIAL_QUERY": "Prefix / partial queries",
    "LOCALE_VARIATION": "Locale-specific terms",
}


def grid(judged: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """Passed and failed queries of each cell of a fixed grid, also of empty ones; ``judged``: line, col, ok."""
    spark = judged.sparkSession
    cells = spark.createDataFrame([(r, c) for r in rows for c in columns], "line string, col string")
    counts = judged.groupBy("line", "col").agg(F.count_if("ok").alias("p"), F.count_if(~F.col("ok")).alias("f"))
    return cells.join(counts, ["line", "col"], "left").select("line", "col", F.coalesce("p", F.lit(0)).alias("passed"), F.coalesce("f", F.lit(0)).alias("failed"))


def labelled_coverage(judged: DataFrame) -> DataFrame:
    """Passed share of each labelled category that has queries, with its place; ``judged``: category, ok."""
    labels = judged.sparkSession.createDataFrame([(c, label, i) for i, (c, label) in enumerate(COVERAGE_LABELS.items())], "category string, label string, place int")
    counts = judged.groupBy("category").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))
    return labels.join(counts, "category").select("place", "label", "category", "passed", "total", (F.col("passed") / F.col("total")).alias("rate"))


def impact_label(trust_delta: Column, reaction: Column) -> Column:
    """HELPFUL if what was advertised was opened, HARMFUL if trust fell by 0.3 or was damaged, else NEUTRAL."""
    return F.when(reaction == "CLICKED", "HELPFUL").when((reaction == "TRUST_DAMAGED") | (trust_delta <= -0.3), "HARMFUL").otherwise("NEUTRAL")


def impact_matrix(runs: DataFrame, personas: list[str], scenarios: list[str]) -> DataFrame:
    """A row per persona and a column per scenario with the label of its run, null where there was none."""
    every = runs.sparkSession.createDataFrame([(p,) for p in personas], "persona string")
    labelled = runs.select("persona", "scenario", impact_label(F.col("trust_delta"), F.col("reaction")).alias("impact"))
    return every.join(labelled.groupBy("persona").pivot("scenario", scenarios).agg(F.min("impact")), "persona", "left")


def planned_runs(personas: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each persona in each scenario; both are short fixed lists."""
    return personas.crossJoin(scenarios)


def fetched_by_category(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per category: queries, results fetched for them, and queries that got none."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    joined = queries.join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.groupBy("category").agg(F.count("*").alias("queries"), F.sum("n").alias("results"), F.count_if(F.col("n") == 0).alias("empty"))


def known_addresses(contacts: DataFrame) -> DataFrame:
    """How many other addresses are known at each contact's domain (id, domain, known), counted once per domain."""
    address = F.lower(F.trim("email"))
    domain = F.get(F.split(address, "@"), 1)
    own = contacts.select("id", F.when(F.contains(address, F.lit("@")), address).alias("address"), F.coalesce("domain", domain).alias("domain"))
    pool = own.where("address is not null").select("address", F.get(F.split("address", "@"), 1).alias("at")).distinct().groupBy("at").agg(F.count("*").alias("n"))
    mine = F.coalesce(F.get(F.split("address", "@"), 1) == F.col("domain"), F.lit(False)).cast("int")
    return own.join(pool, F.col("domain") == F.col("at"), "left").select("id", "domain", (F.coalesce("n", F.lit(0)) - mine).alias("known"))


def until_enough(tried: DataFrame, enough: int = 3) -> DataFrame:
    """Queries of each plan (plan_id, place from 0, hits, error) that are run: to the first but the very first with enough hits so far, or a limit error."""
    run = Window.partitionBy("plan_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("plan_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    limited = F.coalesce(F.contains("error", F.lit("429")) | F.contains("error", F.lit("402")), F.lit(False))
    stops = limited | ((F.sum(F.coalesce("hits", F.lit(0))).over(run) >= enough) & (F.col("place") >= 1))
    return tried.withColumn("stops", stops).withColumn("over", F.coalesce(F.max("stops").over(before), F.lit(False))).where(~F.col("over")).drop("stops", "over")


def adjusted(base: Column, remove: Column, add: Column, override: Column) -> Column:
    """An ordered list after removals and additions; an override that isn't empty takes its place."""
    changed = F.array_union(F.array_except(base, F.coalesce(remove, F.array().cast("array<string>"))), F.coalesce(add, F.array().cast("array<string>")))
    return F.when(F.size(F.coalesce(override, F.array().cast("array<string>"))) > 0, F.array_distinct(override)).otherwise(changed)


def ladders(queries: DataFrame, results: DataFrame, drop: float = 0.15) -> DataFrame:
    """Ladders of three or more ever narrower queries, with the first one whose top-3 average falls by more than ``drop``.

    From each query the ladder goes on to the first (fewest terms, then least id) query that has all
    its terms and more. That next one depends on the terms alone, so ladders are followed by joins
    over pointers, as many rounds as a ladder has rungs; each round is written to the shared folder,
    so its plan doesn't hold those before it. ``queries``: query_id, query, category.
    """
    asked = queries.where(F.col("category").isin(SPECIFICITY_CATEGORIES)).groupBy("query").agg(F.min("query_id").alias("query_id"))
    asked = asked.withColumn("terms", F.array_sort(query_terms(F.col("query")))).where(F.size("terms") > 0)
    each = asked.select("query_id", "query", "terms", F.explode("terms").alias("term"))
    held = each.groupBy("term").agg(F.count("*").alias("n"))
    sets = asked.select("terms").distinct()
    rarest = sets.select("terms", F.explode("terms").alias("term")).join(held, "term").groupBy("terms").agg(F.min(F.struct("n", "term")).alias("r")).select(F.col("terms").alias("below"), F.col("r.term").alias("term"))
    above = rarest.join(each, "term").where((F.size("below") < F.size("terms")) & (F.size(F.array_except("below", "terms")) == 0))
    step = above.groupBy("below").agg(F.min(F.struct(F.size("terms").alias("size"), "query_id", "query", "terms")).alias("s"))
    step = written(step.select("below", F.col("s.query").alias("next"), F.col("s.terms").alias("next_terms")), "steps")
    chains = asked.select(F.array("query").alias("queries"), "terms")
    rounds = []
    while True:
        gone = written(chains.join(step, chains.terms == step.below, "left").select("queries", "next", "next_terms"), "chains")
        rounds.append(gone.where("next is null").select("queries"))
        chains = gone.where("next is not null").select(F.concat("queries", F.array("next")).alias("queries"), F.col("next_terms").alias("terms"))
        if chains.isEmpty():  # a ladder has at most as many rungs as a query has terms
            break
    ended = reduce(DataFrame.unionByName, rounds).where(F.size("queries") >= 3).distinct()
    top = results.where("original_rank <= 3").groupBy("query_id").agg(F.avg("relevance_score").alias("top3"))
    scores = asked.join(top, "query_id", "left").select("query", F.coalesce("top3", F.lit(0.0)).alias("top3"))
    rungs = ended.select("queries", F.posexplode("queries").alias("rung", "query")).join(scores, "query")
    before = F.lag("top3").over(Window.partitionBy("queries").orderBy("rung"))
    breaks = rungs.withColumn("before", before).groupBy("queries").agg(F.min_by("query", F.when(F.col("top3") + drop < F.col("before"), F.col("rung"))).alias("break_query"))
    return breaks.select("queries", F.size("queries").alias("rungs"), F.coalesce("break_query", F.lit("")).alias("break_query"))


CLUSTERS = "row_key string, role string, place int, primary_name string, link string, base_score int, n_search int, n_website int, n_links int"


def merged_people(candidates: DataFrame, people: DataFrame, links: DataFrame) -> DataFrame:
    """People found for a role, those with alike names merged in the order in which they were found.

    ``candidates`` of searches: row_key, role, ord, full_name, link, rank_score. ``people`` of the
    company's site: row_key, role, ord, full_name, hints (roles). ``links``: row_key, role, url. A person
    of the site supports the first person with an alike name, and else comes as one only with a hint
    of the role. What is first depends on order, so the people of one company and role, a small
    group, are folded in one task.
    """
    import pandas as pd

    def key(name: str) -> str:
        return " ".join(name.split()).lower()

    def same(a: str, b: str) -> bool:
        x, y = set(key(a).split(" ")), set(key(b).split(" "))
        return key(a) == key(b) or sum(len(w) > 1 for w in x & y) / min(len(x), len(y)) >= OVERLAP

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        role = rows["role"].iloc[0]

        def first(name: str, exact: bool) -> dict | None:
            hits = [c for c in found if exact and key(c["primary_name"]) == key(name)] or [c for c in found if same(name, c["primary_name"])]
            return hits[0] if hits else None

        for r in rows.sort_values(["kind", "ord"], kind="stable").itertuples():
            if r.kind == 2:
                for c in found:
                    if c["link"] == r.link:
                        c["n_links"] += 1
                        break
                continue
            if r.full_name is None or len(r.full_name.strip()) < 3:
                continue
            own = first(r.full_name, r.kind == 0)
            if own is None and (r.kind == 0 or role in list(r.hints if r.hints is not None else [])):
                own = {"row_key": r.row_key, "role": role, "place": len(found), "primary_name": r.full_name, "link": r.link or "", "base_score": 0, "n_search": 0, "n_website": 0, "n_links": 0}
                found.append(own)
            if own is not None and r.kind == 0:
                own["n_search"] += 1
                own["link"] = own["link"] or r.link or ""
                own["base_score"] = max(own["base_score"], int(r.rank_score))
            elif own is not None:
                own["n_website"] += 1
        return pd.DataFrame(found, columns=[c.split()[0] for c in CLUSTERS.split(", ")])

    none = lambda kind: F.lit(None).cast(kind)
    text = lambda c: F.col(c).cast("string").alias(c)
    every = candidates.select(text("row_key"), text("role"), F.lit(0).alias("kind"), F.col("ord").cast("long").alias("ord"), "full_name", "link", F.coalesce(F.col("rank_score").cast("int"), F.lit(0)).alias("rank_score"), none("array<string>").alias("hints"))
    every = every.unionByName(people.select(text("row_key"), text("role"), F.lit(1).alias("kind"), F.col("ord").cast("long").alias("ord"), "full_name", none("string").alias("link"), F.lit(0).alias("rank_score"), "hints"))
    every = every.unionByName(links.select(text("row_key"), text("role"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("ord"), none("string").alias("full_name"), F.col("url").alias("link"), F.lit(0).alias("rank_score"), none("array<string>").alias("hints")))
    return every.groupBy("row_key", "role").applyInPandas(folded, CLUSTERS)


# Categories of queries that a kind of site is tested with, in order.
SITE_CATEGORIES = {
    "PHYSICAL_GOODS": ["DIRECT_MATCH", "TYPO", "SYNONYM", "MERGED_WORDS", "SPLIT_WORD", "BRAND_SEARCH", "SKU_MODEL_NUMBER", "PLURAL_SINGULAR", "MULTI_ATTRIBUTE", "ABBREVIATION", "SPECIAL_CHARACTER", "PARTIAL_QUERY"],
    "SERVICES_EXPERIENCES": ["BROAD_CATEGORY", "NATURAL_LANGUAGE", "USE_CASE", "SUBJECTIVE_ATTRIBUTE", "SEASONAL_OCCASION", "TYPO", "SYNONYM", "STOP_WORD_HEAVY", "NEGATIVE_INTENT", "CATEGORY_MAPPING", "FACET_EXTRACTION", "SEMANTIC_MEANING"],
    "MARKETPLACE_MIXED": ["DIRECT_MATCH", "BROAD_CATEGORY", "TYPO", "SYNONYM", "BRAND_SEARCH", "NATURAL_LANGUAGE", "USE_CASE", "CATEGORY_MAPPING", "FACET_EXTRACTION", "NEGATIVE_INTENT", "MULTI_ATTRIBUTE", "PLURAL_SINGULAR", "PARTIAL_QUERY", "SUBJECTIVE_ATTRIBUTE"],
}


def site_categories(site_type: Column) -> Column:
    """The categories of a kind of site in order; those of a mixed one if the kind isn't known."""
    known = F.create_map(*[x for kind, names in SITE_CATEGORIES.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    return F.coalesce(F.element_at(known, site_type), F.element_at(known, F.lit("MARKETPLACE_MIXED")))


def filled_in_two_phases(roles: DataFrame, by_name: DataFrame, by_domain: DataFrame) -> DataFrame:
    """Roles (row_key, role, name, email) with addresses found by name, and what is still missing from the domain's best entries.

    ``by_name``: row_key, role, found. ``by_domain``: row_key, role, entry, entry_name. An address that
    is there stays; a name is filled only where there is none and only from the domain.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    both = roles.join(by_name, ["row_key", "role"], "left").join(by_domain, ["row_key", "role"], "left")
    first = F.when(~blank(F.col("name")), F.col("found"))
    source = F.when(~blank(F.col("email")), "kept").when(first.isNotNull(), "name").when(F.col("entry").isNotNull(), "domain").otherwise("missing")
    email = F.when(source == "kept", F.col("email")).when(source == "name", first).when(source == "domain", F.col("entry"))
    name = F.when((source == "domain") & blank(F.col("name")), F.col("entry_name")).otherwise(F.col("name"))
    return both.select("row_key", "role", name.alias("name"), email.alias("email"), source.alias("source"))


def ensured(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with null columns for those that are missing; none is taken away."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})


# Kinds of goods that a title may name.
THEME_TERMS = [
    "shoe", "shoes", "sneaker", "sneakers", "short", "shorts", "shirt", "shirts", "pant", "pants", "chino", "chinos", "dress", "dresses",
    "jacket", "jackets", "boot", "boots", "bag", "bags", "backpack", "backpacks", "deal", "deals", "restaurant", "restaurants", "spa", "massage", "fitness", "class", "classes",
]


def title_themes(judged: DataFrame, terms: list[str] = THEME_TERMS, most: int = 3) -> DataFrame:
    """One row: ``themes`` (at most ``most``) of a report's title and ``title``, from the queries that failed.

    ``judged``: query_id, query, category, severity, failure_mode, displacement. In order: the worst query of up to three
    words that missed its category, brands, the ``terms`` of four letters or more that most failing queries name (ties to
    the worst query's), then shopping context, attribute filters and, if there is nothing else, ranking. Only
    counts and minima meet in one row.
    """
    failing = judged.where("severity in ('CRITICAL', 'MODERATE')")
    worst = F.struct(F.when(F.col("severity") == "CRITICAL", 0).otherwise(1).alias("s"), (-F.col("displacement")).alias("d"), F.col("query_id").alias("q"))
    query = F.lower(F.trim("query"))
    short = (F.col("failure_mode") == "CATEGORY_MAPPING_FAILURE") & (F.size(F.split(query, r"\s+")) <= 3)
    has = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    mode = F.col("failure_mode")
    one = failing.agg(
        F.min_by(F.when(short, query), F.when(short, worst)).alias("missed"), has(mode.isin("BRAND_BLEED", "NO_FUZZY_MATCHING") | (F.col("category") == "BRAND_SEARCH")).alias("brand"), has(mode == "NO_SEMANTIC_UNDERSTANDING").alias("context"),
        has(mode.isin("CONSTRAINT_DROPPED", "FACET_NOT_EXTRACTED", "BRAND_BLEED")).alias("filters"), has(mode == "POOR_RANKING").alias("ranking"))
    words = failing.select(worst.alias("w"), F.posexplode(F.regexp_extract_all(query, F.lit("([a-z][a-z0-9'-]*)"), F.lit(1))).alias("p", "term"))
    known = words.where(F.col("term").isin(terms) & (F.length("term") >= 4)).groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("w", "p")).alias("first"))
    top = known.orderBy(F.desc("n"), "first").limit(most).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "term"))).alias("t"))
    both = one.withColumn("_1", F.lit(1)).join(top.withColumn("_1", F.lit(1)), "_1")
    start = F.filter(F.concat(F.array(F.nullif("missed", F.lit("")), F.when(F.col("brand"), "brand")), F.transform("t", lambda t: t["term"])), lambda t: t.isNotNull())
    first = lambda a: F.slice(F.array_distinct(a), 1, most)
    more = lambda a, cond, theme: F.when((F.size(a) < most) & cond, first(F.concat(a, F.array(F.lit(theme))))).otherwise(a)
    both = both.withColumn("themes", first(start)).withColumn("themes", more(F.col("themes"), F.col("context"), "shopping context")).withColumn("themes", more(F.col("themes"), F.col("filters"), "attribute filters"))
    both = both.withColumn("themes", more(F.col("themes"), (F.size("themes") == 0) & F.col("ranking"), "ranking"))
    n = F.size("themes")
    joined = F.when(n < 3, F.array_join("themes", " and ")).otherwise(F.concat(F.array_join(F.slice("themes", F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get("themes", n - 1)))
    return both.select("themes", joined.alias("title"))
