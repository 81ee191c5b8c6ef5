"""Named queries on search audits, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import COLOR_WORDS, STOPWORDS, VARIANT_WORDS, family_key, phrases, query_terms
from ..operators import audit
from ..sources.views import CAPABILITIES, CATEGORIES, Views

_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
_CAPS = ", ".join(f"('{c}', '{cap}')" for cap, cats in CAPABILITIES.items() for c in cats)
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _terms(q: str) -> str:
    """Ordered distinct terms of a SQL expression."""
    words = f"list_transform(regexp_extract_all(lower({q}), '[a-z0-9]+'), lambda w: CASE WHEN len(w) > 4 THEN regexp_replace(w, 's+$', '') ELSE w END)"
    kept = f"list_filter({words}, lambda w: NOT list_contains({_STOP}, w) AND len(w) >= 2)"
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


def _family(t: str) -> str:
    drop = "[" + ", ".join(f"'{w}'" for w in COLOR_WORDS + VARIANT_WORDS) + "]"
    key = f"regexp_replace(regexp_replace(lower({t}), '\\b\\d+(?:\\.\\d+)?\\b', ' ', 'g'), '[^a-z0-9\\s-]', ' ', 'g')"
    words = f"list_filter(regexp_split_to_array({key}, '\\s+'), lambda w: w <> '' AND NOT list_contains({drop}, w))"
    return f"trim(array_to_string(list_transform({words}, lambda w: CASE WHEN len(w) > 4 THEN regexp_replace(w, 's+$', '') ELSE w END), ' '))"


def _phrases(q: str) -> str:
    """Pairs of neighbouring words and words, distinct, longest key first, ties in order."""
    words = f"list_filter(regexp_split_to_array(lower({q}), '[^a-z0-9]+'), lambda w: len(w) >= 3 AND NOT list_contains({_STOP}, w))"
    key = lambda p: f"regexp_replace({p}, '[^a-z0-9]', '', 'g')"
    every = f"list_concat(list_transform(list_zip(({words})[:-2], ({words})[2:]), lambda z: z[1] || ' ' || z[2]), {words})"
    kept = f"list_filter(list_filter({every}, lambda p, i: list_position({every}, p) = i), lambda p: len({key('p')}) >= 5)"
    ranked = f"list_sort(list_transform({kept}, lambda p, i: {{'n': -len({key('p')}), 'i': i, 'p': p}}))"
    return f"list_transform({ranked}, lambda s: s.p)"


WITH = f"""WITH caps(category, capability) AS (VALUES {_CAPS}),
queries AS (
  SELECT o_orderkey AS query_id, p_name || ' ' || lower(p_type) AS query, c.category, c.capability
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
  JOIN caps c ON c.category = ({_LIST})[CAST(o_orderkey % 26 AS INT) + 1]),
scored AS (
  SELECT l_orderkey AS query_id, p_name AS title,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS original_rank,
         l_discount * 10 AS relevance_score
  FROM lineitem JOIN part ON l_partkey = p_partkey),
best AS (
  SELECT query_id, count(*) AS n, max(relevance_score) AS mx, avg(relevance_score) FILTER (original_rank <= 3) AS t3,
         max(relevance_score) FILTER (original_rank = 1) AS ts, max(title) FILTER (original_rank = 1) AS tt
  FROM scored GROUP BY 1),
first AS (
  SELECT s.query_id, min(original_rank) AS r FROM scored s JOIN best b ON b.query_id = s.query_id AND s.relevance_score = b.mx GROUP BY 1),
stats AS (
  SELECT q.*, coalesce(n, 0) AS n_results, coalesce(mx, 0.0) AS max_relevance, coalesce(t3, 0.0) AS top3_avg,
         CAST(coalesce(r - 1, 15) AS INT) AS displacement, ts AS top_score, tt AS top_title
  FROM queries q LEFT JOIN best b USING (query_id) LEFT JOIN first f USING (query_id)),
judged AS (
  SELECT *, CASE WHEN max_relevance < 0.25 THEN 'CRITICAL' WHEN displacement > 6 THEN 'CRITICAL' WHEN displacement > 2 THEN 'MODERATE' ELSE 'PASS' END AS severity,
         CASE WHEN max_relevance < 0.25 THEN 'ZERO_RESULTS_OR_GARBAGE' WHEN displacement > 2 THEN 'POOR_RANKING' ELSE 'OTHER' END AS failure_mode
  FROM stats)
"""
_COUNTS = "count(*) FILTER (severity='CRITICAL') AS critical_count, count(*) FILTER (severity='MODERATE') AS moderate_count, count(*) FILTER (severity='MINOR') AS minor_count, count(*) FILTER (severity='PASS') AS pass_count"
_PURITY = "purity AS (SELECT query_id, " + ", ".join(f"count(*) FILTER (original_rank <= {k} AND relevance_score >= 0.6) AS top{k}_relevant, count(*) FILTER (original_rank <= {k}) AS top{k}_total" for k in (3, 5, 10)) + " FROM scored GROUP BY 1)"
_TRUST = """trust AS (SELECT query_id, query, coalesce(top_title, 'No results') AS top_result, coalesce(top_score, 0.0) AS top_score, max_relevance AS best_score,
  CASE WHEN n_results = 0 THEN 'No visible result was available.' WHEN top_score < 0.4 THEN 'The first result is weakly related to the query.'
       WHEN top_score < 0.6 THEN 'The first result is only a partial answer.'
       WHEN max_relevance - top_score >= 0.2 AND displacement > 2 THEN 'A much stronger result appears lower in the list.' END AS reason FROM judged)"""
_DRIFT = f"""drift AS (
  SELECT query_id, term, CAST(len(list_filter(titles, lambda t: contains(t, term))) AS INT) AS hits, CAST(len(titles) AS INT) AS shown,
    CASE WHEN len(titles) > 0 AND len(list_filter(titles, lambda t: contains(t, term))) >= greatest(3, len(titles) // 2 + 1) THEN 'preserved'
         WHEN len(list_filter(titles, lambda t: contains(t, term))) > 0 THEN 'partial' ELSE 'dropped' END AS state
  FROM (SELECT q.query_id, unnest(q.terms) AS term, coalesce(s.titles, []) AS titles FROM
    (SELECT query_id, {_terms('query')} AS terms FROM queries WHERE category IN {tuple(audit.ATTRIBUTE_CATEGORIES)}) q
    LEFT JOIN (SELECT query_id, list(lower(title)) AS titles FROM scored WHERE original_rank <= 5 GROUP BY 1) s USING (query_id)
    WHERE len(q.terms) >= 2))"""


def _judged(v: Views):
    return audit.judge(audit.query_stats(v.queries(), v.scored()))


def _r(df, *cols):
    """Doubles rounded to six digits, as sums may come in another order."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _six(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


_STOCK = (
    WITH
    + f""", asked AS (SELECT query_id, query, unnest(l) AS phrase, unnest(range(len(l))) AS pos FROM (SELECT query_id, query, {_phrases('query')} AS l FROM judged WHERE n_results = 0)),
    titles AS (SELECT title, unnest({_phrases('title')}) AS p FROM (SELECT DISTINCT title FROM scored)),
    held AS (SELECT regexp_replace(p, '[^a-z0-9]', '', 'g') AS needle, query_id AS other_id, arg_min(title, original_rank) AS example_title FROM scored JOIN titles USING (title) GROUP BY 1, 2),
    rare AS (SELECT needle FROM held GROUP BY 1 HAVING count(*) <= 6),
    hit AS (SELECT a.query_id, a.query, o.query AS working_variant, example_title, row_number() OVER (PARTITION BY a.query_id ORDER BY pos, len(o.query), other_id) AS n
      FROM asked a JOIN held h ON h.needle = regexp_replace(a.phrase, '[^a-z0-9]', '', 'g') JOIN judged o ON o.query_id = other_id
      WHERE h.needle IN (SELECT needle FROM rare) AND o.query <> a.query AND contains(regexp_replace(lower(o.query), '[^a-z0-9]', '', 'g'), h.needle))
    SELECT query_id, query, working_variant, example_title FROM hit WHERE n = 1"""
)

CATALOGUE = {
    "query_stats": (lambda v: _r(audit.query_stats(v.queries(), v.scored()), "top3_avg"), WITH + f"SELECT * EXCLUDE (top3_avg), {_six('top3_avg')} FROM stats"),
    "severity_fallback": (lambda v: _judged(v).select("query_id", "severity", "failure_mode"), WITH + "SELECT query_id, severity, failure_mode FROM judged"),
    "capability_rollup": (
        lambda v: audit.capability_rollup(_judged(v)),
        WITH + "SELECT *, (['PASS','MINOR','MODERATE','CRITICAL'])[severity_rank + 1] AS severity FROM (SELECT capability, CAST(max(list_position(['PASS','MINOR','MODERATE','CRITICAL'], severity) - 1) AS INT) AS severity_rank, count(*) AS total, count(*) FILTER (severity <> 'PASS') AS non_pass FROM judged GROUP BY 1)",
    ),
    "aggregate_stats": (
        lambda v: _r(audit.aggregate_stats(_judged(v)), "pct_top3_irrelevant", "avg_best_position", "pct_top1_irrelevant"),
        WITH
        + f"""SELECT count(*) AS total_queries, {_COUNTS},
        round(100.0 * count(*) FILTER (n_results > 0 AND displacement > 2) / count(*) FILTER (n_results > 0), 6) AS pct_top3_irrelevant,
        round(sum(displacement + 1) FILTER (n_results > 0) / count(*) FILTER (n_results > 0), 6) AS avg_best_position,
        round(100.0 * count(*) FILTER (n_results > 0 AND top_score < 0.4) / count(*) FILTER (n_results > 0), 6) AS pct_top1_irrelevant,
        (SELECT query FROM judged WHERE n_results > 0 AND top_score < 0.4 ORDER BY displacement DESC, query_id LIMIT 1) AS worst_example_query,
        (SELECT displacement FROM judged WHERE n_results > 0 AND top_score < 0.4 ORDER BY displacement DESC, query_id LIMIT 1) AS worst_example_displacement
        FROM judged""",
    ),
    "failure_modes": (lambda v: audit.failure_modes(_judged(v)), WITH + "SELECT failure_mode, count(*) AS count FROM judged WHERE severity <> 'PASS' GROUP BY 1"),
    "rerank": (lambda v: audit.rerank(v.scored()), WITH + "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, original_rank) AS INT) AS rank FROM scored"),
    "topk_original": (lambda v: audit.top_original(v.scored(), 3).drop("place"), WITH + "SELECT * FROM scored WHERE original_rank <= 3"),
    "purity_at_k": (
        lambda v: _r(audit.purity_totals(audit.purity(v.scored())), "top3", "top5", "top10"),
        WITH + f", {_PURITY} SELECT " + ", ".join(f"round(100.0 * sum(top{k}_relevant) / sum(top{k}_total), 6) AS top{k}" for k in (3, 5, 10)) + " FROM purity",
    ),
    "polluted_queries": (
        lambda v: _r(audit.purity(v.scored()).orderBy("top5_purity", "top3_purity", "query_id").limit(5), "top3_purity", "top5_purity", "top10_purity"),
        WITH + f", {_PURITY} SELECT *, " + ", ".join(f"round(100.0 * top{k}_relevant / top{k}_total, 6) AS top{k}_purity" for k in (3, 5, 10)) + " FROM purity ORDER BY 100.0 * top5_relevant / top5_total, 100.0 * top3_relevant / top3_total, query_id LIMIT 5",
    ),
    "top_result_trust": (lambda v: audit.top_result_trust(_judged(v)), WITH + f", {_TRUST} SELECT * FROM trust"),
    "trust_failure_rate": (lambda v: _r(audit.trust_rate(audit.top_result_trust(_judged(v))), "failure_rate"), WITH + f", {_TRUST} SELECT count(reason) AS failed, count(*) AS total, round(100.0 * count(reason) / count(*), 6) AS failure_rate FROM trust"),
    "trust_worst": (lambda v: audit.top_result_trust(_judged(v)).where("reason is not null").orderBy("top_score", F.desc("best_score"), "query_id").limit(5), WITH + f", {_TRUST} SELECT * FROM trust WHERE reason IS NOT NULL ORDER BY top_score, best_score DESC, query_id LIMIT 5"),
    "attribute_drift": (lambda v: audit.attribute_drift(v.queries(), v.scored()), WITH + f", {_DRIFT} SELECT * FROM drift"),
    "attribute_coverage": (
        lambda v: _r(audit.attribute_coverage(audit.attribute_drift(v.queries(), v.scored())), "coverage"),
        WITH + f", {_DRIFT} SELECT query_id, round(100.0 * sum(CASE state WHEN 'preserved' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) / count(*), 6) AS coverage, count(*) FILTER (state = 'dropped') AS dropped FROM drift GROUP BY 1",
    ),
    "common_dropped": (lambda v: audit.common_dropped(audit.attribute_drift(v.queries(), v.scored())), WITH + f", {_DRIFT} SELECT term, count(*) AS count FROM drift WHERE state = 'dropped' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"),
    "diversity": (
        lambda v: _r(audit.diversity(v.queries(), v.scored()), "diversity_rate"),
        WITH
        + f""" SELECT query_id, u AS unique_families, n AS result_count, n - u AS duplicate_count, round(CASE WHEN n > 0 THEN 100.0 * u / n ELSE 0 END, 6) AS diversity_rate FROM (
        SELECT query_id, count(DISTINCT f) AS u, count(f) AS n, count(*) AS c FROM (SELECT query_id, nullif({_family('title')}, '') AS f FROM scored WHERE original_rank <= 10) GROUP BY 1)
        JOIN queries USING (query_id) WHERE c >= 5 AND category IN {tuple(audit.DIVERSITY_CATEGORIES)}""",
    ),
    "specificity_pairs": (
        lambda v: audit.specificity_pairs(v.queries()),
        WITH
        + f""", t AS (SELECT DISTINCT query, {_terms('query')} AS terms FROM queries WHERE category IN {tuple(audit.SPECIFICITY_CATEGORIES)})
        SELECT a.query AS broad, b.query AS narrow, CAST(len(a.terms) AS INT) AS broad_size, CAST(len(b.terms) AS INT) AS narrow_size FROM t a JOIN t b
        ON len(a.terms) > 0 AND len(a.terms) < len(b.terms) AND list_has_all(b.terms, a.terms)""",
    ),
    "worst_example": (
        lambda v: audit.worst_example(_judged(v)),
        WITH
        + f"""SELECT query_id, tier, sentence FROM (SELECT query_id, CAST(CASE WHEN n_results = 0 AND category IN {tuple(audit.HIGH_INTENT_CATEGORIES)} THEN 2 WHEN n_results = 0 THEN 3
          WHEN top_score < 0.6 THEN 4 WHEN displacement > 2 AND max_relevance - top_score >= 0.15 THEN 5 END AS INT) AS tier,
          CASE WHEN n_results = 0 THEN len(query) WHEN top_score < 0.6 THEN -top_score ELSE -(displacement + 1) END AS key,
          CASE WHEN n_results = 0 THEN 'A customer searching "' || query || '" gets zero results — a blank page, nothing at all.'
               WHEN top_score < 0.6 THEN 'A customer searching "' || query || '" sees "' || top_title || '" at the #1 spot — not what they asked for.'
               ELSE 'A customer searching "' || query || '" has to scroll to position ' || (displacement + 1) || ' to reach the best-matching product — below ' || displacement || ' weaker results.' END AS sentence
          FROM judged) WHERE tier IS NOT NULL ORDER BY tier, key, query_id LIMIT 1""",
    ),
    "top3_miss": (lambda v: _r(audit.top3_miss(_judged(v)), "with_results", "all_queries"), WITH + "SELECT round(100.0 * count(*) FILTER (n_results > 0 AND displacement > 2) / count(*) FILTER (n_results > 0), 6) AS with_results, round(100.0 * count(*) FILTER (displacement > 2) / count(*), 6) AS all_queries FROM judged"),
    "quality_score": (
        lambda v: _r(audit.quality_score(_judged(v), v.scored()), "trust", "find_at_3", "purity_at_3"),
        WITH
        + f""", {_TRUST}, {_PURITY}, one AS (SELECT (SELECT 100 - 100.0 * count(reason) / count(*) FROM trust) AS trust,
        (SELECT 100 - 100.0 * count(*) FILTER (n_results > 0 AND displacement > 2) / count(*) FILTER (n_results > 0) FROM judged) AS find_at_3,
        (SELECT 100.0 * sum(top3_relevant) / sum(top3_total) FROM purity) AS purity_at_3)
        SELECT round(trust, 6) AS trust, round(find_at_3, 6) AS find_at_3, round(purity_at_3, 6) AS purity_at_3, CAST(floor(0.45 * trust + 0.35 * find_at_3 + 0.2 * purity_at_3 + 0.5) AS BIGINT) AS score FROM one""",
    ),
    "crm_variables": (
        lambda v: audit.crm_variables(_judged(v)),
        WITH + f"SELECT count(*) AS total, {_COUNTS}, CAST(floor(100.0 * count(*) FILTER (displacement > 2) / count(*) + 0.5) AS BIGINT) AS outside_top3_rate, CAST(floor(100.0 * count(*) FILTER (n_results = 0) / count(*) + 0.5) AS BIGINT) AS zero_result_rate FROM judged",
    ),
    "sales_context": (
        lambda v: audit.sales_context(_judged(v)),
        WITH + "SELECT count(*) AS total_queries, round_even(avg(displacement + 1), 1) AS avg_best_position, CAST(round_even(100.0 * count(*) FILTER (displacement > 2) / count(*), 0) AS BIGINT) AS pct_outside_top3, CAST(round_even(100.0 * count(*) FILTER (failure_mode = 'POOR_RANKING') / count(*), 0) AS BIGINT) AS pct_ranking_failure FROM judged",
    ),
    "coverage_by_category": (
        lambda v: _r(audit.coverage(_judged(v)), "pass_rate"),
        WITH + f"SELECT *, round(100.0 * pass_count / total, 6) AS pass_rate, CASE WHEN critical_count > 0 THEN 'gap' WHEN moderate_count > 0 THEN 'mixed' WHEN minor_count > 0 THEN 'developing' ELSE 'good' END AS class FROM (SELECT capability, category, count(*) AS total, {_COUNTS} FROM judged GROUP BY 1, 2)",
    ),
    "improvement_map": (
        lambda v: audit.improvement_map(_judged(v)),
        WITH
        + f""", c AS (SELECT capability, count(*) AS total, {_COUNTS} FROM judged GROUP BY 1),
        m AS (SELECT capability, failure_mode, row_number() OVER (PARTITION BY capability ORDER BY count(*) DESC, failure_mode) AS n FROM judged WHERE severity <> 'PASS' GROUP BY 1, 2)
        SELECT c.*, coalesce(m.failure_mode, '') AS top_issue, CAST(round_even(100.0 * pass_count / total, 0) AS BIGINT) AS clean_pct,
        CASE WHEN critical_count > 0 THEN critical_count || ' at risk' WHEN moderate_count > 0 THEN moderate_count || ' friction' WHEN minor_count > 0 THEN minor_count || ' to polish' ELSE 'clean' END AS headline
        FROM c LEFT JOIN m ON m.capability = c.capability AND m.n = 1""",
    ),
    "critical_first": (
        lambda v: audit.critical_first(_judged(v)),
        WITH + "SELECT query_id, severity, displacement FROM judged WHERE CASE WHEN (SELECT count(*) FROM judged WHERE severity = 'CRITICAL') >= 3 THEN severity = 'CRITICAL' ELSE severity <> 'PASS' END ORDER BY list_position(['PASS','MINOR','MODERATE','CRITICAL'], severity) DESC, displacement DESC, query_id LIMIT 5",
    ),
    "thin_results": (lambda v: audit.thin_results(_judged(v)), WITH + "SELECT count(*) AS total, count(*) FILTER (n_results = 0) AS empty, count(*) FILTER (n_results < 5) AS thin, count(*) FILTER (n_results < 5) > count(*) * 0.5 AS warn FROM judged"),
    "query_terms": (lambda v: v.queries().select("query_id", F.array_join(query_terms(F.col("query")), " ").alias("terms")), WITH + f"SELECT query_id, array_to_string({_terms('query')}, ' ') AS terms FROM queries"),
    "family_keys": (lambda v: v.table("part").select("p_partkey", family_key(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"))).alias("family")), f"SELECT p_partkey, {_family(chr(112) + '_name || chr(32) || p_brand || chr(32) || p_size')} AS family FROM part"),
    "proof_of_stock": (lambda v: audit.proof_of_stock(_judged(v), v.scored()), _STOCK),
    "query_phrases": (lambda v: v.queries().select("query_id", F.array_join(phrases(F.col("query")), "; ").alias("phrases")), WITH + f"SELECT query_id, array_to_string({_phrases('query')}, '; ') AS phrases FROM queries"),
}
