"""Search addresses as templates, and plans of fixes written as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.nodes import let

# Names of parameters with the search term, likeliest first, and of those that page through results.
SEARCH_NAMES = ["q", "query", "search", "keyword", "k", "term", "s", "text", "searchterm", "searchQuery", "sw"]
PAGE_NAMES = ["page", "p", "offset", "start", "from", "pg", "pn", "pagenum"]
# Ids of databases, which are no terms.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX = r"(?i)^[0-9a-f]{24,}$"
# How a roadmap's items are written, and classes of impact and effort.
ITEM = r"\n(?=\d+\.\s+\*\*)"
IMPACTS = {"Critical": "critical", "High": "high", "Moderate": "moderate"}
EFFORTS = {"Medium": "medium", "Major": "major"}
# Titles that name nothing to be done, signals that make a title concrete, and what stands instead.
VAGUE = ["relevance", "ranking algorithm", "sort order", "re-rank", "rerank"]
INTENTS = ["intent", "boost", "price", "brand", "bestseller", "best seller", "sale", "product-type", "product type", "filter", "negative", "facet", "constraint", "synonym", "typo", "fuzzy"]
INSTEAD = "Add an intent & boost layer before keyword ranking (brand, product-type, price, and bestseller signals)"


def is_term(value: Column) -> Column:
    """Whether a value looks like something that was typed: up to 120 characters with a letter, no id."""
    return (value != "") & (F.length(value) <= 120) & value.rlike(r"\p{L}") & ~value.rlike(UUID) & ~value.rlike(HEX)


def _quoted(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def parameters(url: Column) -> Column:
    """(name, value) of an address's parameters, decoded, each name with its first value, in order; what can't be decoded stays as it is."""
    plain = lambda t: F.coalesce(F.try_url_decode(t), F.replace(t, F.lit("+"), F.lit(" ")))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(plain(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("name"), plain(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))
    return let(pairs, lambda ps: F.transform(F.array_distinct(F.transform(ps, lambda p: p["name"])), lambda n: F.get(F.filter(ps, lambda p: p["name"] == n), 0)))


def search_template(url: Column) -> Column:
    """(template, term, param, turn) of a search address, null if no parameter holds a term.

    In turn: a parameter with a known name, likeliest first; with a known name in any case; the first whose
    value looks typed. The template has ``{}`` for the term and goes without parameters that page through results.
    """
    base = F.concat(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1))
    named = lambda ps, key: F.transform(F.array(*map(F.lit, SEARCH_NAMES)), lambda n: F.try_element_at(F.filter(ps, lambda p: key(p["name"]) == n), F.lit(-1)))
    usable = lambda found: F.get(F.filter(found, lambda p: p.isNotNull() & (p["value"] != "")), 0)

    def template(ps: Column, hit: Column) -> Column:
        kept = F.filter(ps, lambda p: ~F.lower(p["name"]).isin(PAGE_NAMES))
        parts = F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), F.when(p["name"] == hit["name"], "{}").otherwise(_quoted(p["value"])))), "&")
        return F.concat(base, F.when(parts != "", F.concat(F.lit("?"), parts)).otherwise(""))

    def chosen(ps: Column) -> Column:
        turns = [usable(named(ps, lambda n: n)), usable(named(ps, F.lower)), F.get(F.filter(ps, lambda p: is_term(p["value"])), 0)]
        each = F.array(*[F.when(hit.isNotNull(), F.struct(hit.alias("hit"), F.lit(i).alias("turn"))) for i, hit in enumerate(turns, 1)])
        out = lambda h: F.when(h.isNotNull(), F.struct(template(ps, h["hit"]).alias("template"), h["hit"]["value"].alias("term"), h["hit"]["name"].alias("param"), h["turn"].alias("turn")))
        return let(F.get(F.filter(each, lambda h: h.isNotNull()), 0), out)

    return let(parameters(url), chosen)


def site_templates(addresses: DataFrame, url: str = "url") -> DataFrame:
    """One row per host: ``template``, ``term``, ``param``, ``turn`` and ``votes``.

    Every search address of a host votes for its template; the earliest turn wins, then the most
    votes, then the first template by name. The term is the first by name that was seen with it.
    Addresses without a host or term, and null ones, don't vote.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    each = addresses.select(host.alias("host"), search_template(F.col(url)).alias("s")).where("s is not null and host <> ''")
    votes = each.groupBy("host", "s.template", "s.param", "s.turn").agg(F.count("*").alias("votes"), F.min("s.term").alias("term"))
    best = votes.groupBy("host").agg(F.min(F.struct("turn", -F.col("votes"), "template", "param", "term", "votes")).alias("b"))
    return best.select("host", "b.template", "b.term", "b.param", "b.turn", "b.votes")


def is_vague(title: Column) -> Column:
    """Titles that speak of relevance or of ranking as such, without a signal that ranking would use."""
    has = lambda low, words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return let(F.lower(title), lambda low: has(low, VAGUE) | (F.contains(low, F.lit("ranking")) & ~has(low, INTENTS)))


def roadmap_items(text: Column) -> Column:
    """(title, description, impact, effort, impact_class, effort_class) of the numbered items of a roadmap, in order.

    An item starts at a line with a number and a bold title; what stands before the first is an item
    of its own, titled by its first bold text or its first 80 characters. Impact and effort are read wherever the
    item names them and leave the description. Vague titles are replaced. Null has no items, nor has an empty text.
    """
    strip = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    first = lambda t, pattern: F.regexp_extract(t, pattern, 1)
    classed = lambda t, names, other, whole: F.coalesce(*[F.when(t == k if whole else F.contains(t, F.lit(k)), v) for k, v in names.items()], F.lit(other))

    def item(chunk: Column) -> Column:
        bold = first(chunk, r"\*\*(.+?)\*\*")
        title = let(bold, lambda b: F.when(b != "", b).otherwise(F.left(chunk, F.lit(80))))
        rest = strip(F.regexp_replace(chunk, r"(?U)^\d+\.\s+\*\*.+?\*\*\s*", ""))
        about = strip(F.regexp_replace(rest, r"(?mU)\s*Impact:.*$", ""))
        impact, effort = first(chunk, r"(?U)Impact:\s*(\w+)"), strip(first(chunk, r"(?U)Effort:\s*(.+?)(?:\n|$)"))
        told = lambda i, e: F.struct(let(title, lambda t: F.when(is_vague(t), INSTEAD).otherwise(t)).alias("title"), about.alias("description"), i.alias("impact"), e.alias("effort"), classed(i, IMPACTS, "moderate", True).alias("impact_class"), classed(e, EFFORTS, "quick", False).alias("effort_class"))
        return let(impact, lambda i: let(effort, lambda e: told(i, e)))

    chunks = F.filter(F.transform(F.split(strip(text), ITEM), strip), lambda c: c != "")
    return F.transform(chunks, item)
