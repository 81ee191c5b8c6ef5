"""People that pages name: in headings, cards and list items, and on team pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.people import has_name_form
from ..sources.nodes import attr, below, cut, page

# Words on a page that hint at a role.
ROLE_HINTS = {
    "CEO": ["ceo", "chief executive officer", "founder", "co-founder", "cofounder", "managing director", "geschäftsführer", "geschaeftsfuehrer", "general manager", "gründer", "gründerin"],
    "HEAD_OF_PRODUCT": ["head of product", "vp product", "vp of product", "product director", "chief product officer", "cpo", "director of product"],
    "HEAD_OF_ECOMMERCE": ["head of ecommerce", "head of e-commerce", "ecommerce director", "e-commerce director", "director of ecommerce", "director of e-commerce", "digital commerce", "vp ecommerce", "vp e-commerce"],
    "HEAD_OF_GROWTH": ["head of growth", "cmo", "chief marketing officer", "growth lead", "marketing director", "vp marketing", "vp of marketing", "director of marketing"],
}
# Classes of cards with a person, whole ones and parts, in the order in which they are tried.
CARD_CLASSES = ["team-member", "team-card", "staff-member", "person", "member", "bio", "leader"]
CARD_PARTS = ["team", "person", "staff", "leader", "member", "bio"]
NAME_TAGS = ["h2", "h3", "h4", "h5", "strong", "b"]
# Positions on a team page, and how a name is written there.
POSITIONS = [
    "ceo", "chief executive", "managing director", "founder", "chief product", "head of product", "vp product", "head of ecommerce",
    "head of e-commerce", "director of ecommerce", "head of digital", "vp digital", "digital director", "cmo", "chief marketing",
    "head of marketing", "head of growth", "vp marketing", "director of marketing", "president", "chief operating", "coo",
]
LINE_NAME = r"^[A-ZÀ-Ö][a-zà-ö]+(\s[A-ZÀ-Ö][a-zà-ö\-]+){1,3}$"
DASHES = r"(?U)\s*[–—\-|,]\s*"
PERSON = "struct<name:string,title:string>"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def role_hints(text: Column) -> Column:
    """Roles that a text hints at, in order."""
    low = F.lower(text)
    hits = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), role) for role, words in ROLE_HINTS.items()]
    return F.filter(F.array(*hits), lambda r: r.isNotNull())


def title_beside(text: Column, name: Column) -> Column:
    """The first line of 3 to 119 characters of a text without the name, without a dash before it; empty if there is none."""
    at = F.instr(text, name)
    rest = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(name)))).otherwise(text)
    lines = F.transform(F.split(_trim(rest), "[\n\r]+"), _trim)
    line = F.coalesce(F.get(F.filter(lines, lambda x: F.length(x).between(3, 119)), 0), F.lit(""))
    return F.left(_trim(F.regexp_replace(line, r"(?U)^[,\-–—|:]\s*", "")), F.lit(120))


def page_people(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per person of a page: key, ``place``, ``name``, ``normal``, ``title``, ``hints``, ``evidence``, ``signals``.

    Tried in this order, a name counting by where it is found first: headings to the fourth level beside
    the text of the element around them; cards by class, with the first heading, bold text or name in
    them; list items and paragraphs of 10 to 300 characters whose first part is a name before a dash,
    bar or comma and whose rest hints at a role. Nothing moves between pages. Null and empty pages
    name nobody; paragraphs and items that aren't closed end where the next one starts.
    """
    read = pages.select(key, page(F.col(html), implied=True).alias("_p"))
    nodes, raw = F.col("_p.nodes"), F.col("_p.raw")
    text = lambda n: _trim(cut(raw, n["raw"], n["raw_end"]))
    one = lambda name, around, signal: F.struct(_trim(F.regexp_replace(name, r"(?U)\s+", " ")).alias("name"), around.alias("around"), F.lit(signal).alias("signal"))
    parent = lambda n: F.get(nodes, F.nullif(n["parent"], F.lit(-1)))
    headings = F.transform(F.filter(nodes, lambda n: n["tag"].isin("h1", "h2", "h3", "h4")), lambda n: one(text(n), F.coalesce(text(parent(n)), _trim(raw)), "heading-element"))

    def cards(matches) -> Column:
        named = lambda d: d["tag"].isin(NAME_TAGS) | F.contains(attr(d, "class"), F.lit("name"))
        found = F.transform(F.filter(nodes, matches), lambda n: F.struct(text(F.get(F.filter(below(nodes, n), named), 0)).alias("name"), text(n).alias("around")))
        return F.transform(F.filter(found, lambda c: F.coalesce(c["name"], F.lit("")) != ""), lambda c: one(c["name"], c["around"], "team-card-pattern"))

    whole = lambda c: lambda n: F.array_contains(F.split(attr(n, "class"), " "), c)
    part = lambda c: lambda n: F.contains(attr(n, "class"), F.lit(c))
    by_class, by_part = [cards(whole(c)) for c in CARD_CLASSES], [cards(part(c)) for c in CARD_PARTS]
    items = F.transform(F.filter(nodes, lambda n: n["tag"].isin("li", "dt", "dd", "p")), text)
    parts = F.transform(F.filter(items, lambda t: F.length(t).between(10, 300)), lambda t: F.struct(F.split(t, DASHES).alias("parts"), t.alias("t")))
    first = lambda x: _trim(F.get(x["parts"], 0))
    rest = lambda x: F.array_join(F.slice(x["parts"], F.lit(2), F.greatest(F.size(x["parts"]) - 1, F.lit(0))), " ")
    paired = F.filter(parts, lambda x: (F.size(x["parts"]) >= 2) & has_name_form(first(x)) & (F.size(role_hints(rest(x))) > 0))
    listed = F.transform(paired, lambda x: one(first(x), x["t"], "name-title-pattern"))
    read = read.select(key, F.filter(F.concat(headings, *by_class, *by_part, listed), lambda c: has_name_form(c["name"])).alias("_c"))
    normal = lambda c: F.lower(c["name"])
    once = F.transform(F.array_distinct(F.transform("_c", normal)), lambda n: F.get(F.filter("_c", lambda c: normal(c) == n), 0))
    rows = read.select(key, F.posexplode(once).alias("place", "_c"))
    hints = role_hints(F.col("_c.around"))
    signals = F.concat(F.array("_c.signal"), F.when(F.size(hints) > 0, F.array(F.lit("has-role-hint"))).otherwise(F.array().cast("array<string>")))
    return rows.select(key, "place", F.col("_c.name").alias("name"), F.lower("_c.name").alias("normal"), title_beside(F.col("_c.around"), F.col("_c.name")).alias("title"), hints.alias("hints"), F.left("_c.around", F.lit(300)).alias("evidence"), signals.alias("signals"))


def declared_people(html: Column) -> Column:
    """(name, title) of people that a page declares in its JSON-LD: persons, and employees or members of what it lists; broken scripts are passed over."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    many = lambda v: F.coalesce(F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")), F.array(v))
    filled = lambda v: F.coalesce(F.schema_of_variant(v) != "VOID", F.lit(False))
    string = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    either = lambda v, *paths: F.coalesce(*[F.when(filled(F.try_variant_get(v, p, "variant")), F.try_variant_get(v, p, "variant")) for p in paths])
    one = lambda v: F.struct(string(v, "$.name").alias("name"), F.coalesce(string(v, "$.jobTitle"), string(v, "$.role"), F.lit("")).alias("title"))
    items = F.flatten(F.transform(F.filter(F.transform(scripts, F.try_parse_json), lambda v: v.isNotNull()), many))
    own = lambda i: F.when(string(i, "$['@type']") == "Person", F.array(one(i))).otherwise(F.array().cast(f"array<{PERSON}>"))
    members = lambda i: F.transform(F.filter(many(either(i, "$.employee", "$.member")), lambda v: v.isNotNull()), one)
    return F.filter(F.flatten(F.transform(items, lambda i: F.concat(own(i), members(i)))), lambda p: F.coalesce(p["name"], F.lit("")) != "")


def paired_lines(lines: Column) -> Column:
    """(name, title) of neighbouring lines of which one is a name and the other a position; a line counts in one pair."""
    own = F.filter(F.transform(F.split(lines, "\n"), _trim), lambda t: F.length(t) > 1)
    named = lambda t: t.rlike(LINE_NAME)
    position = lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(w)) for w in POSITIONS])
    pair = lambda name, title: F.array(F.struct(name.alias("name"), title.alias("title")))
    start = F.struct(F.lit(None).cast("string").alias("before"), F.array().cast(f"array<{PERSON}>").alias("people"))

    def step(s: Column, t: Column) -> Column:
        b = s["before"]
        found = F.when(named(b) & position(t), pair(b, t)).when(position(b) & named(t) & (F.length(b) < 80), pair(t, b))
        return F.struct(F.when(found.isNull(), t).alias("before"), F.coalesce(F.concat(s["people"], found), s["people"]).alias("people"))

    return F.aggregate(own, start, step, lambda s: s["people"])


def team_people(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per person of a team page: key, ``place``, ``name``, ``title``, ``way``: what it declares, else pairs of its lines.

    A name counts once, as it is found first. Null, empty and broken pages give what can be read of them.
    """
    read = pages.select(key, declared_people(F.col(html)).alias("_d"), page(F.col(html), implied=True)["lines"].alias("_l"))
    read = read.select(key, "_d", paired_lines(F.col("_l")).alias("_l"))
    read = read.select(key, F.when(F.size("_d") > 0, F.col("_d")).otherwise(F.col("_l")).alias("_p"), F.when(F.size("_d") > 0, "declared").otherwise("lines").alias("way"))
    once = F.transform(F.array_distinct(F.transform("_p", lambda p: p["name"])), lambda n: F.get(F.filter("_p", lambda p: p["name"] == n), 0))
    return read.select(key, "way", F.posexplode(once).alias("place", "_x")).select(key, "place", F.col("_x.name").alias("name"), F.col("_x.title").alias("title"), "way")
