"""What a shop's home page tells of it: categories, brands, goods, its description and how it is searched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.links import normal_url, resolved
from ..functions.web import domain_brand, is_skipped, page_relevance, page_type, same_site
from ..sources.nodes import attr, below, cut, let, page

# Entries of menus that are no categories, names of search fields, and words of search forms.
MENU = [
    "home", "login", "log in", "sign in", "sign up", "register", "cart", "basket", "bag", "checkout", "account", "my account",
    "help", "contact", "contact us", "about", "about us", "faq", "privacy", "privacy policy", "terms", "terms of service",
    "cookie", "cookies", "menu", "close", "back", "skip", "search", "subscribe", "newsletter", "wishlist", "wish list",
    "returns", "return policy", "shipping", "track order",
]
SEARCH_FIELDS = ["q", "query", "search", "keyword", "k", "term", "s"]
SEARCH_FORMS = ["search", "find", "query"]
GOODS = r"(?i)product|item|card|deal|offer"
# What separates the parts of a page's title, longer ones first.
TITLE_PARTS = [" — ", " – ", " - ", " | ", " · "]
# Texts of menus that are no brands, as parts and as wholes, and texts that are no goods.
NO_BRAND_PARTS = [
    "newsletter", "gutschein", "rabatt", "hilfe", "faq", "über uns", "warenkorb", "suchen", "e-rezept", "anmelden", "registrieren",
    "startseite", "go to page", "schließen", "online-arzt", "redpoints", "now! service", "arigato",
]
NO_BRANDS = [
    "arzneimittel", "familie", "beauty & pflege", "sanitätshaus", "angebote", "marken", "vitamine & mineralstoffe", "magen & darm",
    "erkältung & grippe", "schmerzen", "kindergesundheit", "pflegeprodukte fürs kind", "kinderwunsch", "schwangerschaft",
    "gesichtspflege", "körperpflege", "sonne & schutz", "beauty specials", "ernährung", "baby & familie", "sparset",
]
NO_GOODS_PARTS = [
    "newsletter", "hilfe & faq", "anmelden", "registrieren", "e-rezept-rabatt", "e-rezept", "riesen-auswahl", "versandkostenfrei",
    "folgen sie uns", "deutschland", "variante auswählen", "suchergebnisse filtern",
]
#: How many of each are told.
CATEGORIES, BRANDS, FEATURED = 50, 30, 40


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def _once(texts: Column) -> Column:
    """Texts once each whatever their case, as first written."""
    low = lambda own: F.transform(own, F.lower)
    return let(texts, lambda own: let(low(own), lambda keys: F.filter(own, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)))


def _declared(html: Column) -> Column:
    """Values of the JSON-LD scripts of a page at any depth, objects as variants, outer ones first."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(scripts, F.try_parse_json), lambda v: v.isNotNull())


def _inner(value: Column) -> Column:
    """The values right inside a variant."""
    kind = F.schema_of_variant(value)
    many = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), F.map_values(F.try_variant_get(value, "$", "map<string,variant>")))
    return F.filter(F.coalesce(many, F.array().cast("array<variant>")), lambda v: v.isNotNull())


def _objects(html: Column, depth: int = 8) -> Column:
    """Objects that a page declares, down to ``depth`` levels, level by level."""
    levels, now = [], _declared(html)
    for _ in range(depth):
        levels.append(now)
        now = F.flatten(F.transform(now, _inner))
    return F.filter(F.concat(*levels), lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))


def _string(value: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def site_facts(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per page: key, ``description``, ``categories``, ``brands``, ``featured`` and ``search_template``.

    categories: links of menus. brands: links to brands, declared brands, elements named so. featured: declared
    goods, headings or links of elements that are named like goods, names in data attributes. Texts
    count once whatever their case, as first found; ``CATEGORIES``, ``BRANDS`` and ``FEATURED`` are the most
    that a report shows. The template is that of the first search form, else of a link to a search, with ``{}`` for
    the term, empty without either. Declared data is read down to eight levels. Null pages have
    nothing; repeated keys give a row each.
    """
    read = pages.select(key, F.col(html).alias("_h"), F.coalesce(F.col(url), F.lit("")).alias("_url"), page(F.col(html)).alias("_p"))
    nodes, raw, spaced = F.col("_p.nodes"), F.col("_p.raw"), F.col("_p.spaced")
    text = lambda n: _clean(cut(raw, n["raw"], n["raw_end"]))
    sized = lambda texts, least, most: F.filter(texts, lambda t: F.length(t).between(least, most))
    empty = lambda texts: F.coalesce(texts, F.array().cast("array<string>"))
    first = lambda own: F.get(own, 0)

    menus = F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"] == "nav"), lambda n: F.filter(below(nodes, n), lambda d: d["tag"] == "a")))
    categories = F.filter(sized(F.transform(menus, text), 1, 80), lambda t: ~F.lower(t).isin(MENU))
    links = F.filter(nodes, lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull())
    to_brands = F.transform(F.filter(links, lambda n: F.contains(F.lower(attr(n, "href")), F.lit("/brand"))), text)
    objects = _objects(F.col("_h"))
    declared = F.transform(objects, lambda v: F.coalesce(_string(v, "$.brand"), _string(v, "$.brand.name")))
    named = F.transform(F.filter(nodes, lambda n: F.contains(F.lower(F.concat_ws(" ", attr(n, "class"), attr(n, "id"))), F.lit("brand"))), text)
    brands = sized(F.concat(to_brands, F.transform(F.filter(declared, lambda b: b.isNotNull()), _clean), sized(named, 1, 59)), 1, 100)
    kinds = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    goods = F.transform(F.filter(objects, lambda v: F.coalesce(F.exists(kinds(v), lambda k: k.isin("Product", "Service", "Offer")), F.lit(False))), lambda v: _string(v, "$.name"))
    shown = lambda n: let(below(nodes, n), lambda inner: F.coalesce(let(first(F.filter(inner, lambda d: d["tag"].rlike("^h[1-6]$"))), text), let(first(F.filter(inner, lambda d: d["tag"] == "a")), text)))
    cards = F.transform(F.filter(nodes, lambda n: F.exists(F.split(attr(n, "class"), " "), lambda c: c.rlike(GOODS)) | attr(n, "class").rlike(GOODS)), shown)
    data = F.concat(*[F.filter(F.transform(nodes, lambda n: n["attrs"][a]), lambda v: v.isNotNull()) for a in ("data-product-name", "data-item-name")])
    featured = sized(F.transform(F.filter(F.concat(goods, cards, data), lambda t: t.isNotNull()), _clean), 3, 200)
    about = first(F.filter(F.transform(F.slice(F.filter(nodes, lambda n: (n["tag"] == "meta") & (F.lower(attr(n, "name")) == "description")), 1, 1), lambda n: F.trim(attr(n, "content"))), lambda t: t != ""))
    return read.select(
        key, F.coalesce(about, F.lit("")).alias("description"), F.slice(_once(empty(categories)), 1, CATEGORIES).alias("categories"), F.slice(_once(empty(brands)), 1, BRANDS).alias("brands"),
        F.slice(_once(empty(featured)), 1, FEATURED).alias("featured"), F.coalesce(_search(nodes, F.col("_url")), F.lit("")).alias("search_template"))


def _search(nodes: Column, url: Column) -> Column:
    """The template of the first search form of a page, else of its first link to a search."""
    whole = lambda r: F.concat(r["scheme"], F.lit("://"), r["host"], F.when(r["path"] == "/", "").otherwise(r["path"]))
    has = lambda t, words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])

    def by_form(form: Column) -> Column:
        field = F.get(F.filter(below(nodes, form), lambda d: (d["tag"] == "input") & (F.lower(attr(d, "name")).isin(SEARCH_FIELDS) | (F.lower(attr(d, "type")) == "search"))), 0)
        name = F.coalesce(field["attrs"]["name"], F.lit(""))
        known = (name != "") | has(F.lower(attr(form, "action")), SEARCH_FORMS)
        return F.when(known, F.concat(let(resolved(attr(form, "action"), url), whole), F.lit("?"), F.when(name == "", "q").otherwise(name), F.lit("={}")))

    def by_link(link: Column) -> Column:
        names = F.transform(F.filter(F.split(F.regexp_extract(attr(link, "href"), r"\?([^#]*)", 1), "&"), lambda p: F.contains(p, F.lit("="))), lambda p: F.regexp_extract(p, "^([^=]*)", 1))
        name = F.get(F.filter(names, lambda n: F.lower(n).isin(SEARCH_FIELDS)), 0)
        return F.concat(let(resolved(attr(link, "href"), url), whole), F.lit("?"), F.coalesce(name, F.lit("q")), F.lit("={}"))

    forms = F.filter(F.transform(F.filter(nodes, lambda n: n["tag"] == "form"), by_form), lambda t: t.isNotNull())
    links = F.filter(nodes, lambda n: (n["tag"] == "a") & F.contains(F.lower(attr(n, "href")), F.lit("search")) & F.contains(attr(n, "href"), F.lit("=")))
    return F.coalesce(F.get(forms, 0), F.get(F.filter(F.transform(links, by_link), lambda t: t.isNotNull()), 0))


def site_names(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per page: key and ``name``: what the site calls itself, else the brand in its domain, else the last part of its title, else its host.

    A name that is a category of the site's menu doesn't count. Null pages and addresses have what the other gives, at least an empty name.
    """
    read = pages.select(key, F.coalesce(F.col(url), F.lit("")).alias("_url"), page(F.col(html)).alias("_p"))
    nodes, raw = F.col("_p.nodes"), F.col("_p.raw")
    menus = F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"] == "nav"), lambda n: F.filter(below(nodes, n), lambda d: d["tag"] == "a")))
    read = read.withColumns({"_menu": F.coalesce(F.transform(menus, lambda n: F.lower(_clean(cut(raw, n["raw"], n["raw_end"])))), F.array().cast("array<string>")),
        "_og": F.trim(attr(F.get(F.filter(nodes, lambda n: (n["tag"] == "meta") & (attr(n, "property") == "og:site_name")), 0), "content")),
        "_title": let(F.get(F.filter(nodes, lambda n: n["tag"] == "title"), 0), lambda n: F.trim(cut(raw, n["raw"], n["raw_end"])))})
    part = F.coalesce(*[F.when(F.contains("_title", F.lit(p)), F.trim(F.element_at(F.split("_title", F.lit("\\Q" + p + "\\E")), -1))) for p in TITLE_PARTS], "_title")
    free = lambda name: F.when((F.coalesce(name, F.lit("")) != "") & ~F.array_contains("_menu", F.lower(F.trim(name))), name)
    host = F.replace(F.regexp_extract("_url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    return read.select(key, F.coalesce(free(F.col("_og")), F.nullif(domain_brand(F.col("_url")), F.lit("")), free(part), host).alias("name"))


def internal_links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", most: int = 9) -> DataFrame:
    """The ``most`` likeliest pages of a site that its home page links to: key, ``place``, ``url``, ``type``, ``label``, ``relevance``.

    Links to other hosts, files, other schemes and the page itself don't count, an address counts once,
    by its first link. Pages of a known type come first, then the more relevant ones, then the page's order.
    """
    read = pages.select(key, F.col(url).alias("_url"), page(F.col(html)).alias("_p"))
    nodes, raw = F.col("_p.nodes"), F.col("_p.raw")
    links = F.filter(nodes, lambda n: (n["tag"] == "a") & (attr(n, "href") != "") & ~is_skipped(attr(n, "href")))
    each = F.transform(links, lambda n: F.struct(normal_url(attr(n, "href"), F.col("_url")).alias("url"), F.left(_clean(cut(raw, n["raw"], n["raw_end"])), F.lit(200)).alias("label")))
    home = normal_url(F.col("_url"), F.col("_url"))
    own = lambda found: F.filter(found, lambda x: x["url"].isNotNull() & same_site(x["url"], F.col("_url")) & (x["url"] != home))
    once = lambda found: let(F.transform(found, lambda x: x["url"]), lambda urls: F.filter(found, lambda x, i: F.array_position(urls, x["url"]) == i + 1))
    read = read.select(key, F.posexplode(let(let(each, own), once)).alias("_i", "_x"))
    kind, score = page_type(F.col("_x.url"), F.col("_x.label")), page_relevance(F.col("_x.url"), F.col("_x.label"))
    rows = read.select(key, "_i", F.col("_x.url").alias("url"), kind.alias("type"), F.col("_x.label").alias("label"), score.cast("int").alias("relevance"))
    order = Window.partitionBy(key).orderBy((F.col("type") == "OTHER").cast("int"), F.desc("relevance"), "_i")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(key, "place", "url", "type", "label", "relevance")


def merged_brands(trusted: Column, found: Column, most: int = 40) -> Column:
    """Brands of two lists (arrays), trusted ones first, each once whatever its case, without texts of menus; at most ``most``, as a report shows."""
    low = lambda t: F.lower(F.trim(t))
    noise = lambda t: low(t).isin(NO_BRANDS) | reduce(lambda a, b: a | b, [F.contains(low(t), F.lit(w)) for w in NO_BRAND_PARTS])
    every = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in (trusted, found)])
    return F.slice(let(F.filter(every, lambda t: t.isNotNull() & (low(t) != "") & ~noise(t)), lambda own: let(F.transform(own, low), lambda keys: F.filter(own, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1))), 1, most)


def clean_featured(items: Column, most: int = 60) -> Column:
    """Featured goods (an array) without texts of menus, titles of articles and questions; at most ``most``."""
    low = lambda t: F.lower(F.trim(t))
    noise = lambda t: (F.length(low(t)) < 5) | reduce(lambda a, b: a | b, [F.contains(low(t), F.lit(w)) for w in NO_GOODS_PARTS]) | (t.rlike("[–—]") & F.contains(t, F.lit("?"))) | F.endswith(low(t), F.lit("?"))
    return F.slice(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda t: t.isNotNull() & ~noise(t)), 1, most)
