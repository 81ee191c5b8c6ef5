"""Pages and results of the web: blocks, redirects, page types, languages, prices and junk titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What block pages say.
CLOUDFLARE_SIGNALS = ["just a moment", "checking your browser", "please enable cookies to continue", "ray id", "ddos protection by cloudflare", "enable javascript and cookies to continue"]
IMPERVA_SIGNALS = ["incapsula incident", "pardon our interruption", "request unsuccessful"]
# Titles that are no products.
JUNK_STARTS = [
    "results for", "showing results", "search results", "top trending", "trending deals", "featured deals", "popular picks",
    "recommended for you", "you may also like", "sponsored", "advertisement", "see all", "view more", "load more", "show more",
    "next page", "previous", "back to top", "sign in", "log in", "join now", "bekijk vergelijking", "vergelijk", "toon meer",
    "meer laden", "inloggen", "registreren", "mijn account", "gratis bezorgd", "gratis verzending", "voor ", "binnen ",
]
JUNK_TITLES = ["free shipping", "new arrivals", "best sellers", "sale", "clearance", "ad", "ads"]
# Words of page types, the first type that matches counts, and words that raise a page.
PAGE_TYPES = {
    "TEAM": ["team", "people", "our-team", "ourteam", "meet-the-team"],
    "LEADERSHIP": ["leadership", "management", "executives", "board", "directors", "fuhrung", "führung"],
    "ABOUT": ["about", "about-us", "aboutus", "who-we-are", "our-story", "company", "uber-uns", "über-uns"],
    "CONTACT": ["contact", "kontakt", "kontakte", "get-in-touch", "reach-us"],
    "LEGAL": ["impressum", "imprint", "legal", "datenschutz", "privacy"],
    "CAREERS": ["careers", "jobs", "join-us", "work-with-us", "karriere"],
}
PAGE_WORDS = ["about", "team", "leadership", "management", "company", "contact", "kontakte", "kontakt", "impressum", "legal", "about-us", "aboutus", "who-we-are", "our-story", "careers", "jobs", "people", "executives", "board"]
# Languages by code and by country suffix.
LANGUAGES = {
    "sv": "Swedish", "da": "Danish", "no": "Norwegian", "nb": "Norwegian", "nn": "Norwegian", "fi": "Finnish", "de": "German",
    "nl": "Dutch", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "pl": "Polish", "cs": "Czech", "sk": "Slovak",
    "hu": "Hungarian", "ro": "Romanian", "el": "Greek", "tr": "Turkish", "ru": "Russian", "uk": "Ukrainian", "ja": "Japanese",
    "ko": "Korean", "zh": "Chinese", "ar": "Arabic", "he": "Hebrew", "en": "English",
}
SUFFIX_LANGUAGES = {
    "se": "Swedish", "dk": "Danish", "no": "Norwegian", "fi": "Finnish", "de": "German", "at": "German", "ch": "German", "fr": "French",
    "be": "French", "nl": "Dutch", "es": "Spanish", "mx": "Spanish", "it": "Italian", "pt": "Portuguese", "br": "Portuguese",
    "pl": "Polish", "cz": "Czech", "sk": "Slovak", "hu": "Hungarian", "ro": "Romanian", "ru": "Russian", "tr": "Turkish",
    "jp": "Japanese", "kr": "Korean", "cn": "Chinese",
}
# Prices.
PRICE = r"[A-Z]{0,2}[$€£¥₹₩₪฿₫₴]\s?\d[\d.,]*|\d[\d.,]*\s?[$€£¥₹₩₪฿₫₴]|(?:Kč|kč|zł|kr)\s?\d[\d.,]*|\d[\d.,]*\s?(?:Kč|kč|zł|kr)|\d[\d.,]*\s?(?:USD|EUR|GBP|JPY|CAD|AUD|CHF|CNY|KRW|INR|BRL|SEK|NOK|DKK|PLN|CZK)"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _named(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def response_class(html: Column) -> Column:
    """empty, cloudflare, imperva or ok, by the first 5000 characters (a block page says so at its top)."""
    head = F.lower(F.left(html, F.lit(5000)))
    return F.when(F.coalesce(html, F.lit("")) == "", "empty").when(_any(head, CLOUDFLARE_SIGNALS), "cloudflare").when(_any(head, IMPERVA_SIGNALS), "imperva").otherwise("ok")


def search_redirected(asked: Column, reached: Column, query: Column) -> Column:
    """Whether a search ended elsewhere: another path, and an address without the encoded query."""
    path = lambda u: F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    gone = ~F.contains(F.lower(reached), F.lower(F.url_encode(query)))
    return (F.coalesce(reached, F.lit("")) != "") & (reached != asked) & (path(asked) != path(reached)) & gone


def page_type(address: Column, label: Column) -> Column:
    both = F.lower(F.concat_ws(" ", address, label))
    out = F.when(F.lit(False), "")
    for kind, words in PAGE_TYPES.items():
        out = out.when(_any(both, words), kind)
    return out.otherwise("OTHER")


def page_relevance(address: Column, label: Column) -> Column:
    """Ten for each word that a page link holds, less two for each slash of its path."""
    both = F.lower(F.concat_ws(" ", address, label))
    hits = reduce(lambda a, b: a + b, [F.when(F.contains(both, F.lit(w)), 10).otherwise(0) for w in PAGE_WORDS])
    path = F.regexp_extract(address, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return hits - 2 * F.greatest(slashes, F.lit(1))


def visible_letters(html: Column) -> Column:
    """Text of a page without its tags."""
    return F.regexp_replace(html, r"(?s)<[^>]*>", "")


def primary_language(html: Column, url: Column) -> Column:
    """Language of a site's customers by name.

    In order: the language that the page declares, its locale and its alternates (English is not
    believed there), the path, the country suffix, and letters that are frequent in the text of
    Nordic and German pages; else English.
    """
    code = lambda pattern: F.regexp_extract(F.lower(html), pattern, 1)
    foreign = lambda c: F.when(c != "en", F.element_at(_named(LANGUAGES), c))
    declared = foreign(code(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]+)"))
    locale = foreign(code(r"<meta\b[^>]*?property\s*=\s*[\"']og:locale[\"'][^>]*?content\s*=\s*[\"']\s*([a-z]+)"))
    alternates = F.transform(F.regexp_extract_all(F.lower(html), F.lit(r"<link\b(?=[^>]*rel\s*=\s*[\"']alternate[\"'])[^>]*?hreflang\s*=\s*[\"']?\s*([a-z]+)(?:-[a-z]+)*[\"']"), F.lit(1)), foreign)
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    places = F.array(*[F.when(path.rlike(f"/{c}[-/]"), F.lit(n)) for c, n in LANGUAGES.items()])
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    suffix = F.when(F.contains(host, F.lit(".")), F.element_at(_named(SUFFIX_LANGUAGES), F.substring_index(host, ".", -1)))
    shown = visible_letters(html)
    only = lambda letters: F.length(F.regexp_replace(shown, f"[^{letters}]", "")).cast("double")
    letters = F.length(F.regexp_replace(shown, r"\P{L}", "")).cast("double")
    nordic, swedish, danish = only("åäöæøÅÄÖÆØ"), only("åäöÅÄÖ"), only("æøÆØ")
    dense = F.when(letters > 200, F.when(nordic / letters > 0.01, F.when(danish > swedish, "Danish").otherwise("Swedish")).when(only("üÜßéè") / letters > 0.005, "German"))
    first = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), 0)
    return F.coalesce(declared, locale, first(alternates), first(places), suffix, dense, F.lit("English"))


def price(text: Column) -> Column:
    """The first price in a text as written, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, f"({PRICE})", 1)), F.lit(""))


def link_type(url: Column, network: str = "linkedin.com") -> Column:
    """PERSON_PROFILE, COMPANY_PAGE or OTHER for addresses of a professional network, null for others."""
    low = F.lower(url)
    return F.when(F.contains(low, F.lit(network)), F.when(F.contains(low, F.lit("/in/")), "PERSON_PROFILE").when(F.contains(low, F.lit("/company/")), "COMPANY_PAGE").otherwise("OTHER"))


def is_worded(title: Column) -> Column:
    """Titles of 8 characters or more with a letter."""
    own = F.trim(title)
    return F.coalesce((F.length(own) >= 8) & own.rlike(r"\p{L}"), F.lit(False))


def is_junk_title(title: Column) -> Column:
    """Titles that are short, have no letter or are parts of the page; null counts as junk."""
    low = F.lower(F.trim(title))
    starts = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(w)) for w in JUNK_STARTS])
    return F.coalesce(~is_worded(title) | starts | low.isin(JUNK_TITLES), F.lit(True))


# Words of pages that sell services and goods, and labels before a suffix that are no brand.
SERVICE_WORDS = [
    "book", "booking", "reservation", "reserve", "experience", "things to do", "activities", "activity", "spa", "appointment", "event",
    "events", "tickets", "ticket", "tours", "tour", "classes", "lessons", "consulting", "service", "services", "schedule", "hire",
    "rental", "rent",
]
GOODS_WORDS = ["add to cart", "buy now", "shipping", "free shipping", "size", "color", "colour", "shop by", "add to bag", "in stock", "out of stock", "sku", "qty", "quantity"]
SECOND_LEVELS = ["co", "com", "org", "net", "ac", "gov", "edu"]


def site_type(html: Column, extra: Column | None = None) -> Column:
    """PHYSICAL_GOODS, SERVICES_EXPERIENCES or MARKETPLACE_MIXED, by words and prices (five at most count).

    Words count once each, in the page's first 50,000 characters, which is the rule's definition,
    and in ``extra`` (navigation, titles, description).
    """
    head = F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(50_000)))
    every = F.concat_ws(" ", F.lower(extra), head) if extra is not None else head
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(every, w)))
    services = hits(SERVICE_WORDS)
    goods = hits(GOODS_WORDS) + F.least(F.regexp_count(head, F.lit(r"[$€£¥]\s?\d")), F.lit(5))
    sure = F.when((services >= 3) & (goods <= 1), "SERVICES_EXPERIENCES").when((goods >= 3) & (services <= 1), "PHYSICAL_GOODS").when((goods >= 3) & (services >= 3), "MARKETPLACE_MIXED")
    return F.coalesce(sure, F.when(goods > services, "PHYSICAL_GOODS").when(services > goods, "SERVICES_EXPERIENCES").otherwise("MARKETPLACE_MIXED"))


def domain_brand(url: Column) -> Column:
    """The label of a host before its suffix (also a suffix of two labels), with a capital letter; empty without a host."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: (x != "") & (F.lower(x) != "www"))
    n = F.size(labels)
    at = F.when((n >= 3) & F.lower(F.try_element_at(labels, F.lit(-2))).isin(SECOND_LEVELS), -3).when(n >= 2, -2).otherwise(-1)
    label = F.coalesce(F.try_element_at(labels, at), F.lit(""))
    return F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substr(label, F.lit(2))))


def unwrapped(url: Column) -> Column:
    """The target of a search engine's redirect, whose ``u`` holds it in base64 after an optional ``a1``; other addresses as they are."""
    code = F.regexp_replace(F.regexp_extract(url, r"[?&]u=([^&#]*)", 1), "^a1", "")
    even = F.translate(code, "-_", "+/")
    padded = F.rpad(even, (F.ceil(F.length(even) / 4) * 4).cast("int"), F.lit("="))
    target = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(F.contains(url, F.lit("bing.com/ck/a")) & (code != "") & F.startswith(target, F.lit("http")), target).otherwise(url)


# Titles of page furniture in results, and hosts of policies.
FURNITURE_TITLES = [
    "+ Zobrazit více", "Zobrazit více", "Porovnání produktů", "Podobné fráze", "Zapomněli jste heslo?", "Povolit vše", "Smazat vše", "Přejít do košíku",
    "Kategorie", "Značky", "Přihlásit se", "Registrovat se", "Show more", "Compare products", "Sign in", "Accept all", "Clear all",
]
POLICY_HOSTS = ["policies.google.com", "business.safety.google"]


def is_furniture(title: Column, url: Column) -> Column:
    """Results that are parts of the page: fixed titles, no target, a fragment, or a page of policies."""
    target = F.coalesce(url, F.lit(""))
    return F.coalesce(title, F.lit("")).isin(FURNITURE_TITLES) | (target == "") | F.startswith(target, F.lit("#")) | reduce(lambda a, b: a | b, [F.contains(target, F.lit(h)) for h in POLICY_HOSTS])


def is_consent_artefact(title: Column, url: Column) -> Column:
    """Leftovers of consent banners: script targets, and titles that speak of cookies."""
    return F.startswith(F.lower(F.coalesce(url, F.lit(""))), F.lit("javascript:")) | F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit("cookie"))


# Endings of files that aren't pages.
FILE_ENDINGS = ["jpg", "jpeg", "png", "gif", "svg", "webp", "avif", "pdf", "zip", "gz", "tar", "mp3", "mp4", "webm", "woff", "woff2", "ttf", "eot", "ico", "css", "js"]


def is_skipped(href: Column) -> Column:
    """Links that lead to no page: empty ones, fragments alone, other schemes, and files."""
    low = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    path = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return low.isin("", "#") | low.rlike("^(mailto|tel|javascript|data):") | F.regexp_extract(path, r"\.([^./]*)$", 1).isin(FILE_ENDINGS)


def same_site(url: Column, base: Column) -> Column:
    """Whether both addresses have one host, with or without www."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return (host(url) == host(base)) & (host(url) != "")


# What pages hold that scripts fill in, and addresses of products.
SCRIPTED_SIGNALS = ["window.__next_data__", "__nuxt__", "__react_root__", 'id="__next"', 'id="app"', 'id="root"', "window.__remixcontext", "data-reactroot", "ng-app", "react-root"]
PRODUCT_LINK = r"(?i)/deal|/product|/item|/offer|/dp/|/p/|/listing"


def needs_scripts(html: Column, n_results: Column) -> Column:
    """Whether a page is likely filled in by scripts: signs of a framework, or with under five results little text or few product links."""
    low = F.lower(F.left(html, F.lit(80_000)))
    signed = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in SCRIPTED_SIGNALS])
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", "")
    body = F.regexp_extract(bare, r"(?is)<body\b[^>]*>(.*?)(?:</body|$)", 1)
    pieces = F.transform(F.split(body, "<[^>]*>"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    size = F.length(F.array_join(pieces, ""))
    links = F.regexp_extract_all(bare, F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)"), F.lit(1))
    few = F.size(F.filter(links, lambda u: u.rlike(PRODUCT_LINK))) < 5
    return F.coalesce(signed | ((n_results < 5) & ((size < 500) | (size / F.length(html) < 0.10) | few)), F.lit(False))
