"""What pages hold: addresses, profiles, and products that pages declare as data."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.nodes import let
from .email import PERSONAL_DOMAINS
from .web import link_type, visible_letters

# Addresses as they are written, also with a bracketed or spaced at sign, and profiles.
ADDRESS = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
BRACKETED = r"(?i)[a-zA-Z0-9._%+\-]+\s*[\[\(]\s*at\s*[\]\)]\s*[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
SPACED = r"[a-zA-Z0-9._%+\-]+\s+@\s+[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PROFILE = r"https?://(?:www\.)?linkedin\.com/(?:in|company)/[a-zA-Z0-9\-_.%/]+"
PRODUCTS = "array<struct<title:string,price:string,snippet:string,url:string>>"


def page_emails(html: Column) -> Column:
    """Distinct addresses of a page with their source (email, source), in lower case: links first, then text, then masked ones.

    Addresses of 5 to 100 characters; those at personal domains are left out. An address counts
    by the first source that has it.
    """
    text = F.regexp_replace(visible_letters(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")), "&nbsp;", " ")
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    plain = lambda a: F.transform(a, lambda e: F.regexp_replace(F.regexp_replace(e, r"(?i)\s*[\[\(]\s*at\s*[\]\)]\s*", "@"), r"\s+@\s+", "@"))
    linked = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\shref\s*=\s*[\"']mailto:([^\"'?]*)"), F.lit(1))
    sources = lambda shown: [(linked, "MAILTO"), (found(shown, ADDRESS), "VISIBLE_TEXT"), (plain(F.concat(found(shown, BRACKETED), found(shown, SPACED))), "OBFUSCATED_TEXT")]
    tagged = lambda a, source: F.transform(a, lambda e: F.struct(F.lower(F.trim(e)).alias("email"), F.lit(source).alias("source")))
    each = let(text, lambda shown: F.concat(*[tagged(a, source) for a, source in sources(shown)]))
    halves = lambda e: F.split(e, "@")
    sound = F.filter(each, lambda x: F.length(x["email"]).between(5, 100) & (F.size(halves(x["email"])) >= 2) & (F.get(halves(x["email"]), 0) != "") & (F.get(halves(x["email"]), 1) != "") & ~F.get(halves(x["email"]), 1).isin(PERSONAL_DOMAINS))
    first = lambda own: let(F.transform(own, lambda x: x["email"]), lambda names: F.filter(own, lambda x, i: F.array_position(names, x["email"]) == i + 1))
    return let(sound, first)


def profile_links(html: Column) -> Column:
    """Distinct profile addresses of a page with their type (url, type), without closing slashes."""
    urls = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(f"({PROFILE})"), F.lit(1)), lambda u: F.regexp_replace(u, "/+$", "")))
    return F.transform(urls, lambda u: F.struct(u.alias("url"), link_type(u).alias("type")))


def _products(node, out: list) -> None:
    if isinstance(node, list):
        for item in node:
            _products(item, out)
    elif isinstance(node, dict):
        kinds = node.get("@type") if isinstance(node.get("@type"), list) else [node.get("@type")]
        name = node.get("name")
        if ("Product" in kinds or "Service" in kinds) and isinstance(name, str) and name.strip():
            offers = node.get("offers") or {}
            offer = (offers[0] if isinstance(offers, list) else offers) or {}
            amount = (offer.get("price") or offer.get("lowPrice")) if isinstance(offer, dict) else None
            cost = f"{offer.get('priceCurrency') or ''} {amount}".strip() if amount else str(node["price"]) if node.get("price") else None
            text = node.get("description")
            row = {"title": name.strip(), "price": cost, "snippet": (text[:300].strip() or None) if isinstance(text, str) else None, "url": node.get("url") or node.get("@id")}
            if row not in out:
                out.append(row)
        for value in node.values():
            _products(value, out)


def declared_products(html: Column) -> Column:
    """Products and services that a page declares in its JSON-LD scripts, in order, each once, at any depth.

    Scripts that are no JSON are left out. Only the scripts' text is handed to Python.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))

    @F.pandas_udf(PRODUCTS)
    def parsed(pages):
        def one(own):
            out: list = []
            for script in own if own is not None else ():
                try:
                    _products(json.loads(script), out)
                except ValueError:
                    continue
            return out

        return pages.map(one, na_action=None)

    return parsed(scripts)


# Elements without text to read, and attributes that stay.
UNREAD = r"(?is)<(script|style|svg|path|noscript)[^>]*>.*?</\1>"
DROPPED = r"\s+(?!href=|class=|id=|data-testid=)\w[\w-]*="


def lean_html(html: Column) -> Column:
    """A page's markup without scripts, styles and drawings, with links, classes and ids as the only attributes, and without blank lines."""
    out = F.regexp_replace(html, UNREAD, "")
    for quoted in ('"[^"]*"', "'[^']*'"):
        out = F.regexp_replace(out, DROPPED + quoted, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\n\s*\n+", "\n"), r"[ \t]{2,}", " "), r"^\s+|\s+$", "")
