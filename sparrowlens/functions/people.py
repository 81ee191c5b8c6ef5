"""Names of people: what looks like one, names in profile addresses, and searches for the holder of a role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.nodes import let

# The form of a name, and what names don't hold.
NAME = r"^[A-ZÀ-ɏ][a-zÀ-ɏ]+(?:\s+(?:de|van|von|der|den|la|le|el|al|di|del|da|dos|das|du|mc|mac|o')?)?(?:\s+[A-ZÀ-ɏ][a-zÀ-ɏ]+){1,3}$"
NO_NAMES = [
    r"(?i)^(shop|buy|order|sale|official|site|page|home|new|free)\b",
    r"(?i)\b(shop now|official site|sign up|log in|contact us|read more)\b",
    r"^\d",
    r"[@#$%^&*(){}\[\]]",
    r"(?i)^(Your Account|My Account|Google Help|Amazon Stores)\b",
    r"(?i)^(Customer Service|Trading Post|New Arrivals|Top Picks)\b",
    r"(?i)^(Free Shipping|Gift Cards|About Us|Contact Us)\b",
    r"(?i)^(Community Resources|Forbes Advisor|Microsoft Support)\b",
    r"(?i)^(Cheap Flights|Best Deals|Top Rated)\b",
    r"(?i)^(Online Shop|Official Site|Web Store)\b",
    r"(?i)^(Comprehensive Identity|Sustainable Dresses|Cowboy Boots)\b",
    r"(?i)\b(Management Team|Org Chart|Company Profile|Employee List)\b",
    r"(?i)\b(Inc\.|LLC|Ltd\.|GmbH|Corp\.)\b",
]
# Searches for a role; {c} is the company.
ROLE_SEARCHES = {
    "CEO": ['"{c}" CEO LinkedIn', 'site:linkedin.com/in "{c}" CEO', '"{c}" founder LinkedIn'],
    "HEAD_OF_PRODUCT": ['site:linkedin.com/in "{c}" "Head of Product"', '"{c}" "Head of Product" LinkedIn', '"{c}" "VP Product" LinkedIn'],
    "HEAD_OF_ECOMMERCE": ['site:linkedin.com/in "{c}" "Head of Ecommerce"', '"{c}" "Director of Ecommerce" LinkedIn', '"{c}" ecommerce LinkedIn'],
    "HEAD_OF_GROWTH": ['site:linkedin.com/in "{c}" "Head of Growth"', '"{c}" CMO LinkedIn', '"{c}" "Marketing Director" LinkedIn'],
}


def has_name_form(text: Column) -> Column:
    """Two to five words of 4 to 60 characters with capitals and small letters that have the form of a name."""
    words = lambda own: F.size(F.split(own, r"\s+"))
    return let(F.trim(text), lambda own: F.coalesce(F.length(own).between(4, 60) & let(words(own), lambda n: n.between(2, 5)) & (own != F.upper(own)) & (own != F.lower(own)) & own.rlike(NAME), F.lit(False)))


def is_person_name(text: Column) -> Column:
    """The form of a name, and nothing in it that names don't hold."""
    bad = lambda own: reduce(lambda a, b: a | b, [own.rlike(p) for p in NO_NAMES])
    return let(F.trim(text), lambda own: F.coalesce(has_name_form(own) & ~bad(own), F.lit(False)))


def name_in_profile(url: Column) -> Column:
    """The name that a profile's address holds, without a number at its end, or null."""
    slug = F.regexp_extract(url, r"(?i)linkedin\.com/in/([^/?#]+)", 1)
    words = F.split(F.regexp_replace(F.trim(F.translate(F.try_url_decode(slug), "-_", "  ")), r"\s+\d+$", ""), r"\s+")
    name = lambda ws: F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")
    named = lambda ws: F.when(F.size(ws).between(2, 4), let(name(ws), lambda n: F.when(is_person_name(n), n)))
    return F.when(slug != "", let(words, named))


def role_searches(company: Column, role: Column, region: Column, country: Column, known_name: Column) -> Column:
    """At most four different searches for who holds a role: fixed ones, one with the country, one with a name that is known."""
    put = lambda template: F.replace(F.lit(template), F.lit("{c}"), company)
    known = F.coalesce(*[F.when(role == r, F.array(*map(put, searches))) for r, searches in ROLE_SEARCHES.items()])
    other = F.array(F.concat(F.lit('"'), company, F.lit('" '), role, F.lit(" LinkedIn")), F.concat(F.lit('site:linkedin.com/in "'), company, F.lit('" '), role))
    local = F.when((region == "EU") & (F.coalesce(country, F.lit("")) != "") & (role == "CEO"), F.concat(F.lit('"'), company, F.lit('" CEO '), country, F.lit(" LinkedIn")))
    named = F.when(F.coalesce(known_name, F.lit("")) != "", F.concat(F.lit('"'), known_name, F.lit('" "'), company, F.lit('" LinkedIn')))
    every = F.filter(F.concat(F.coalesce(known, other), F.array(local, named)), lambda q: q.isNotNull())
    keys = F.transform(every, lambda q: F.trim(F.regexp_replace(F.lower(q), r"\s+", " ")))
    return F.slice(F.filter(every, lambda q, i: F.array_position(keys, F.get(keys, i)) == i + 1), 1, 4)


def _first_name(texts: Column) -> Column:
    return F.get(F.filter(F.transform(texts, lambda t: F.trim(t)), is_person_name), 0)


def profile_title(title: Column) -> Column:
    """Name, role and company of a profile's title, cut at dashes with blanks and bars; of two parts the second may name both with ``at``."""
    clean = F.trim(F.regexp_replace(title, r"(?i)\s*[|\-–—]\s*LinkedIn\s*$", ""))
    cut = F.filter(F.transform(F.split(clean, r"\s*[–—|]\s*|\s+-\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return let(cut, _profile_parts)


def _profile_parts(cut: Column) -> Column:
    second, third = F.coalesce(F.get(cut, 1), F.lit("")), F.coalesce(F.get(cut, 2), F.lit(""))
    halves = F.split(second, r"\s+at\s+")
    both = (F.size(cut) == 2) & F.contains(second, F.lit(" at "))
    return F.struct(
        F.when(is_person_name(F.get(cut, 0)), F.get(cut, 0)).alias("name"),
        F.when(both, F.trim(F.get(halves, 0))).otherwise(second).alias("role"),
        F.when(both, F.trim(F.coalesce(F.get(halves, 1), F.lit("")))).otherwise(third).alias("company"),
    )


def name_in_title(title: Column) -> Column:
    """The first part of a title that looks like a name: cut at dashes and bars, or else before the first comma."""
    return F.coalesce(_first_name(F.split(title, r"\s*[-–—|]\s*")), _first_name(F.slice(F.split(title, r",\s*"), 1, 1)))


def name_in_snippet(snippet: Column) -> Column:
    """A name at the start of one of the first three clauses that goes on with ``is``, a comma or a dash."""
    clauses = F.slice(F.split(snippet, r"[.;–—|]"), 1, 3)
    return _first_name(F.transform(clauses, lambda c: F.regexp_extract(F.trim(c), r"^([A-ZÀ-ɏ][a-zÀ-ɏ]+(?:\s+[A-ZÀ-ɏ][a-zÀ-ɏ]+){1,3})\s+(?:is|,|–)", 1)))
