"""E-mail addresses: quality, patterns and candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.nodes import let
from .text import without_accents

# Fixed values.
PERSONAL_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.de", "yahoo.fr", "yahoo.it", "yahoo.es", "yahoo.se",
    "hotmail.com", "hotmail.co.uk", "hotmail.de", "hotmail.fr", "outlook.com", "outlook.de", "outlook.fr", "live.com", "aol.com",
    "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me", "pm.me", "mail.com", "gmx.com", "gmx.de", "gmx.net",
    "gmx.at", "gmx.ch", "web.de", "ymail.com", "msn.com", "zoho.com", "yandex.com", "yandex.ru", "tutanota.com", "fastmail.com",
    "seznam.cz", "email.cz", "centrum.cz", "centrum.sk", "atlas.cz", "post.cz", "volny.cz", "tiscali.cz", "quick.cz", "chello.cz",
    "zoznam.sk", "azet.sk", "pobox.sk", "post.sk", "freenet.de", "t-online.de", "orange.fr", "wanadoo.fr", "laposte.net",
    "free.fr", "libero.it", "virgilio.it", "telia.com", "wp.pl", "o2.pl", "interia.pl", "onet.pl",
]
GENERIC_INBOXES = [
    "info", "hello", "contact", "support", "service", "help", "kontakt", "shop", "sales", "careers", "jobs", "hiring",
    "press", "pr", "legal", "privacy", "datenschutz", "presse", "media", "marketing", "team", "admin", "office", "billing",
    "orders", "customercare", "customerservice", "wholesale", "general", "enquiries", "dialog", "kundenservice", "bestellungen",
    "produktanfragen", "behoerdenkontakt", "produktsicherheit", "hr", "recruitment",
]
HONORIFICS = ["mr", "mrs", "ms", "dr", "prof", "sir", "dame", "herr", "frau"]
FALLBACK_PATTERNS = ["FIRST_LAST", "FIRSTLAST", "FIRST", "F.DOT.LAST", "F_LAST"]


def parts(email: Column) -> tuple[Column, Column]:
    """Local part and domain in lower case, both null unless there is exactly one @ with text on both sides."""
    split = F.split(F.lower(F.trim(email)), "@")
    sound = (F.size(split) == 2) & (F.get(split, 0) != "") & (F.get(split, 1) != "")
    return F.when(sound, F.get(split, 0)), F.when(sound, F.get(split, 1))


def gate(email: Column, allow_role: Column | bool = False) -> Column:
    """Why an address can't be used, or null."""
    local, domain = parts(email)
    bad = ~F.contains(domain, F.lit(".")) | F.contains(local, F.lit("u003e")) | F.contains(domain, F.lit("u003e")) | (F.length(local) > 64) | (F.length(domain) > 100) | domain.rlike(r"\.(png|jpg)$")
    allowed = allow_role if isinstance(allow_role, Column) else F.lit(allow_role)
    return F.when(local.isNull(), "MALFORMED").when(domain.isin(PERSONAL_DOMAINS), "PERSONAL_DOMAIN").when(bad, "INVALID_FORMAT").when(local.isin(GENERIC_INBOXES) & ~F.coalesce(allowed, F.lit(False)), "ROLE_INBOX")


def status(email: Column, guessed: Column, verdict: Column, allow_role: Column | bool = False) -> Column:
    """verified, guessed, risky or invalid: the gate first, then the verdict, and a guess stays one unless confirmed."""
    return F.when(gate(email, allow_role).isNotNull() | (F.coalesce(verdict, F.lit("")) == "invalid"), "invalid").when(verdict == "valid", "verified").when(F.coalesce(guessed, F.lit(False)), "guessed").otherwise("risky")


def name_words(name: Column) -> Column:
    """Words of a name for addresses, without honorifics."""
    words = F.transform(F.split(F.regexp_replace(without_accents(F.trim(name)), "['’]", ""), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z-]", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(HONORIFICS))


def name_parts(name: Column) -> tuple[Column, Column]:
    """First and last word of a name for addresses, both null if there are fewer than two."""
    words = name_words(name)
    two = F.size(words) >= 2
    return F.when(two, F.get(words, 0)), F.when(two, F.replace(F.element_at(words, -1), F.lit("-"), F.lit("")))


def build(first: Column, last: Column, pattern: str) -> Column:
    initial = F.left(first, F.lit(1))
    return {"FIRST_LAST": F.concat(first, F.lit("."), last), "FIRSTLAST": F.concat(first, last), "F_LAST": F.concat(initial, last), "F.DOT.LAST": F.concat(initial, F.lit("."), last), "FIRST": first, "LAST": last}[pattern]


#: Patterns in the order in which they are tried.
PATTERNS = ("FIRST_LAST", "FIRSTLAST", "F_LAST", "F.DOT.LAST", "FIRST", "LAST")


def classify(local: Column, name: Column) -> Column:
    """The pattern that makes the local part from the name, or UNKNOWN."""
    return pattern_of(local, *name_parts(name))


def name_keys(first: Column, last: Column) -> Column:
    """Distinct texts of which ``local_keys`` has one if a pattern makes a local part from the name: ``=`` and a whole one, or ``*``, its initial and how it ends."""
    return F.array_distinct(F.array(*[F.concat(F.lit("="), build(first, last, p)) for p in PATTERNS], F.concat(F.lit("*"), F.left(first, F.lit(1)), last)))


def local_keys(local: Column) -> Column:
    """``=`` and the local part in lower case, and ``*``, its initial and each of its endings."""
    own = F.lower(local)
    ends = F.transform(F.sequence(F.lit(2), F.length(own) + 1), lambda at: F.concat(F.lit("*"), F.left(own, F.lit(1)), F.substr(own, at)))
    return F.array_append(ends, F.concat(F.lit("="), own))


def pattern_of(local: Column, first: Column, last: Column) -> Column:
    """The pattern that makes the local part from the words of a name, or UNKNOWN."""
    own = F.lower(local)
    out = F.when(first.isNull(), "UNKNOWN")
    for pattern in PATTERNS:
        out = out.when(own == build(first, last, pattern), pattern)
    return out.when(F.startswith(own, F.left(first, F.lit(1))) & F.endswith(own, last) & (F.length(own) > F.length(last)), "F_LAST").otherwise("UNKNOWN")


def guess_structure(local: Column) -> Column:
    """The pattern that a local part suggests without a name."""
    return F.when(local.isin(GENERIC_INBOXES), "UNKNOWN").when(local.rlike("^[a-z]{2,}\\.[a-z]{2,}$"), "FIRST_LAST").when(local.rlike("^[a-z]\\.[a-z]{2,}$"), "F.DOT.LAST").otherwise("UNKNOWN")


def candidates(name: Column, domain: Column) -> Column:
    """Addresses by the fallback patterns, distinct, in order; none for personal domains or single names."""
    first, last = name_parts(name)
    each = F.array_distinct(F.array(*[F.concat(build(first, last, p), F.lit("@"), domain) for p in FALLBACK_PATTERNS]))
    return F.when(first.isNotNull() & ~domain.isin(PERSONAL_DOMAINS), F.slice(each, 1, 5)).otherwise(F.array().cast("array<string>"))


def inferred_pattern(addresses: Column, names: Column) -> Column:
    """(pattern, confidence, by_name) that a domain's addresses (array of email, local; sound ones, in order) speak for; null without any.

    Each address of a person votes with each of the ``names`` that it is made from; if none is, by its form.
    Most votes win, ties go to the pattern that came first. UNKNOWN has a confidence of 30 if there are
    people's addresses at all, else of 10.
    """
    personal = F.filter(addresses, lambda a: ~a["local"].isin(GENERIC_INBOXES))
    known = lambda patterns: F.filter(patterns, lambda p: p != "UNKNOWN")
    by_name = F.flatten(F.transform(personal, lambda a: known(F.transform(names, lambda n: classify(a["local"], n)))))
    by_form = known(F.transform(personal, lambda a: guess_structure(a["local"])))

    def best(votes: Column, named: Column) -> Column:
        counts = F.transform(F.array_distinct(votes), lambda p: F.struct(F.size(F.filter(votes, lambda v: v == p)).alias("n"), (-F.array_position(votes, p)).alias("first"), p.alias("p")))
        score = lambda top: F.when(top.isNull(), F.when(F.size(personal) > 0, 30).otherwise(10)).otherwise(50 + F.when(top["n"] >= 2, 25).otherwise(0) + F.when(F.size(personal) >= 2, 10).otherwise(0) + F.when(named, 15).otherwise(0))
        return let(F.array_max(counts), lambda top: F.struct(F.coalesce(top["p"], F.lit("UNKNOWN")).alias("pattern"), score(top).alias("confidence"), named.alias("by_name")))

    chosen = let(by_name, lambda votes: F.when(F.size(votes) > 0, best(votes, F.lit(True))).otherwise(let(by_form, lambda forms: best(forms, F.lit(False)))))
    return F.when(F.size(addresses) > 0, chosen)


def generated(name: Column, domain: Column, pattern: Column) -> Column:
    """At most five addresses (email, pattern, score) for a name at a domain, by an ``inferred_pattern`` first and the fallback patterns after it.

    None for personal domains and names of fewer than two words. Without a pattern the score is 30.
    """
    first, last = name_parts(name)
    likely = (pattern["pattern"] != "UNKNOWN") & (pattern["confidence"] >= 40)
    made = lambda local, p, score: F.struct(F.concat(local, F.lit("@"), domain).alias("email"), p.alias("pattern"), score.cast("int").alias("score"))
    built = F.coalesce(*[F.when(pattern["pattern"] == p, build(first, last, p)) for p in ("FIRST_LAST", "FIRSTLAST", "F_LAST", "F.DOT.LAST", "FIRST", "LAST")])
    fallback = F.when(pattern.isNull(), 30).otherwise(F.greatest(pattern["confidence"] - 20, F.lit(20)))
    every = F.array(F.when(likely, made(built, pattern["pattern"], pattern["confidence"])), *[made(build(first, last, p), F.lit(p), fallback) for p in FALLBACK_PATTERNS])
    once = lambda own: F.filter(own, lambda x, i: F.array_position(F.transform(own, lambda y: y["email"]), x["email"]) == i + 1)
    found = let(F.filter(every, lambda x: x.isNotNull()), once)
    none = F.slice(F.array(made(F.lit(""), F.lit(""), F.lit(0))), 1, 0)
    return F.when(first.isNotNull() & ~domain.isin(PERSONAL_DOMAINS), F.slice(found, 1, 5)).otherwise(none)


def domain_of(url: Column) -> Column:
    """Host of a url in lower case without www; empty if there is none."""
    full = F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", ""), F.lit(""))
