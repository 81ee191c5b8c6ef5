"""From search results to people, and from people to addresses: candidates, public addresses and addresses made from patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import email as mail
from ..functions.people import name_in_profile, name_in_snippet, name_in_title, profile_title
from ..sources.nodes import let
from .review import inferred_confidence
from .scoring import ROLE_WORDS

# Words that say a role in a search result: one more than elsewhere.
ROLE_EVIDENCE = ROLE_WORDS | {"HEAD_OF_GROWTH": [*ROLE_WORDS["HEAD_OF_GROWTH"], "growth lead"]}
# Posts, which are no profiles, and goods, which are no people.
POSTS = r"(?i)^beitrag von\b|^post by\b|^post von\b|\bactivity-\d+|/posts?/|^#\w+"
GOODS = (
    r"(?i)\b(dresses|shoes|boots|jackets|coats|pants|jeans|shirts|tops|blouses)\b"
    r"|\b(sale|clearance|new arrivals|collection|lookbook|catalog)\b"
    r"|\b(sustainable clothing|sustainable fashion|eco-friendly)\b"
    r"|\b(shop now|add to cart|buy now|free shipping|official site|official store)\b"
    r"|\b(wedding guest|bridesmaid|prom|homecoming)\b"
    r"|\b(gift card|promo code|coupon|discount)\b"
    r"|\b(customer service|return policy|shipping info|size guide)\b"
    r"|\b(webmail|login|sign in|my account|forgot password)\b"
)


def speaks_of(role: Column, text: Column) -> Column:
    """Whether a text holds a word of the role."""
    has = lambda low, words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return let(F.lower(text), lambda low: F.coalesce(*[F.when(role == r, has(low, words)) for r, words in ROLE_EVIDENCE.items()], F.lit(False)))


def _normal(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def identity_candidates(results: DataFrame) -> DataFrame:
    """People whom search results for a role name, each once with a profile and once without: the first result counts.

    ``results``: row_key, role, company_name, place, title, snippet, url, link_type (PERSON_PROFILE and others
    of a network, null elsewhere), signals. Results on goods and posts go. Of a profile the name comes
    from its title, from any part of it, or from its address, else from title or snippet. Signals tell in
    order what was found. Null texts count as empty; results that name nobody give no row.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    title, snippet, url = text("title"), text("snippet"), text("url")
    both = F.concat(title, F.lit(" "), snippet)
    is_profile = F.coalesce(F.col("link_type") == "PERSON_PROFILE", F.lit(False))
    names = lambda p: F.struct(p.alias("_p"), name_in_title(title).alias("_t"), name_in_snippet(snippet).alias("_s"), name_in_profile(url).alias("_u"), is_profile.alias("_is"))
    people = F.when(~both.rlike(GOODS) & ~title.rlike(POSTS) & ~url.rlike(POSTS), F.array(names(profile_title(title))))
    own = results.withColumn("_o", F.explode(people)).select(*results.columns, "_o.*")  # a generator works names out once; of a projection, filters and signals would each repeat them
    profiled = F.when(F.col("_is"), F.coalesce("_p.name", "_t", "_u"))
    own = own.withColumn("full_name", F.coalesce(profiled, "_t", "_s")).where("full_name is not null")
    company = F.lower(text("company_name"))
    link = F.regexp_replace(url, r"[?#].*$", "")
    signal = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array(
        signal(profiled.isNotNull(), "linkedin-profile-name"),
        signal(F.col("_is") & speaks_of(F.col("role"), F.regexp_replace(title, r"(?i)\s*[|\-–—]\s*LinkedIn\s*$", "")), "LINKEDIN_TITLE_ROLE_MATCH"),
        signal(F.col("_is") & (F.col("_p.company") != "") & F.contains(F.lower("_p.company"), F.get(F.split(company, " "), 0)), "COMPANY_MATCH_FROM_TITLE"),
        signal(F.col("_is") & (_normal(F.col("_u")) == _normal(F.col("full_name"))), "LINKEDIN_PROFILE_SLUG_MATCHES_NAME"),
        signal(profiled.isNull() & F.col("_t").isNotNull(), "title-name"),
        signal(profiled.isNull() & F.col("_t").isNull(), "snippet-name"),
        signal(speaks_of(F.col("role"), both), "role-evidence"),
    )
    signals = F.concat(F.coalesce("signals", F.array().cast("array<string>")), F.filter(found, lambda s: s.isNotNull()))
    named = F.when(F.contains(F.lower(both), company), F.col("company_name")).otherwise("")
    each = own.select("row_key", "role", "place", "full_name", _normal(F.col("full_name")).alias("normal"), F.when(F.col("_is"), link).otherwise("").alias("link"), F.coalesce(named, F.lit("")).alias("company"), signals.alias("signals"), "url")
    first = each.groupBy("row_key", "role", "normal", "link").agg(F.min(F.struct("place", "full_name", "company", "signals", "url")).alias("f"))
    return first.select("row_key", "role", "f.place", "f.full_name", "normal", "link", "f.company", "f.signals", "f.url")


def resolved_emails(decisions: DataFrame, observed: DataFrame, people: DataFrame) -> DataFrame:
    """The address of each person decided on: a public one that fits the name, else one made from the domain's pattern.

    ``decisions``: row_key, role, person_name, website_url, role_status. ``observed``: row_key, ord, email: addresses of the
    company's pages. ``people``: row_key, full_name: whom its pages name. Gives row_key, role, ``status``
    (RESOLVED_PUBLIC, RESOLVED_INFERRED, UNRESOLVED), ``email``, ``score``, ``label``, ``pattern``, ``alternates`` and ``issue``,
    why there is none. A company's addresses and people meet in one row, as large as its pages are.
    Null names and addresses of websites count as missing; addresses that can't be used say nothing.
    """
    local, domain = mail.parts(F.col("email"))
    sound = observed.where(mail.gate(F.col("email"), True).isNull()).select("row_key", "ord", F.lower(F.trim("email")).alias("email"), local.alias("local"), domain.alias("domain"))
    seen = sound.groupBy(F.col("row_key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("ord", "email", "local", "domain"))).alias("_seen"))
    names = people.where("full_name is not null").groupBy(F.col("row_key").alias("_n")).agg(F.sort_array(F.collect_set("full_name")).alias("_names"))
    own = decisions.join(seen, F.col("row_key") == F.col("_k"), "left").join(names, F.col("row_key") == F.col("_n"), "left")
    person = F.coalesce("person_name", F.lit(""))
    own = own.withColumns({"_d": mail.domain_of(F.coalesce("website_url", F.lit(""))), "_person": person})
    at_domain = F.coalesce(F.filter("_seen", lambda a: a["domain"] == F.col("_d")), F.array().cast("array<struct<ord:long,email:string,local:string,domain:string>>"))
    every = F.array_distinct(F.concat(F.array("_person"), F.coalesce("_names", F.array().cast("array<string>"))))
    own = own.withColumns({"_at": at_domain, "_every": every})
    last = mail.name_parts(F.col("_person"))[1]
    fits = lambda a: (mail.classify(a["local"], F.col("_person")) != "UNKNOWN") | F.coalesce((F.length(last) >= 3) & F.contains(a["local"], last), F.lit(False))
    personal = F.filter("_at", lambda a: ~a["local"].isin(mail.GENERIC_INBOXES))
    own = own.withColumns({"_public": F.get(F.filter(personal, fits), 0)["email"], "_pattern": mail.inferred_pattern(F.col("_at"), F.col("_every")), "_n": F.size(personal)})
    own = own.withColumn("_made", mail.generated(F.col("_person"), F.col("_d"), F.col("_pattern")))
    top = F.get("_made", 0)
    words = F.when(mail.name_parts(F.col("_person"))[0].isNotNull(), F.size(mail.name_words(F.col("_person"))))
    status, score, label = inferred_confidence(top["score"], F.col("role_status"), F.col("_n"), F.size("_at"), F.col("_pattern.pattern"), words)
    issue = F.when(F.col("_person") == "", "NO_PERSON").when(F.col("_d") == "", "NO_DOMAIN").when(F.col("_d").isin(mail.PERSONAL_DOMAINS), "PERSONAL_DOMAIN")
    issue = issue.when(F.col("_public").isNotNull(), F.lit(None)).when(F.size("_made") == 0, "NO_CANDIDATE").when(status == "UNRESOLVED", "LOW_CONFIDENCE")
    own = own.withColumn("issue", issue)
    early = F.coalesce(F.col("issue").isin("NO_PERSON", "NO_DOMAIN", "PERSONAL_DOMAIN", "NO_CANDIDATE"), F.lit(False))
    public = F.col("_public").isNotNull() & ~early
    pick = lambda if_public, made, none: F.when(early, none).when(public, if_public).otherwise(made)
    null = F.lit(None)
    return own.select(
        "row_key", "role", pick(F.lit("RESOLVED_PUBLIC"), status, F.lit("UNRESOLVED")).alias("status"),
        pick(F.col("_public"), F.when(status != "UNRESOLVED", top["email"]), null).alias("email"),
        pick(F.lit(95), score, F.lit(0)).cast("int").alias("score"), pick(F.lit("STRONG"), label, null).alias("label"),
        pick(null.cast("string"), F.col("_pattern.pattern"), null).alias("pattern"),
        F.coalesce(pick(null.cast("array<string>"), F.transform(F.slice("_made", 2, 5), lambda c: c["email"]), null), F.array().cast("array<string>")).alias("alternates"), "issue")


def guessed_emails(contacts: DataFrame) -> DataFrame:
    """The provider of last resort: an address for each contact from the addresses known at its company's domain.

    ``contacts``: contact_id, full_name, first_name, last_name, company_domain, known (array of addresses), allow_role. Gives contact_id,
    ``email``, ``status`` (a guess stays ``guessed``, without an address ``unavailable``), ``confidence``, ``outcome``
    (found, not_found) and ``reason``. Nulls count as missing.
    """
    joined = F.trim(F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit(""))))
    own = contacts.withColumns({"_name": F.coalesce("full_name", joined), "_d": F.coalesce("company_domain", F.lit(""))})

    def known(e: Column) -> Column:
        local, domain = mail.parts(e)
        return F.when((domain == F.col("_d")) & mail.gate(e, True).isNull(), F.struct(F.lower(e).alias("email"), local.alias("local")))

    seen = F.filter(F.transform(F.coalesce("known", F.array().cast("array<string>")), known), lambda a: a.isNotNull())
    own = own.withColumn("_pattern", let(seen, lambda a: mail.inferred_pattern(a, F.array("_name"))))
    own = own.withColumn("_top", F.get(mail.generated(F.col("_name"), F.col("_d"), F.col("_pattern")), 0))
    gate = mail.gate(F.col("_top.email"), F.col("allow_role"))
    reason = F.when(F.col("_name") == "", "no person name").when(F.col("_top").isNull(), "no candidate").when(gate.isNotNull(), F.concat(F.lit("rejected: "), gate))
    found = reason.isNull()
    return own.select("contact_id", F.when(found, F.col("_top.email")).alias("email"), F.when(found, "guessed").otherwise("unavailable").alias("status"), F.when(found, F.col("_top.score")).alias("confidence"), F.when(found, "found").otherwise("not_found").alias("outcome"), reason.alias("reason"))
