"""Scores and decisions about people found for a role: candidates, plausible names, statuses and what is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.email import domain_of
from ..functions.text import without_accents

# Patterns of contexts that count against a candidate.
RECRUITER = [r"\brecruit", r"\bjob\s+post", r"\bhiring\b", r"\bcareer", r"\bglassdoor", r"\bindeed\.com", r"\bapply\s+now"]
DIRECTORY = [r"\bzoominfo", r"\brocketreach", r"\bapollo\.io", r"\bsignalhire", r"\bcontactout", r"\blusha", r"\bpeople\s+directory", r"\bdnb\.com", r"\bbloomberg\.com/profile"]
FORMER = [r"\bformer\b", r"\bex-\b", r"\bpreviously\b", r"\bformerly\b", r"\bleft\b.*\bcompany"]
POST = [r"^beitrag von\b", r"^post by\b", r"^post von\b", r"\bactivity-\d+", r"/posts?/"]
# Signals of a parsed candidate and their points.
SIGNALS = {"LINKEDIN_TITLE_ROLE_MATCH": 25, "role-evidence": 20, "LINKEDIN_PROFILE_SLUG_MATCHES_NAME": 15, "COMPANY_MATCH_FROM_TITLE": 10}
# Patterns of texts that are no names, with the points that each takes.
COMPANY_SUFFIXES = [r"\b(inc|llc|ltd|gmbh|corp|ag|se|bv|sa|srl|pty|plc|co)\b", r"\b(brand|brands|group|holding|holdings|company|enterprises)\b", r"\b(store|stores|shop|boutique|outlet|marketplace)\b"]
SHOP_WORDS = [
    r"\b(dress|dresses|shoes|boots|jacket|jackets|clothing|apparel|fashion)\b",
    r"\b(sustainable|eco-friendly|organic|handmade|artisan|vintage)\b",
    r"\b(collection|lookbook|catalog|sale|clearance|deals)\b",
    r"\b(shipping|returns|warranty|customer service)\b",
    r"\b(onlineshop|webshop|online shop|web shop)\b",
]
MARKETING = [
    r"\b(preisgekr[öo]n|award[\s-]?winning|best[\s-]?selling|top[\s-]?rated)\b",
    r"\b(beitrag von|post by|posted by|shared by|article by)\b",
    r"\b(official site|official page|home page|landing page)\b",
    r"\b(community|resources|support|help center)\b",
    r"\b(management team|leadership team|executive team|our team|meet the team)\b",
    r"\b(the reformation|the company|the brand|the store)\b",
]
NOT_NAMES = [r"^\d", r"[@#$%^&*(){}\[\]<>]", r"^[a-z]", r"(?i)^(www\.|http)", r"(?i)\.(com|org|net|de|co\.uk)\b"]
TOXIC_WORDS = [
    "shop", "store", "brand", "online", "onlineshop", "webshop", "fashion", "clothing", "apparel", "boutique", "outlet", "official",
    "site", "page", "home", "team", "company", "service", "support", "management", "leadership", "collection", "catalog",
    "lookbook", "sale", "preisgekroenter", "preisgekrönter", "award-winning", "inc", "llc", "gmbh",
]
PERSON = r"^[A-ZÀ-ɏ][a-zÀ-ɏ]+(?:\s+(?:de|van|von|der|den|la|le|el|al|di|del|da|dos|das|du|mc|mac|o')?)?(?:\s+[A-ZÀ-ɏ][a-zÀ-ɏ]+){1,3}$"
FILLERS = ["the", "a", "an", "of", "for", "and", "by", "von", "de", "der", "die", "das"]


def _points(cond: Column, n: int) -> Column:
    return F.when(cond, n).otherwise(0)


def _matches(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches, in one pass."""
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def _per_match(text: Column, patterns: list[str], n: int) -> Column:
    """n points for every pattern that matches."""
    return reduce(lambda a, b: a + b, [_points(text.rlike(p if p in NOT_NAMES else "(?i)" + p), n) for p in patterns])


def candidate_ranks(candidates: DataFrame, tasks: DataFrame, website_people: DataFrame, website_links: DataFrame) -> DataFrame:
    """Candidates of each task with ``rank_score`` and their place, the best first, ties by ``ord``.

    ``candidates``: row_key, role, ord, full_name, link, source_title, source_snippet, source_url,
    signals. ``tasks``: row_key, company_name, website_url, region, country. Names and links
    that the website shows too add points; they meet by equality. Null fields count as empty.
    """
    people = website_people.select("row_key", F.lower(F.trim(F.regexp_replace("full_name", r"\s+", " "))).alias("_name")).distinct().withColumn("_seen", F.lit(True))
    links = website_links.select("row_key", F.col("url").alias("link")).distinct().withColumn("_linked", F.lit(True))
    own = candidates.join(tasks.select("row_key", "company_name", "website_url", "region", "country"), "row_key")
    own = own.withColumn("_name", F.lower(F.trim(F.regexp_replace("full_name", r"\s+", " "))))
    own = own.join(people, ["row_key", "_name"], "left").join(links, ["row_key", "link"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    context = F.concat(empty("source_title"), F.lit(" "), empty("source_snippet"), F.lit(" "), empty("source_url"))
    low = F.lower(context)
    token = F.split_part(domain_of(empty("website_url")), F.lit("."), F.lit(1))
    names = F.lower(empty("company_name"))
    post = _matches(empty("source_title"), POST) | _matches(empty("source_url"), POST)
    score = (
        _points(F.contains(empty("link"), F.lit("/in/")), 40)
        + reduce(lambda a, b: a + b, [_points(F.coalesce(F.array_contains("signals", s), F.lit(False)), n) for s, n in SIGNALS.items()])
        + _points(F.contains(low, names), 25)
        + _points((token != "") & F.contains(low, token), 20)
        + _points((F.col("region") == "EU") & (empty("country") != "") & F.contains(low, F.lower(empty("country"))), 10)
        + _points(F.col("_seen").isNotNull(), 8)
        + _points(F.col("_linked").isNotNull(), 8)
        - _points(post, 20)
        - _points(_matches(context, RECRUITER), 25)
        - _points(_matches(context, DIRECTORY), 20)
        - _points(_matches(context, FORMER), 15)
        - _points(F.size(F.split(empty("full_name"), r"\s+")) < 2, 30)
    )
    scored = own.withColumn("rank_score", score)
    place = F.row_number().over(Window.partitionBy("row_key", "role").orderBy(F.desc("rank_score"), "ord"))
    return scored.withColumn("place", place).select("row_key", "role", "ord", "full_name", "rank_score", "place")


def role_status(score: Column, name: Column, has_link: Column, explicit_role: Column, role: Column) -> Column:
    """Strong from 90 with a link, and with evidence of the role unless it is the first one; probable from 65; weak above 0."""
    named = F.coalesce(name, F.lit("")) != ""
    strong = (score >= 90) & named & F.coalesce(has_link, F.lit(False))
    sure = (role == "CEO") | F.coalesce(explicit_role, F.lit(False))
    return F.when(strong & sure, "RESOLVED_STRONG").when(strong | ((score >= 65) & named), "RESOLVED_PROBABLE").when(score > 0, "UNRESOLVED_WEAK").otherwise("UNRESOLVED_NONE")


def overlaps_company(name: Column, company: Column) -> Column:
    """Whether a name is made of the company's words."""
    mine = F.split(without_accents(F.trim(name)), r"\s+")
    theirs = F.filter(F.split(F.regexp_replace(without_accents(F.coalesce(company, F.lit(""))), "'", ""), r"[\s\-&+,]+"), lambda t: F.length(t) >= 3)
    content = lambda a: F.filter(a, lambda t: ~t.isin(FILLERS))
    all_in = F.forall(content(mine), lambda p: F.exists(content(theirs), lambda c: (c == p) | F.contains(c, p) | F.contains(p, c)))
    last = (F.size(content(theirs)) == 1) & (F.size(mine) == 2) & (F.get(mine, 1) == F.get(content(theirs), 0)) & F.get(mine, 0).rlike("|".join(COMPANY_SUFFIXES))
    return (F.size(theirs) > 0) & ((F.array_join(mine, " ") == F.array_join(theirs, " ")) | ((F.size(content(mine)) >= 1) & all_in) | last)


def plausibility(name: Column, company: Column, link: Column, role_label: Column) -> tuple[Column, Column]:
    """(score, status) of a name as a person's: PLAUSIBLE from 60, SUSPICIOUS from 30, else IMPLAUSIBLE.

    Every pattern that matches takes its points. An empty or null name has the score 0.
    """
    own = F.trim(F.coalesce(name, F.lit("")))
    folded = without_accents(own)
    words = F.split(folded, r"\s+")
    url = F.coalesce(link, F.lit(""))
    profile = F.contains(url, F.lit("linkedin.com/in/"))
    slug = F.lower(F.regexp_replace(F.url_decode(F.regexp_extract(url, r"(?i)linkedin\.com/in/([^/?#]+)", 1)), "[-_]", " "))
    in_slug = F.exists(words, lambda w: (F.length(w) >= 3) & F.contains(slug, w))
    score = (
        F.lit(50)
        - _per_match(own, NOT_NAMES, 40)
        - _per_match(own, COMPANY_SUFFIXES, 35)
        - _per_match(own, SHOP_WORDS, 40)
        - _per_match(own, MARKETING, 50)
        - 30 * F.size(F.filter(words, lambda w: w.isin(TOXIC_WORDS)))
        - _points(overlaps_company(own, company), 35)
        - _points(F.size(words) < 2, 30)
        - _points(F.size(words) > 4, 15)
        - _points(own == F.upper(own), 20)
        - _points(own == F.lower(own), 25)
        + _points(own.rlike(PERSON), 25)
        + _points(F.size(words).between(2, 3), 10)
        + _points(profile, 20)
        + F.when(profile & (slug != ""), F.when(in_slug, 15).otherwise(-10)).otherwise(0)
        + F.when(role_label == "STRONG", 10).when(role_label == "PROBABLE", 5).otherwise(0)
    )
    score = F.when(own == "", 0).otherwise(score)
    return score, F.when(score >= 60, "PLAUSIBLE").when(score >= 30, "SUSPICIOUS").otherwise("IMPLAUSIBLE")


def write_actions(fields: DataFrame, allowed: list[str] = ["ELIGIBLE"], overwrite: list[str] = []) -> DataFrame:  # noqa: B006
    """What happens to each field: the first rule that holds, in the order below; fields without a column and value go.

    ``fields``: row_key, role, field, status, value, old_value, column_exists. ``overwrite`` names
    kinds of fields (the last word of a field) that may replace what a cell holds.
    """
    value, old = F.trim(F.coalesce("value", F.lit(""))), F.coalesce("old_value", F.lit(""))
    kind = F.element_at(F.split("field", "_"), -1)
    action = (
        F.when(~F.col("column_exists"), "SKIP_COLUMN_MISSING").when(value == "", "SKIP_EMPTY_VALUE").when(F.col("status") == "BLOCKED", "SKIP_BLOCKED")
        .when((F.col("status") == "REVIEW") & F.lit("REVIEW" not in allowed), "SKIP_NOT_APPROVED").when((old != "") & ~kind.isin(overwrite), "SKIP_EXISTING_VALUE").otherwise("WRITE_CELL")
    )
    return fields.where(F.col("column_exists") | (F.coalesce("value", F.lit("")) != "")).select("row_key", "role", "field", action.alias("action"), F.when(action.isin("SKIP_COLUMN_MISSING"), "").otherwise(old).alias("old_value"), F.when(value != "", F.col("value")).alias("new_value"))


def action_summary(actions: DataFrame) -> DataFrame:
    """Counts of actions by kind, by role and in all, over grouping sets in one pass."""
    return actions.groupingSets([["action"], ["role"], []], "action", "role").agg(F.count("*").alias("n"), F.sum(F.when(F.col("action") == "WRITE_CELL", 1).otherwise(0)).alias("writes"))


def field_eligibility(found: DataFrame) -> DataFrame:
    """A row per field (name, link, address) of a found person: ELIGIBLE, REVIEW or BLOCKED, its value and ``overall``.

    ``found``: row_key, role, full_name, link, plausibility, role_status, email, email_status,
    email_label. A blocked field has no value. Overall is the worst of the fields with a value,
    BLOCKED if there is none. Null or empty fields are blocked.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    bad, doubtful = F.col("plausibility") == "IMPLAUSIBLE", F.col("plausibility") == "SUSPICIOUS"
    resolved = F.coalesce(F.col("role_status").isin("RESOLVED_STRONG", "RESOLVED_PROBABLE"), F.lit(False))
    person = F.when(doubtful | ~resolved, "REVIEW").otherwise("ELIGIBLE")
    name = F.when(F.col("full_name").isNull() | bad, "BLOCKED").otherwise(person)
    link = F.when(~said("link") | bad | ~F.contains("link", F.lit("/in/")), "BLOCKED").otherwise(person)
    public, inferred = F.col("email_status") == "RESOLVED_PUBLIC", F.col("email_status") == "RESOLVED_INFERRED"
    email = (
        F.when(~said("email") | bad, "BLOCKED").when(public, F.when(doubtful, "REVIEW").otherwise("ELIGIBLE"))
        .when(inferred & ~doubtful & (F.col("email_label") == "STRONG"), "ELIGIBLE").when(inferred & ~doubtful & (F.col("email_label") == "PROBABLE"), "REVIEW").otherwise("BLOCKED")
    )
    each = F.array(*[F.struct(F.concat(F.col("role"), F.lit(f"_{n}")).alias("field"), s.alias("status"), F.when(s != "BLOCKED", F.col(c)).alias("value")) for n, s, c in (("NAME", name, "full_name"), ("LINKEDIN", link, "link"), ("EMAIL", email, "email"))])
    states = F.transform(F.filter("_fields", lambda f: f["value"].isNotNull()), lambda f: f["status"])
    overall = F.when(F.size(states) == 0, "BLOCKED").when(F.array_contains(states, "REVIEW"), "REVIEW").otherwise("ELIGIBLE")
    return found.withColumn("_fields", each).withColumn("overall", overall).select("row_key", "role", "overall", F.inline("_fields"))


def to_enrich(contacts: DataFrame, reason: str | None = None, again: bool = False) -> DataFrame:
    """Contacts that an enrichment run may look up: none that opted out, with a reason and a domain.

    ``contacts``: id, status, opt_out, email, email_status, reason, domain. Contacts with an address
    are left alone unless it failed, or ``again`` asks for all. ``reason`` stands in for null ones.
    """
    out = (F.coalesce("opt_out", F.lit(0)) == 1) | F.coalesce(F.col("status").isin("unsubscribed", "bounced"), F.lit(False))
    why = F.coalesce("reason", F.lit(reason), F.lit(""))
    settled = (F.trim(F.coalesce("email", F.lit(""))) != "") & F.coalesce(F.col("email_status"), F.lit("")).isin("", "verified") & F.lit(not again)
    return contacts.where(~out & (why != "") & ~settled & (F.coalesce("domain", F.lit("")) != "")).withColumn("reason", why)


# Words that say a role, contexts that weaken people found once, and pages that speak for them.
ROLE_WORDS = {
    "CEO": ["ceo", "chief executive", "founder", "co-founder", "cofounder", "managing director", "geschäftsführer", "geschaeftsfuehrer"],
    "HEAD_OF_PRODUCT": ["head of product", "vp product", "vp of product", "product director", "chief product officer", "cpo", "director of product"],
    "HEAD_OF_ECOMMERCE": ["head of ecommerce", "head of e-commerce", "ecommerce director", "e-commerce director", "director of ecommerce", "director of e-commerce", "digital commerce"],
    "HEAD_OF_GROWTH": ["head of growth", "cmo", "chief marketing officer", "marketing director", "vp marketing", "vp of marketing", "director of marketing"],
}
CAREERS = [r"\bcareer", r"\bjobs?\b", r"\bhiring", r"\brecruit"]
ARTICLE = [r"\barticle\b", r"\bpost\b", r"\bnews\b", r"\bblog\b", r"\bpodcast\b"]
SPEAKING_PAGES = ["ABOUT", "TEAM", "LEADERSHIP", "LEGAL", "HOMEPAGE"]


def says_role(role: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.coalesce(F.element_at(F.create_map(*[x for r, w in ROLE_WORDS.items() for x in (F.lit(r), F.array(*map(F.lit, w)))]), role), F.array().cast("array<string>"))
    return F.exists(words, lambda w: F.contains(low, w))


def cluster_scores(clusters: DataFrame) -> DataFrame:
    """Score, explicit evidence of the role and status of each person found for a role.

    ``clusters``: row_key, role, name, link, base_score, n_search (search results that show the
    person), search_text, website (array of structs of title, page_type and hints) and n_links
    (profiles of the site that agree). Nulls count as empty.
    """
    site = F.coalesce("website", F.array().cast("array<struct<title:string,page_type:string,hints:array<string>>>"))
    hinted = F.exists(site, lambda w: F.size(F.coalesce(w["hints"], F.array().cast("array<string>"))) > 0)
    site_text = F.array_join(F.transform(site, lambda w: F.concat_ws(" ", w["title"], F.array_join(w["hints"], " "))), " ")
    explicit = says_role(F.col("role"), F.col("search_text")) | (hinted & says_role(F.col("role"), site_text))
    every = F.concat_ws(" ", "search_text", F.array_join(F.transform(site, lambda w: F.coalesce(w["title"], F.lit(""))), " "))
    linked, once = F.coalesce(F.col("link"), F.lit("")) != "", F.col("n_search") <= 1
    score = (
        F.col("base_score")
        + _points(F.col("n_search") >= 2, 20)
        + _points(hinted, 15)
        + _points(F.col("n_links") > 0, 10)
        + _points(F.exists(site, lambda w: F.coalesce(w["page_type"].isin(SPEAKING_PAGES), F.lit(False))), 8)
        - _points(_matches(every, CAREERS) & ~linked & once, 20)
        - _points(~linked & once, 15)
        - _points(_matches(every, ARTICLE) & ~linked & once, 25)
        - _points(_matches(every, DIRECTORY[:-1]) & once & (F.size(site) == 0), 30)
        - _points((F.col("role") != "CEO") & ~explicit & (F.col("n_search") > 0), 20)
    )
    own = clusters.withColumns({"score": score, "explicit_role": explicit})
    vouched = F.exists(site, lambda w: (F.size(F.coalesce(w["hints"], F.array().cast("array<string>"))) > 0) & F.coalesce(w["page_type"].isin(SPEAKING_PAGES), F.lit(False)))
    backed = linked | vouched
    return own.select("row_key", "role", "name", "score", "explicit_role", role_status(F.col("score"), F.col("name"), backed, F.col("explicit_role"), F.col("role")).alias("status"))
