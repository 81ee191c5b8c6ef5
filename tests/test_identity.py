"""Patterns, addresses and people against plain versions, and with nothing to go by."""

import random

from pyspark.sql import functions as F

from sparrowlens.functions import email as mail
from sparrowlens.operators import identity

FORMS = {"FIRST_LAST": "{f}.{l}", "FIRSTLAST": "{f}{l}", "F_LAST": "{i}{l}", "F.DOT.LAST": "{i}.{l}", "FIRST": "{f}", "LAST": "{l}"}


def form(pattern, name):
    f, *_, last = name.lower().split()
    return FORMS[pattern].format(f=f, l=last, i=f[0])


def told(local, name):
    for pattern in FORMS:
        if local == form(pattern, name):
            return pattern
    f, *_, last = name.lower().split()
    return "F_LAST" if local.startswith(f[0]) and local.endswith(last) and len(local) > len(last) else None


def shaped(local):
    a, dot, b = local.partition(".")
    if not dot or not b.isalpha() or len(b) < 2 or not a.isalpha():
        return None
    return "FIRST_LAST" if len(a) > 1 else "F.DOT.LAST"


def plain_pattern(locals_, names):
    if not locals_:
        return None
    own = [x for x in locals_ if x not in mail.GENERIC_INBOXES]
    votes = [p for x in own for n in names if (p := told(x, n))]
    named = bool(votes)
    votes = votes or [p for x in own if (p := shaped(x))]
    if not votes:
        return "UNKNOWN", 30 if own else 10, named
    best = max(dict.fromkeys(votes), key=votes.count)
    return best, 50 + 25 * (votes.count(best) > 1) + 10 * (len(own) > 1) + 15 * named, named


def test_patterns_and_candidates(spark):
    rng = random.Random(8)
    people = ["Ann Lee", "Bob Kim", "Cy Ann Moss", "Dora Lee"]
    rows = []
    for i in range(250):
        locals_ = [rng.choice(["info", "team", "xyz", "j.roe", "jo.roe", *[form(rng.choice([*FORMS]), n) for n in people]]) for _ in range(rng.randrange(0, 5))]
        rows.append((i, [(f"{x}@d.example", x) for x in locals_], rng.sample(people, rng.randrange(1, 4))))
    frame = spark.createDataFrame(rows, "id long, a array<struct<email:string,local:string>>, n array<string>")
    found = frame.withColumn("p", mail.inferred_pattern(F.col("a"), F.col("n"))).withColumn("g", mail.generated(F.get("n", 0), F.lit("d.example"), F.col("p")))
    for r in found.collect():
        want = plain_pattern([x for _, x in rows[r.id][1]], rows[r.id][2])
        assert (tuple(r.p) if r.p else None) == want, r
        name = r.n[0]
        order = ([(want[0], want[1])] if want and want[0] != "UNKNOWN" and want[1] >= 40 else []) + [(p, max(want[1] - 20, 20) if want else 30) for p in ("FIRST_LAST", "FIRSTLAST", "FIRST", "F.DOT.LAST", "F_LAST")]
        made = {}
        for p, score in order:
            made.setdefault(form(p, name) + "@d.example", (p, score))
        assert [(g.email, g.pattern, g.score) for g in r.g] == [(e, *x) for e, x in made.items()][:5]


def test_identities(spark):
    schema = "row_key long, role string, company_name string, place long, title string, snippet string, url string, link_type string, signals array<string>"
    rows = [
        (1, "CEO", "Acme Tools", 1, "Ann Lee - CEO at Acme | LinkedIn", "", "https://www.linkedin.com/in/ann-lee?x=1#y", "PERSON_PROFILE", ["base"]),
        (1, "CEO", "Acme Tools", 2, "Ann Lee - Founder", None, "https://www.linkedin.com/in/ann-lee", "PERSON_PROFILE", None),  # the same profile again
        (1, "CEO", "Acme Tools", 3, "Ann  Lee, Acme Tools", "", "https://x.example", None, []),
        (1, "CEO", "Acme Tools", 4, "Post by Bob Kim", "Bob Kim is here", "https://x.example", None, []),
        (1, "CEO", "Acme Tools", 5, "Bob Kim", "free shipping", "https://x.example", None, []),
        (1, "CEO", "Acme Tools", 6, None, None, None, None, None),
        (2, "HEAD_OF_GROWTH", None, 1, "Profil", "growth lead", "https://linkedin.com/in/cy-moss-12", "PERSON_PROFILE", []),
        (2, "OTHER", "", 2, "", "Dora Hill is the ceo", "u", "COMPANY_PAGE", []),
    ]
    got = {(r.row_key, r.role, r.normal, r.link): (r.full_name, r.company, r.signals) for r in identity.identity_candidates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, "CEO", "ann lee", "https://www.linkedin.com/in/ann-lee"): ("Ann Lee", "", ["base", "linkedin-profile-name", "LINKEDIN_TITLE_ROLE_MATCH", "COMPANY_MATCH_FROM_TITLE", "LINKEDIN_PROFILE_SLUG_MATCHES_NAME", "role-evidence"]),
        (1, "CEO", "ann lee", ""): ("Ann  Lee", "Acme Tools", ["title-name"]),
        (2, "HEAD_OF_GROWTH", "cy moss", "https://linkedin.com/in/cy-moss-12"): ("Cy Moss", "", ["linkedin-profile-name", "LINKEDIN_PROFILE_SLUG_MATCHES_NAME", "role-evidence"]),
        (2, "OTHER", "dora hill", ""): ("Dora Hill", "", ["snippet-name"]),
    }


def test_addresses_with_nothing_to_go_by(spark):
    decisions = spark.createDataFrame([(1, "CEO", None, "https://a.example", None), (2, "CEO", "Ann Lee", None, None), (3, "CEO", "Ann", "a.example", "RESOLVED_STRONG"), (4, "CEO", "Ann von der Lee Moss", "a.example", None), (5, "CEO", "Ann Lee", "gmail.com", None), (6, "CEO", "Ann Lee", "www.a.example/x", "RESOLVED_PROBABLE")], "row_key long, role string, person_name string, website_url string, role_status string")
    observed = spark.createDataFrame([(6, 2, "A.LEE@a.example"), (6, 1, "leeann@a.example"), (6, 0, "lee@other.example"), (6, 3, None), (6, 4, "x@y@a.example"), (4, 1, "info@a.example")], "row_key long, ord long, email string")
    people = spark.createDataFrame([], "row_key long, full_name string")
    got = {r.row_key: (r.status, r.email, r.score, r.label, r.issue) for r in identity.resolved_emails(decisions, observed, people).collect()}
    assert got == {
        1: ("UNRESOLVED", None, 0, None, "NO_PERSON"),
        2: ("UNRESOLVED", None, 0, None, "NO_DOMAIN"),
        3: ("UNRESOLVED", None, 0, None, "NO_CANDIDATE"),
        4: ("UNRESOLVED", None, 20 - 25 - 20 - 15, None, "LOW_CONFIDENCE"),
        5: ("UNRESOLVED", None, 0, None, "PERSONAL_DOMAIN"),
        6: ("RESOLVED_PUBLIC", "leeann@a.example", 95, "STRONG", None),
    }
    contacts = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "Ann Lee", None, None, "info.example", ["info@info.example", None, "broken"], True), (3, None, "Ann", "Lee", "a.example", ["b.kim@a.example", "c.moss@a.example"], False)], "contact_id long, full_name string, first_name string, last_name string, company_domain string, known array<string>, allow_role boolean")
    got = {r.contact_id: (r.email, r.status, r.confidence, r.outcome, r.reason) for r in identity.guessed_emails(contacts).collect()}
    assert got == {1: (None, "unavailable", None, "not_found", "no person name"), 2: ("ann.lee@info.example", "guessed", 20, "found", None), 3: ("a.lee@a.example", "guessed", 85, "found", None)}
