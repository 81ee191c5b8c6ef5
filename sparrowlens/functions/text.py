"""Text functions: keys, terms, phrases, names and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.nodes import let

# Fixed values.
STOPWORDS = ["and", "or", "the", "with", "for", "not", "without", "under", "over", "from", "into", "best", "shop", "all", "new", "sale", "inch", "inches", "in", "on", "by", "to", "of", "a", "an"]
VARIANT_WORDS = ["exclusive", "new", "fit", "hb", "lined", "lightweight", "classic"]
COLOR_WORDS = ["black", "white", "blue", "navy", "green", "red", "brown", "tan", "khaki", "grey", "gray", "olive", "natural", "stone", "cream"]
# Suffixes of a company's site.
SUFFIX = r"_(?:com|net|org|io|co_\w+|cz|de|uk|fr|es|pl|at|nl|be|ch|se|dk|fi|no|pt|hu|ro|sk|si|ie|eu|us|ca|it)$"
# Letters that become two, and letters without their accent.
WIDE_ACCENTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
ACCENTED = "àáâãåèéêëìíîïòóôõùúûñçðøýÿžščřďťňěůłąęćźśőű"
UNACCENTED = "aaaaaeeeeiiiioooouuuncdoyyzscrdtneulaeczsou"


def normal_key(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def website_key(url: Column) -> Column:
    """The key of a site's first host label, without scheme and www."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^https?://", ""), r"^www\.", "")
    return normal_key(F.split_part(F.split_part(host, F.lit("/"), F.lit(1)), F.lit("."), F.lit(1)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def host_slug(url: Column) -> Column:
    """A site's host as a name for files: without www., other characters than letters and digits as one underscore."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.replace(F.when(host != "", host).otherwise(url), F.lit("www."), F.lit("")), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")


def company_slug(slug: Column) -> Column:
    """A host's slug without www and the suffix of its country or kind."""
    return F.regexp_replace(F.regexp_replace(slug, "^www_", ""), SUFFIX, "")


def locale_order(text: Column) -> Column:
    """A text to sort by as people do: letters before their case and accents."""
    return F.collate(text, "UNICODE")


def title_words(key: Column) -> Column:
    """Words of a dashed key with a capital first letter, the rest unchanged."""
    return F.array_join(F.transform(F.filter(F.split(key, "[-_ ]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def without_accents(text: Column) -> Column:
    """Lower-case text with accents folded; ae, oe, ue and ss for the letters that need two."""
    out = F.lower(text)
    for letter, pair in WIDE_ACCENTS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.translate(out, ACCENTED, UNACCENTED)


def _singular(token: Column) -> Column:
    return F.when(F.length(token) > 4, F.regexp_replace(token, "s+$", "")).otherwise(token)


def query_terms(query: Column) -> Column:
    """Distinct terms in order: letters and digits, no stop words, without final s, two characters or more."""
    words = F.transform(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0)), _singular)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) >= 2)))


def family_key(title: Column) -> Column:
    """A title without numbers, colours and variant words: what variants of a product share."""
    key = F.regexp_replace(F.lower(title), r"\b\d+(?:\.\d+)?\b", " ")
    key = F.regexp_replace(key, r"[^a-z0-9\s-]", " ")
    words = F.filter(F.split(key, r"\s+"), lambda w: (w != "") & ~w.isin(COLOR_WORDS + VARIANT_WORDS))
    return F.trim(F.regexp_replace(F.array_join(F.transform(words, _singular), " "), r"\s+", " "))


def phrases(query: Column, stopwords: list[str] = STOPWORDS, least: int = 5) -> Column:
    """Pairs of neighbouring words and words of a query, distinct, the longest key first, ties in order."""
    words = F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(stopwords))
    return let(words, lambda own: _phrases(own, least))


def _phrases(words: Column, least: int) -> Column:
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    sized = F.transform(F.array_distinct(F.concat(pairs, words)), lambda p, i: F.struct((-F.length(normal_key(p))).alias("n"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(F.filter(sized, lambda s: s["n"] <= -least)), lambda s: s["p"])


def trimmed(text: Column, limit: int = 160) -> Column:
    """The first sentence if it fits, else whole words up to the limit and an ellipsis."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    sentence = F.regexp_extract(clean, r"^(.*?[.!?])(?:\s|$)", 1)
    cut = F.regexp_replace(F.left(clean, F.lit(limit)), r"\s+\S*$", "")
    return F.when((sentence != "") & (F.length(sentence) <= limit), sentence).when(F.length(clean) <= limit, clean).otherwise(F.concat(cut, F.lit("…")))


def without_fences(text: Column) -> Column:
    """Text without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def fill_template(template: Column, variables: Column) -> Column:
    """``{{name}}`` replaced from a map; unknown names stay as they are."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))
    put = lambda text, name: F.replace(text, F.concat(F.lit("{{"), name, F.lit("}}")), F.coalesce(F.element_at(variables, name), F.concat(F.lit("{{"), name, F.lit("}}"))))
    return F.aggregate(names, template, put)


def name_variables(name: Column) -> dict[str, Column]:
    """First, last (of two or more words) and full name."""
    words = F.split(F.trim(name), r"\s+")
    return {"first_name": F.element_at(words, 1), "last_name": F.when(F.size(words) > 1, F.element_at(words, -1)).otherwise(""), "full_name": name}


def headline_stat(zero_rate: Column, outside_rate: Column) -> Column:
    """The sentence that opens a sequence: the zero-result rate from 10 %, else the share outside the top three."""
    from .numbers import half_up, leading_number

    zero, outside = leading_number(zero_rate), leading_number(outside_rate)
    return (
        F.when(zero >= 10, F.concat(half_up(zero).cast("string"), F.lit("% of searches returned zero results — a blank page — for products you stock.")))
        .when(outside.isNotNull(), F.concat(half_up(outside).cast("string"), F.lit("% of searches surfaced the best match outside the top 3 — relevant products pushed out of view.")))
        .otherwise("Relevant products you stock are not surfacing on the first page of search.")
    )


def platform_sentence(solution: Column) -> Column:
    name = F.trim(F.coalesce(solution, F.lit("")))
    return F.concat(F.lit("This is a configuration "), F.when(name != "", F.concat(F.lit("and tuning gap on "), name)).otherwise("gap on your current search stack"), F.lit(" — fixable without replatforming."))


def joined_document(*fields: Column) -> Column:
    """Non-empty fields with a bar between them."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(f), F.lit("")) for f in fields])


def review_id(*fields: Column) -> Column:
    """The first twelve hex digits of the MD5 of the fields, nulls being empty."""
    return F.left(F.md5(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])), F.lit(12))


def xml_escaped(text: Column) -> Column:
    """Text for XML: the five characters that have names are replaced, ampersands first."""
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(char), F.lit(f"&{name};"))
    return text


# Headings and sentences that are taken out of generated sections.
REDUNDANT_HEADINGS = ["# search audit report", "## deep_dives", "## deep dives", "## roadmap", "## roadmap:", "## prioritized roadmap"]
SCROLL_SENTENCES = [
    "Most customers never scroll past position 3.",
    "Most customers never scroll past position 3",
    "most customers never scroll past position 3.",
    "most customers never scroll past position 3",
    "Most users never scroll past position 3.",
    "Most users never scroll past position 3",
    "most users never scroll past position 3.",
    "most users never scroll past position 3",
    "Most shoppers never scroll past position 3.",
    "most shoppers never scroll past position 3.",
]


def section_text(text: Column) -> Column:
    """A generated section without redundant headings and stock sentences, at most one blank line in a row."""
    low = lambda line: F.lower(F.trim(line))
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: ~low(x).isin(REDUNDANT_HEADINGS) & ~F.startswith(low(x), F.lit("# search audit report")))
    out = F.array_join(lines, "\n")
    for sentence in SCROLL_SENTENCES:
        out = F.replace(out, F.lit(sentence), F.lit(""))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
