"""Personal data by bootstrapped contextual extraction.

Strict patterns find seed entities. The words around seeds are lexical patterns; Spark scores the
graph of patterns and instances in rounds, and patterns of high confidence discover identifiers
that the strict patterns don't see, such as numbers without a country code or masked addresses.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

KINDS = ("email", "ip", "card", "phone")
#: Accepted instances and documents that a pattern needs; confidence that a pattern and a discovery need.
LEAST_VALUES, LEAST_DOCS, PATTERN_CONFIDENCE, CONFIDENCE = 3, 3, 0.8, 0.9
#: How much an instance that nothing is known of yet counts against a pattern.
UNKNOWN = 0.25

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# loose shapes; each starts where no run of its own characters goes on, so a run is read once
_MASKED_AT = re.compile(r"[\[({]at[\])}]", re.I)
_MASKED_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]++)+", re.I)
_MASKED_IP = re.compile(r"(?<![0-9])[0-9]++(?:\[\.\][0-9]++){3}")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _local_start(text: str, low: int, end: int) -> int:
    """Where the run of mailbox characters that ends at ``end`` starts, not before ``low``."""
    return low + len(text[low:end].rstrip(_LOCAL))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @, so that every character is looked at a bounded number of times."""
    end = 0  # nothing before it can be part of a mailbox: it's taken, or lies before an @
    at = text.find("@")
    while at >= 0:
        start = _local_start(text, end, at)
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    found = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def shape(value: str) -> list[str]:
    """The kinds that a loosely found value could be."""
    if re.search(r"[\[({]at[\])}]", value, re.I):
        return ["email"]
    if "[.]" in value:
        return ["ip"]
    n = sum(c.isdigit() for c in value)
    return ["phone"] * (7 <= n <= 15) + ["card"] * (13 <= n <= 19)


def masked_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a bracketed ``at``, found from it as ``emails`` are from the @."""
    end = 0
    for at in _MASKED_AT.finditer(text):
        if at.start() < end:
            continue
        stop = at.start() - (text[at.start() - 1 : at.start()] == " ")
        start = _local_start(text, end, stop) if stop > end else stop
        m = _MASKED_DOMAIN.match(text, at.end()) if start < stop else None
        if m:
            yield start, m.end()
        end = m.end() if m else at.end()


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans shaped like an identifier that touch neither base spans nor one another (the leftmost stays)."""
    found = sorted([*masked_emails(text), *(m.span() for m in _MASKED_IP.finditer(text)), *(m.span() for m in _NUMBER.finditer(text))])
    inside = sorted((s, e) for _, s, e in taken)
    at, reach, last = 0, 0, 0  # base spans that start before a span's end, the furthest end of those, the end of the last span
    for s, e in found:
        before = text[s - 1 : s]
        while at < len(inside) and inside[at][0] < e:
            reach, at = max(reach, inside[at][1]), at + 1
        if s >= reach and s >= last and not (before.isalnum() or before in (".", "+") or text[e : e + 1].isalnum()):
            yield s, e
            last = e


class Words:
    """Where the words of a text lie, found once, so that those beside any span are looked up however far away they are."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, array("l"), array("l")
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def before(self, at: int, n: int = 2) -> list[str]:
        """The last ``n`` words before a place; of a word that reaches beyond it what lies before."""
        last = bisect_left(self.starts, at)
        return [self.text[self.starts[i] : min(at, self.ends[i])] for i in range(max(0, last - n), last)]

    def after(self, at: int, n: int = 2) -> list[str]:
        first = bisect_right(self.ends, at)
        return [self.text[max(at, self.starts[i]) : self.ends[i]] for i in range(first, min(len(self.ends), first + n))]


def contexts(words: Words, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: the two words before it and the two after it, in lower case, whatever lies between."""
    before, after = words.before(start), words.after(end)
    return (["<" + " ".join(before).lower()] if len(before) == 2 else []) + ([">" + " ".join(after).lower()] if len(after) == 2 else [])


SCAN = "row long, key long, base array<struct<kind:string,start:int,stop:int>>, mentions array<struct<kinds:array<string>,seed:boolean,value:string,start:int,stop:int,patterns:array<string>>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One pass over whole texts: base spans, and mentions (seeds and loosely shaped spans) with their patterns.

    With ``carry`` the whole row of ``docs`` comes along as ``doc``, so that it needn't be joined back.
    """

    def found(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        mention = pa.struct([("kinds", pa.list_(pa.string())), ("seed", pa.bool_()), ("value", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("patterns", pa.list_(pa.string()))])
        for batch in batches:
            bases, mentions = [], []
            for t in batch.column(1):
                t = t.as_py()
                base = base_spans(t)
                bases.append([{"kind": k, "start": s, "stop": e} for k, s, e in base])
                spans = [([k], True, s, e) for k, s, e in base] + [(kinds, False, s, e) for s, e in (loose_spans(t, base) if t else ()) if (kinds := shape(t[s:e]))]
                words = Words(t) if spans else None
                own = [{"kinds": kinds, "seed": seed, "value": t[s:e].lower(), "start": s, "stop": e, "patterns": contexts(words, s, e)} for kinds, seed, s, e in spans]
                mentions.append(own)
            columns = [batch.column(2), batch.column(0), pa.array(bases, pa.list_(kind)), pa.array(mentions, pa.list_(mention))]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column(3)] if carry else []), names=["row", "key", "base", "mentions", "doc"][: 4 + carry])

    columns = [F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")]
    schema = T.StructType.fromDDL(SCAN)
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        schema.add("doc", T.StructType(docs.schema.fields))
    return docs.select(*columns).mapInArrow(found, schema)


def score_graph(mentions: DataFrame) -> DataFrame:
    """Discovered instances (kind, value) with their ``confidence``.

    ``mentions``: row, kinds, seed, value, pattern. Seeds are accepted from the start and sure. In
    each round the patterns of accepted instances are scored: a pattern's confidence in a kind is
    that of the distinct accepted instances that it stands beside, against that and UNKNOWN times
    what isn't sure. It needs LEAST_VALUES accepted values and LEAST_DOCS documents (counted by the
    first and last of each value), so chance contexts drop out. An instance's confidence joins its
    patterns' by noisy-or; with CONFIDENCE it is accepted for good, and induces patterns in the next
    round. Rounds end when one accepts nothing more.
    """
    edges = mentions.select(F.explode("kinds").alias("kind"), "value", "seed", "pattern", "row")
    edges = materialise(edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"), F.min("row").alias("first"), F.max("row").alias("last")), "graph")
    known, size = edges.where("false").select("kind", "value", F.lit(1.0).alias("confidence")), 0
    while True:
        had = known.select(F.col("kind").alias("k"), F.col("value").alias("v"), "confidence")
        now = edges.join(had, (edges.kind == had.k) & (edges.value == had.v), "left") if size else edges.withColumn("confidence", F.lit(None).cast("double"))
        now = now.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))))
        accepted = F.col("score") > 0
        # half an instance of doubt keeps small patterns from being certain
        belief = F.sum("score") / (F.sum("score") + UNKNOWN * F.sum(1.0 - F.col("score")) + 0.5)
        patterns = now.groupBy("kind", "pattern").agg(belief.alias("p"), F.sum(accepted.cast("long")).alias("n"))
        patterns = patterns.where((F.col("p") >= PATTERN_CONFIDENCE) & (F.col("n") >= LEAST_VALUES))
        docs = now.where(accepted).select("kind", "pattern", F.explode(F.array("first", "last")).alias("row")).groupBy("kind", "pattern").agg(F.countDistinct("row").alias("d"))
        patterns = patterns.join(docs.where(F.col("d") >= LEAST_DOCS), ["kind", "pattern"]).select(F.col("kind").alias("k"), F.col("pattern").alias("x"), "p")
        doubt = F.sum(F.log(1.0 - F.least("p", F.lit(0.999))))
        found = edges.where(~F.col("seed")).join(patterns, (F.col("kind") == F.col("k")) & (F.col("pattern") == F.col("x")))
        found = found.groupBy("kind", "value").agg((1.0 - F.exp(doubt)).alias("confidence")).where(F.col("confidence") >= CONFIDENCE)
        # accepted for good, with the greatest confidence it had
        known = materialise(found.unionByName(known).groupBy("kind", "value").agg(F.max("confidence").alias("confidence")), "accepted")
        grown = known.count()
        if grown == size:
            return known
        size = grown


def with_spans(table: DataFrame) -> DataFrame:
    """A written ``scan`` with ``spans``: the base spans and what patterns discover. Only discoveries are joined to it."""
    found = score_graph(table.select("row", F.inline("mentions")).withColumn("pattern", F.explode("patterns")).drop("patterns"))
    loose = table.select("row", F.inline("mentions")).where(~F.col("seed")).select("row", "value", "start", "stop", F.explode("kinds").alias("kind"))
    best = loose.join(found, ["kind", "value"]).groupBy("row", "start", "stop").agg(F.min_by("kind", F.struct(-F.col("confidence"), "kind")).alias("kind"))
    # written, so that its size is known: Spark broadcasts it below its threshold and shuffles beyond
    added = materialise(best.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added")), "discovered")
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,stop:int>>")))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(F.element_at(place, s["kind"]).alias("o"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return table.drop("mentions").join(added, F.col("row") == F.col("r"), "left").withColumn("spans", spans).drop("r", "added")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``base`` and ``spans``.

    Both are arrays of kind, start and stop (code points, end exclusive) by kind as in KINDS, then
    start; ``spans`` also has what patterns discover and never loses a base span. A discovered span
    has the kind of the greatest confidence, ties by kind. What is accepted is a value: it then counts
    wherever it is written as a loose shape, also without such a pattern beside it. Null and empty texts have no spans; rows
    with null or repeated keys keep their own; further columns, also ones named like the results,
    are left out. An empty table gives an empty result. Texts are read whole in one pass, and every
    scanner takes time in proportion to a text's length.
    """
    return with_spans(materialise(scan(docs, key, text), "mentions")).select(F.col("key").alias(key), "base", "spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def cover(text: str, spans: list) -> str:
    """The text with each span, or run of spans that overlap, replaced by the kind of the first in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["stop"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all found spans replaced in ``text`` and ``n_chars`` set to the new length; other columns as given.

    Every row keeps its place in the result, also if it repeats another or has a null ``doc_id``;
    null and empty texts stay, and so does an empty table. Columns of any further name come through
    unchanged. Rows are carried through the scan and not joined back to their texts.
    """
    table = with_spans(materialise(scan(docs, carry=True), "mentions"))

    @F.pandas_udf("string")
    def covered(texts, found):
        import pandas as pd

        return pd.Series([t if not len(f) else cover(t, f) for t, f in zip(texts, found)], dtype=object)

    out = table.withColumn("_text", covered("doc.text", "spans"))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.size("spans") == 0, F.col("doc.n_chars")).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in columns.items()])
