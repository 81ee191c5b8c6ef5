"""Language identification by Bayesian fusion of text, declared language and address evidence."""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

#: Different labelled texts per language that the text model is fitted on (about), its hashed trigrams, and
#: the languages it may have (it holds a number for each of both; more labels raise).
SAMPLE_PER_LANGUAGE, BUCKETS, MAX_LANGUAGES = 1_000, 1 << 15, 256
#: Trigrams that count at most as independent evidence; pseudo-counts of trigrams and of address levels.
EVIDENCE, ALPHA, STRENGTH = 60, 0.1, 5.0
UNDETERMINED = "und"
_OPENS = re.compile(r"(?i)<(script|style)\b")
_CLOSES = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_LONG_NUMBER = re.compile(r"&#[0-9]{8,}+;?")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-case letters of a whole text, other runs being one space."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    code = np.where(_letters()[code], code, np.uint64(32))
    gap = code == 32
    code = code[~(gap & np.concatenate([[False], gap[:-1]]))]
    if len(code) < 3:
        return np.zeros(0, np.int64)
    h = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1]) * np.uint64(0x85EBCA77) + code[2:]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)


@dataclass
class TextModel:
    """Log probabilities of hashed trigrams, a row per language and one, all alike, for none of them."""

    languages: list[str]
    log_p: np.ndarray

    def log_likelihood(self, text: str | None) -> np.ndarray:
        """Evidence of a text per language; trigrams overlap, so long texts count as ``EVIDENCE`` of them."""
        found = trigrams(text)
        if not len(found):
            return np.zeros(len(self.languages))
        total = sum(self.log_p[:, found[at : at + 65536]].sum(axis=1) for at in range(0, len(found), 65536))
        return total * (min(len(found), EVIDENCE) / len(found))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> TextModel:
    """A naive Bayes trigram model from about ``per_language`` different labelled texts of each language, chosen by hash.

    A label counts by its first subtag in lower case. The sample bounds the fit, and copies of a
    text count once in it. A count for each language and hashed trigram reaches the driver, so more
    than ``max_languages`` labels raise ValueError: none is left out silently. Rows with a null label
    or text take no part; without any the model has no language but ``und``. Whatever is identified
    is read in full.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.lower(F.substring_index(F.col(label), "-", 1)).alias("l"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} different labels")
    names = sorted(sizes)
    share = F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(max(1, sizes[n] // per_language)))]), F.col("l")) if names else F.lit(1)
    chosen = rows.where(F.pmod(F.col("h"), share) == 0).groupBy("l", "h").agg(F.first("t").alias("t")).select("t", "l")

    def counted(batches):
        total = np.zeros((len(names), BUCKETS))
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist()):
                total[names.index(name)] += np.bincount(trigrams(t.as_py()), minlength=BUCKETS)
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[at, bucket])], names=["at", "bucket", "n"])

    counts = np.zeros((len(names), BUCKETS))
    for r in chosen.mapInArrow(counted, "at int, bucket int, n double").groupBy("at", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["at"], r["bucket"]] = r["n"]
    log_p = np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * BUCKETS))
    return TextModel([*names, UNDETERMINED], np.vstack([log_p, np.full((1, BUCKETS), -np.log(BUCKETS))]))


def without_markup(page: str) -> str:
    """The page with comments, scripts, styles and tags as blanks; what is never closed is a tag or, without any ``>``, text.

    One pass: the place of an end that was looked for is kept until the pass is beyond it.
    """
    ends: dict[str, tuple[int, int] | None] = {}

    def end_of(kind: str, at: int) -> tuple[int, int] | None:
        found = ends.get(kind, (-1, -1))
        if found is not None and found[0] < at:
            if kind in _CLOSES:
                m = _CLOSES[kind].search(page, at)
                found = m.span() if m else None
            else:
                place = page.find(kind, at)
                found = (place, place + len(kind)) if place >= 0 else None
            ends[kind] = found
        return found

    out, at = [], 0
    while (tag := page.find("<", at)) >= 0:
        end = end_of("-->", tag + 4) if page.startswith("<!--", tag) else None
        if not end and (opens := _OPENS.match(page, tag)):
            end = end_of(opens[1].lower(), opens.end())
        end = end or end_of(">", tag + 1)
        if not end:
            break
        out += [page[at:tag], " "]
        at = end[1]
    return "".join(out) + page[at:]


def visible_text(page: str | None) -> str:
    """What a page shows: without comments, scripts, styles and tags, and with entities replaced."""
    return markup.unescape(_LONG_NUMBER.sub("\ufffd", without_markup(page))) if page else ""


def declared_language(page: Column) -> Column:
    """The language of the ``html`` element, its first subtag in lower case, or null."""
    found = F.lower(F.regexp_extract(page, r"(?i)<html\b[^<>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})", 1))
    return F.nullif(found, F.lit(""))


def address(url: Column) -> dict[str, Column]:
    """Host, its last two labels and its last label, all null if there is no host."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def identify(rows: DataFrame, model: TextModel, pages: bool = False) -> DataFrame:
    """Fuse the evidence of ``rows`` (key, text, declared, host, domain, suffix): one row out for each in.

    Returns key, ``language`` (``und`` if the text is like none of the model's languages),
    ``confidence`` (its posterior), ``text_language`` and ``text_confidence`` (of the text alone).
    Prior of a host: its other rows' summed text posteriors, smoothed towards its domain's, that
    towards its suffix's, and that towards all rows'. How far declared languages are to be
    trusted is learned from all rows too. Null or empty texts give no text evidence, null
    declarations and hosts none of theirs; without any evidence the prior of all rows decides, so
    such a row has a low confidence. Ties go to the language that comes first by name. Repeated
    rows each count and are each returned. An empty table gives an empty result. Whole texts are
    read, in time in proportion to their length; further columns are left out.
    """
    names = model.languages
    size = len(names)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x BUCKETS numbers

    @F.pandas_udf("array<double>")
    def evidence(texts):
        own = shared.value
        return texts.map(lambda t: own.log_likelihood(visible_text(t) if pages else t), na_action=None)

    known = F.create_map(*[x for i, n in enumerate(names[:-1]) for x in (F.lit(n), F.lit(i))]) if size > 1 else None
    declared = F.when(F.col("declared").isNotNull(), F.coalesce(F.element_at(known, F.lower("declared")), F.lit(size)) if known is not None else F.lit(size))
    scored = materialise(rows.select("key", evidence("text").alias("log_text"), declared.cast("int").alias("declared"), "host", "domain", "suffix"), "evidence")

    def counted(batches):
        """Summed text posteriors of what shares address and declaration, as far as a task has seen it."""
        held: dict[tuple, list] = {}

        def handed():
            for cut in range(0, len(held), 2048):
                part = list(held.items())[cut : cut + 2048]
                yield _rows([(*k, n, v.tolist()) for k, (n, v) in part])

        for batch in batches:
            post = softmax(_matrix(batch.column("log_text"), size))
            for k, v in zip(zip(*(batch.column(c).to_pylist() for c in LEVELS), batch.column("declared").to_pylist()), post):
                own = held.setdefault(k, [0, np.zeros(size)])
                own[0] += 1
                own[1] += v
            if len(held) >= HELD:
                yield from handed()
                held.clear()
        yield from handed()

    sums = materialise(scored.select("log_text", *LEVELS, "declared").mapInArrow(counted, SUMS), "sums")

    def summed(keys: list[str]) -> DataFrame:
        """``sums`` by some of its keys: rows of a key meet sorted and are added one after the other."""

        def added(batches):
            last, n, total, out = None, 0, None, []
            for batch in batches:
                for k, m, v in zip(zip(*(batch.column(c).to_pylist() for c in keys)), batch.column("n").to_pylist(), _matrix(batch.column("sums"), size)):
                    if k != last and last is not None:
                        out.append((*[dict(zip(keys, last)).get(c) for c in (*LEVELS, "declared")], n, total.tolist()))
                        n = 0
                    total = v.copy() if n == 0 else total + v
                    last, n = k, n + m
                if len(out) >= 2048:
                    yield _rows(out)
                    out = []
            if last is not None:
                out.append((*[dict(zip(keys, last)).get(c) for c in (*LEVELS, "declared")], n, total.tolist()))
            yield _rows(out)

        return sums.where(F.col(keys[0]).isNotNull()).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added, SUMS)

    total, trust = np.ones(size), np.ones((size + 1, size))  # declared (other last) given the language
    cells = sums.select("declared", F.posexplode("sums").alias("i", "x")).groupBy("declared", "i").agg(F.sum("x").alias("x"))
    for r in cells.collect():  # at most a number for each two languages
        total[r.i] += r.x
        if r.declared is not None:
            trust[r.declared, r.i] += r.x
    trust, overall = np.log(trust / trust.sum(axis=0)), total / total.sum()
    top = F.array(*[F.lit(float(x)) for x in overall])

    def smoothed(counts: Column, n: Column, prior: Column) -> Column:
        return F.zip_with(counts, prior, lambda c, p: (F.greatest(c, F.lit(0.0)) + STRENGTH * p) / (n + STRENGTH))

    suffixes = summed(["suffix"]).select(F.col("suffix").alias("k1"), smoothed(F.col("sums"), F.col("n"), top).alias("p1"))
    domains = summed(["domain", "suffix"]).join(suffixes, F.col("suffix") == F.col("k1"), "left")
    domains = domains.select(F.col("domain").alias("k2"), smoothed(F.col("sums"), F.col("n"), F.coalesce("p1", top)).alias("p2"))
    hosts = summed(["host", "domain"]).join(domains, F.col("domain") == F.col("k2"), "left")
    hosts = hosts.select(F.col("host").alias("k3"), F.col("sums").alias("host_c"), F.col("n").alias("host_n"), F.coalesce("p2", top).alias("p2"))
    joined = scored.select("key", "log_text", "declared", "host").join(hosts, F.col("host") == F.col("k3"), "left")
    learned = spark.sparkContext.broadcast((trust, overall))  # MAX_LANGUAGES x MAX_LANGUAGES numbers at most

    def fused(batches):
        said, every = learned.value
        labels = np.array(names, object)
        for batch in batches:
            log_text = _matrix(batch.column("log_text"), size)
            post, prior = softmax(log_text), np.tile(every, (batch.num_rows, 1))
            there = np.nonzero(np.array(batch.column("host_n").is_valid()))[0]
            if len(there):
                own = batch.take(pa.array(there))
                n = own.column("host_n").to_numpy()[:, None] - 1
                others = np.maximum(_matrix(own.column("host_c"), size) - post[there], 0.0)  # a row is no evidence for itself
                prior[there] = (others + STRENGTH * _matrix(own.column("p2"), size)) / (n + STRENGTH)
            told = np.nonzero(np.array(batch.column("declared").is_valid()))[0]
            log = log_text + np.log(prior)
            log[told] += said[batch.column("declared").take(pa.array(told)).to_numpy()]
            both = softmax(log)
            columns = [batch.column("key")]
            for p in (both, post):
                columns += [pa.array(labels[p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "language", "confidence", "text_language", "text_confidence"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL("language string, confidence double, text_language string, text_confidence double").fields])
    return joined.select("key", "log_text", "declared", "host_c", "host_n", "p2").mapInArrow(fused, schema)


LEVELS = ("host", "domain", "suffix")
SUMS = "host string, domain string, suffix string, declared int, n long, sums array<double>"
#: Addresses that a task holds sums of before it hands them on.
HELD = 1 << 16


def softmax(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(axis=1, keepdims=True, initial=-np.inf))
    return p / p.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*LEVELS, "declared", "n", "sums"])


def page_languages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``identify`` for web pages with ``page_id``, ``url`` and ``html``."""
    rows = pages.select(F.col("page_id").alias("key"), F.col("html").alias("text"), declared_language(F.col("html")).alias("declared"), *[c.alias(n) for n, c in address(F.col("url")).items()])
    return identify(rows, model, pages=True).withColumnRenamed("key", "page_id")


def document_languages(docs: DataFrame, model: TextModel, key: Column | None = None) -> DataFrame:
    """``identify`` for documents: ``lang`` is the declared language and ``source`` takes the place of the host."""
    source = F.col("source").cast("string")
    rows = docs.select((F.col("doc_id") if key is None else key).alias("key"), "text", F.substring_index(F.col("lang"), "-", 1).alias("declared"), source.alias("host"), source.alias("domain"), F.lit(None).cast("string").alias("suffix"))
    return identify(rows, model)


def keep_identified(docs: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """Documents whose language is one of the model's with at least ``least`` confidence; columns as given.

    A row is told by its id and text: rows that repeat both have one answer. Null ids count as one
    id, null and empty texts are judged by declaration and source alone. Texts are read whole, however
    long; further columns come through, also ones named like evidence. An empty table stays empty. Only the marks of what goes are joined to the documents, as a
    written table whose size is known, so few of them move no text.
    """
    parts = lambda: [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")]
    mark = F.struct(*[c.alias(n) for c, n in zip(parts(), "ab")])
    found = document_languages(docs, model, mark)
    gone = found.where((F.col("language") == UNDETERMINED) | (F.col("confidence") < least)).select(F.col("key.a").alias("_a"), F.col("key.b").alias("_b")).distinct()
    gone = materialise(gone, "rejected")
    own = parts()
    return docs.join(gone, (own[0] == gone._a) & (own[1] == gone._b), "left_anti")
