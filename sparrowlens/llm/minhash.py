"""MinHash near-duplicates: banded candidates, odd sketches that rule out, exact shingle sets that decide.

A distinct shingle set has ``SAMPLES`` MinHash samples. The first ``BANDS * ROWS`` of them are cut into bands whose
equality makes two sets meet; all of them are folded into an odd sketch, a bitmap that holds the parity of the
samples hashed to each bit. The XOR of two sketches has a set bit for about each sample that differs, so its
population count estimates a high similarity with little error in few bytes. Only what sketches don't rule out is
compared on full sets, and no list of the pairs of a group is ever made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .confirm import _WORD, SHINGLES, first_of, meeting, mixed, pairs_table, roots, runs_of, set_links, shingle_set, unite
from .shared import materialise

#: A pair of similarity 0.85 misses all of 32 bands of 5 samples with probability 7e-9.
BANDS, ROWS = 32, 5
#: Samples and bits of an odd sketch: at 0.85 the estimate's standard deviation is 0.024 (0.018 by sampling, 0.016 by folding).
SAMPLES, BITS = 384, 1024
#: How far below the stated similarity an estimate rules a pair out (5.6 standard deviations at 0.85).
MARGIN = 0.15
#: Sketches that one task compares.
SKETCHES = 1 << 14
#: Shingles that are sampled at once, whatever the length of a text.
BLOCK = 512

_SAMPLE = np.random.default_rng(85).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set: for each of ``SAMPLES`` multiplicative hashes its least value."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, np.multiply.outer(_SAMPLE, shingles[at : at + BLOCK]).min(axis=1), out=least)
    return least


def band_keys(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which also tells bands apart."""
    parts = found[: BANDS * ROWS].reshape(BANDS, ROWS)
    return mixed((parts * _WORD[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """The samples, each told by its number, folded into ``BITS`` parities (as 64-bit words)."""
    bit = mixed(found + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)


def most_odd(similarity: float) -> int:
    """The largest number of differing bits at which sets may still have the similarity.

    m = 2 k (1 - J) samples that only one side has leave n / 2 (1 - exp(-2 m / n)) odd bits of n.
    """
    return math.floor(BITS / 2 * (1 - math.exp(-4 * SAMPLES * min(1.0, 1 - similarity) / BITS)))


def estimate(odd: float) -> float:
    """The similarity that so many differing bits of two odd sketches speak for."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * odd / BITS))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """For ``docs`` (id, t): id, h (hash of the text), n (set size), node (hash of the set; null if empty), bands, odd."""

    def signed(batches):
        for batch in batches:
            known: dict[bytes | None, tuple] = {}
            rows = []
            for text in batch.column("b").to_pylist():
                if text not in known:
                    s = shingle_set(text, words)
                    if len(s):
                        found = samples(s)
                        known[text] = len(s), np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64).item(), band_keys(found).view(np.int64), odd_sketch(found).view(np.int64)
                    else:
                        known[text] = 0, None, None, None
                rows.append(known[text])
            n, node, bands, odd = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["id", "h", "n", "node", "bands", "odd"],
            )

    return docs.select("id", F.xxhash64("t").alias("h"), F.col("t").cast("binary").alias("b")).mapInArrow(signed, "id long, h long, n long, node long, bands array<long>, odd array<long>")


def differing(a: Column, b: Column) -> Column:
    """Set bits of the XOR of two bitmaps."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def join_near(odd: np.ndarray, parent: np.ndarray, most: int, same=None) -> list[tuple[int, int]]:
    """Pairs of places that join whatever near pairs join: sketches differ in at most ``most`` bits and ``same`` holds.

    ``parent`` has who is joined already. A pair that is joined by then is neither listed nor
    compared, so a group around one text costs about a comparison for each member.
    """
    out, at, step = [], 0, 1
    while at < len(odd) - 1:
        every = roots(parent, np.arange(len(odd)))
        if (every == every[0]).all():
            break
        rows = np.arange(at, min(at + step, len(odd)))
        cols = np.nonzero(every != every[at])[0] if (every[rows] == every[at]).all() else np.arange(at + 1, len(odd))
        for cut in range(0, len(cols), 1 << 14):
            part = cols[cut : cut + (1 << 14)]
            z = np.zeros((len(rows), len(part)), np.int16)
            for w in range(odd.shape[1]):
                z += np.bitwise_count(odd[rows, w][:, None] ^ odd[None, part, w])
            i, j = np.nonzero((z <= most) & (every[rows][:, None] != every[part][None]))
            order = np.argsort(z[i, j], kind="stable")
            x, y = rows[i[order]], part[j[order]]
            while len(x):
                differ = roots(parent, x) != roots(parent, y)
                x, y = x[differ], y[differ]
                a, b = x[:4096], y[:4096]
                x, y = x[4096:], y[4096:]
                if same is not None and len(a):
                    sure = same(a, b)
                    a, b = a[sure], b[sure]
                used = unite(parent, a, b)
                out += zip(a[used].tolist(), b[used].tolist())
        at, step = at + step, min(64, 2 * step)
    return out


def bitmaps(table: pa.Table) -> np.ndarray:
    return table.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)


def sketch_links(members: DataFrame, similarity: float, bound: int = SKETCHES) -> DataFrame:
    """Links (a, b) that join members (group, node, label, odd) of one group whose sketches allow the similarity."""

    def searched(table: pa.Table) -> pa.Table:
        group, node, label, odd = table.column("group").to_numpy(), table.column("node").to_numpy(), table.column("label").to_numpy(), bitmaps(table)
        out = []
        for own in runs_of(group):
            for i, j in join_near(odd[own], first_of(label[own]), most_odd(similarity)):
                out.append((node[own[i]], node[own[j]]))
        return pairs_table(out)

    return meeting(members.withColumn("weight", F.lit(1)), bound).groupBy("bucket", "cell").applyInArrow(searched, "a long, b long")


def candidate_groups(points: DataFrame, similarity: float, bound: int = SKETCHES) -> DataFrame:
    """``node`` and ``group`` such that two points that share a band and whose sketches don't rule them out are in one group.

    ``points`` has node, bands, odd. In a bucket everyone meets its least node first. Where that
    leaves members apart and there are others beside that node, the sketches of members that are not
    yet in one group meet too; buckets with the same members count once.
    """
    rows = points.select(F.explode("bands").alias("key"), "node")
    first = rows.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "k")
    members = materialise(rows.join(first, rows.key == first.k).select("key", "node", "lead", "c"), "buckets")
    odd = lambda x: points.select(F.col("node").alias(f"n{x}"), F.col("odd").alias(f"o{x}"))
    pairs = members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = pairs.join(odd("a"), F.col("a") == F.col("na")).join(odd("b"), F.col("b") == F.col("nb"))
    links = materialise(pairs.where(differing(F.col("oa"), F.col("ob")) <= most_odd(similarity)).select("a", "b"), "met")
    found = connected_components(links)

    wide = members.where("c > 2").select("key", "node")
    label = found.select(F.col("node").alias("n"), "component")
    wide = materialise(wide.join(label, wide.node == F.col("n"), "left").select("key", "node", F.coalesce("component", "node").alias("label")), "wide")
    named = F.xxhash64("node").cast("decimal(20,0)")
    torn = wide.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"), F.sum(named).alias("sum")).where("low <> high")
    torn = materialise(torn.groupBy("c", "sum").agg(F.min("key").alias("k")).select("k"), "torn")
    if not torn.isEmpty():
        left = wide.join(torn, wide.key == torn.k, "left_semi").select(F.col("key").alias("group"), "node", "label")
        left = left.join(odd("x"), F.col("node") == F.col("nx")).select("group", "node", "label", F.col("ox").alias("odd"))
        links = links.unionAll(materialise(sketch_links(left, similarity, bound), "near"))
        found = connected_components(links)
    return found.select("node", F.col("component").alias("group")).unionAll(found.select(F.col("component").alias("node"), F.col("component").alias("group"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.85, key: str = "doc_id", text: str = "text", bound: int = SHINGLES, sketches: int = SKETCHES) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id`` (the least key it reaches) and ``kept``.

    Two documents link when their sets of ``words``-word shingles share at least ``similarity`` of
    their union, counted on the full sets; bands and margin are planned for 0.85 and more. Null and
    empty texts, and those of white space alone, have no set and link with nothing: they are
    components of their own. Rows with a null key link too, but never name a component; where no
    row of it has a key its id is null. Repeated rows are returned as often as they come and are
    copies of one another; further columns, also ones named like the results, are left out. An
    empty table gives an empty result. Texts are read whole. Equal sets are one point, named by a
    64-bit hash.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    hashed = materialise(signatures(docs, words), "signatures")
    first = hashed.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "h")).alias("f"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    points = materialise(first.select("node", "f.id", "f.h", "n", "bands", "odd"), "points")
    least = materialise(hashed.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("id")), "least")
    if not hashed.groupBy("id", "h").agg(F.count("*").alias("c")).where("c > 1").isEmpty():  # rows that repeat id and text: each text once
        docs = docs.groupBy("id", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t")).select("id", "t")
    groups = candidate_groups(points.select("node", "bands", "odd"), similarity - MARGIN, sketches)

    def near(table: pa.Table, own: np.ndarray):
        odd = bitmaps(table)[own]
        return lambda start, same: join_near(odd, start, most_odd(similarity - MARGIN), same)

    links = set_links(points.select("node", "id", "h", "n", "odd"), materialise(groups, "groups"), docs, words, similarity, ["odd"], near, bound)
    found = connected_components(links).select(F.col("node").alias("c"), "component")
    named = points.select("node").join(found, points.node == F.col("c"), "left").select("node", F.coalesce("component", "node").alias("part"))
    named = named.join(least.select(F.col("node").alias("l"), "id"), named.node == F.col("l"), "left").select("node", "part", "id")
    names = named.groupBy("part").agg(F.min("id").alias("name")).withColumnRenamed("part", "p")
    named = named.join(names, named.part == names.p).select(F.col("node").alias("m"), "name")
    rows = hashed.select("id", "n", "node")
    every = rows.join(named, rows.node == named.m, "left")
    every = every.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("name")).alias("component_id"))
    return every.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
