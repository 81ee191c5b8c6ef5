"""Near copies confirmed on full shingle sets: texts of candidate groups meet in bounded tasks, and no list of pairs is made."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise

#: Shingles of the texts that one task compares; members of a large group that every block of it meets first.
SHINGLES, LEADERS = 1 << 21, 32

_WORD = np.random.default_rng(12).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Of a table and the places of one group in it: a function of (where each is joined to, an exact test of pairs of
#: places within the group) that gives pairs that join whatever is alike.
Near = Callable[[pa.Table, np.ndarray], Callable[[np.ndarray, Callable], list[tuple[int, int]]]]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finish of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | bytes | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a whole text.

    A-Z are lower-cased; words are runs without ASCII white space; a text of fewer words is one
    shingle; one without words or a null has none. ``words`` may be up to 64.
    """
    found = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h, size = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)), min(words, len(found))
    total = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        total += h[k : k + len(total)] * _WORD[k]
    return np.unique(mixed(total))


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while (parent[r] != r).any():
        r = parent[r]
    parent[x] = r
    return r


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Join the groups of each x and y; returns the places of pairs that are enough to do so, earlier ones first."""
    used, left = [np.zeros(0, np.int64)], np.arange(len(x))
    while len(left):
        a, b = roots(parent, x[left]), roots(parent, y[left])
        differ = a != b
        left, a, b = left[differ], a[differ], b[differ]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        parent[high] = np.minimum(a, b)[first]
        used.append(left[first])
    return np.concatenate(used)


def runs_of(values: np.ndarray) -> list[np.ndarray]:
    """Places of equal values, value by value."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.nonzero(np.diff(values[order]))[0] + 1) if len(order) else []


def first_of(label: np.ndarray) -> np.ndarray:
    """For each place the first place with its label: the groups to start from."""
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    return first[of]


def pairs_table(pairs: list[tuple[int, int]]) -> pa.Table:
    ends = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": ends.max(axis=1, initial=np.iinfo(np.int64).min), "b": ends.min(axis=1, initial=np.iinfo(np.int64).max)})


def shared_shingles(flat: np.ndarray, size: np.ndarray, most: int = 1 << 26):
    """A function of two arrays of places that counts the shingles that texts have in common, pair by pair.

    ``flat`` holds the shingles of the texts one after the other, ``size`` how many each has. Those
    that several texts have become the bits of a row for each text; where rows would take more than
    ``most`` bytes the sorted lists are compared.
    """
    at = np.concatenate([[0], np.cumsum(size)])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    kept, width = count[number] > 1, -(-int((count > 1).sum()) // 64)
    if len(size) * width * 8 > most:
        return lambda x, y: np.array([len(np.intersect1d(flat[at[u] : at[u + 1]], flat[at[v] : at[v + 1]], assume_unique=True)) for u, v in zip(x, y)], np.int64)
    bits = np.zeros((len(size), max(1, width)), np.uint64)
    row, bit = np.repeat(np.arange(len(size)), size)[kept], common[number[kept]]
    np.bitwise_or.at(bits, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    step = max(1, (1 << 22) // max(1, width))
    return lambda x, y: np.concatenate([np.zeros(0, np.int64)] + [np.bitwise_count(bits[x[a : a + step]] & bits[y[a : a + step]]).sum(axis=1, dtype=np.int64) for a in range(0, len(x), step)])


def meeting(rows: DataFrame, bound: int) -> DataFrame:
    """Deal ``rows`` (group, node, label, weight ...) into bounded ``cell``s of a ``bucket`` where any two of a group with unlike labels meet.

    Many groups share a bucket while their weight allows. A group beyond ``bound`` is dealt into
    blocks; members of its most frequent label needn't meet one another, so only blocks of the others
    meet all blocks: with few of them the work grows as the group does.
    """
    labels = rows.groupBy("group", "label").agg(F.sum("weight").alias("w"))
    sums = labels.groupBy("group").agg(F.sum("w").alias("w"), F.max(F.struct("w", "label")).alias("m"))
    large = sums.where(F.col("w") > bound).select(F.col("group").alias("g"), F.col("m.label").alias("major"), F.ceil(2 * F.col("w") / bound).alias("all"), F.greatest(F.lit(1), F.ceil(2 * (F.col("w") - F.col("m.w")) / bound)).alias("few"))
    large = materialise(large, "large")
    buckets = max(1, -(-4 * (rows.agg(F.sum("weight")).first()[0] or 0) // bound))
    dealt = rows.join(large, rows.group == large.g, "left").drop("g")
    small = dealt.where("all is null").withColumns({"bucket": F.pmod(F.xxhash64("group"), F.lit(buckets)), "cell": F.lit(-1).cast("long")})
    block, own = F.pmod(F.xxhash64("node"), F.col("all")), F.pmod(F.xxhash64("node"), F.col("few"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    met = F.transform(numbers("few"), lambda i: i * F.col("all") + block)
    minor = F.when(F.col("label") != F.col("major"), F.transform(numbers("all"), lambda j: own * F.col("all") + j)).otherwise(F.array().cast("array<long>"))
    split = dealt.where("all is not null").withColumns({"bucket": F.col("group"), "cell": F.explode(F.array_union(met, minor))})
    return small.unionByName(split).drop("major", "all", "few")


def exact_links(dealt: DataFrame, words: int, similarity: float, carried: list[str], near: Near) -> DataFrame:
    """Links (a, b) that join the texts of a cell and group (bucket, cell, group, node, label, t and ``carried``) that share ``similarity`` of their shingles."""

    def compared(table: pa.Table) -> pa.Table:
        group, node, label, texts = table.column("group").to_numpy(), table.column("node").to_numpy(), table.column("label").to_numpy(), table.column("t")
        out = []
        for own in runs_of(group):
            start = first_of(label[own])
            if (start == 0).all():
                continue
            sets = [shingle_set(texts[int(i)].as_py(), words) for i in own]
            size = np.array([len(s) for s in sets], np.int64)
            common = shared_shingles(np.concatenate(sets), size)

            def same(x: np.ndarray, y: np.ndarray, size=size, common=common) -> np.ndarray:
                both = common(x, y)
                return both + 1e-9 >= similarity * (size[x] + size[y] - both)

            out += [(node[own[i]], node[own[j]]) for i, j in near(table, own)(start, same)]
        return pairs_table(out)

    return dealt.select("bucket", "cell", "group", "node", "label", "t", *carried).groupBy("bucket", "cell").applyInArrow(compared, "a long, b long")


def set_links(points: DataFrame, groups: DataFrame, docs: DataFrame, words: int, similarity: float, carried: list[str], near: Near, bound: int = SHINGLES) -> DataFrame:
    """Links (a, b) that join whatever points of one group (node, group) join that share ``similarity`` of their full sets.

    ``points``: node, n (about as many shingles as its text has), id and h, by which the text is found in
    ``docs`` (id, t), and the ``carried`` columns by which ``near`` rules pairs out.

    Texts move, not sets, and once for most: a group beyond ``bound`` shingles is dealt into blocks, each of which
    also has the group's ``LEADERS``; only if that leaves parts of it apart do the smaller parts meet
    the other blocks (see ``meeting``).
    """
    member = groups.select(F.col("node").alias("m"), "group")
    needed = points.join(member, points.node == member.m).select("group", "node", *carried, F.col("n").alias("weight"), F.col("id").alias("i"), F.col("h").alias("x"))
    needed = materialise(needed, "needed")
    sums = needed.groupBy("group").agg(F.sum("weight").alias("w"), F.count("*").alias("c"))
    large = materialise(sums.where(F.col("w") > bound).select(F.col("group").alias("g"), F.ceil(2 * F.col("w") / bound).alias("all"), "c"), "large")
    buckets = max(1, -(-4 * (needed.agg(F.sum("weight")).first()[0] or 0) // bound))
    dealt = needed.join(large, needed.group == large.g, "left")
    small = dealt.where("all is null").withColumns({"bucket": F.pmod(F.xxhash64("group"), F.lit(buckets)), "cell": F.lit(-1).cast("long")})
    leads = F.pmod(F.xxhash64("node", F.lit(1)), F.col("c")) < LEADERS
    blocks = F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("all"))))
    split = dealt.where("all is not null").withColumns({"bucket": F.col("group"), "cell": F.explode(blocks)})
    once = small.unionByName(split).withColumn("label", F.col("node")).drop("g", "all", "c")

    def with_text(rows: DataFrame) -> DataFrame:
        rows = materialise(rows, "dealt")
        return docs.join(rows, docs.id.eqNullSafe(rows.i) & F.xxhash64(docs.t).eqNullSafe(rows.x))

    links = materialise(exact_links(with_text(once), words, similarity, carried, near), "links")
    if not large.isEmpty():
        parts = connected_components(links).select(F.col("node").alias("p"), "component")
        again = needed.join(large, needed.group == large.g, "left_semi").join(parts, F.col("node") == F.col("p"), "left")
        again = materialise(again.withColumn("label", F.coalesce("component", "node")).drop("p", "component"), "again")
        torn = again.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("group").alias("g"))
        again = materialise(again.join(torn, again.group == torn.g, "left_semi"), "torn")
        if not again.isEmpty():
            links = links.unionAll(materialise(exact_links(with_text(meeting(again, bound)), words, similarity, carried, near), "links"))
    return links
