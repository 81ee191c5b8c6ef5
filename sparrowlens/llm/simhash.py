"""SimHash near-duplicates found with a sharded vantage-point tree.

Fingerprints are partitioned by Hamming distance to vantage points. A link of radius r between a
point inside a ball and one outside means that the inside one lies within r of the ball's
surface (triangle inequality), so only those inside points are also sent outside; each shard is
then searched exactly, pruning with its own vantage points. For near copies of a stated similarity
points meet by bands of min-wise sketches, several independent fingerprints with a wide radius and whole
sketches discard what lies far below, and the exact word shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .confirm import mixed, roots, set_links, shingle_set, unite
from .shared import materialise

RADIUS = 3
#: Distinct fingerprints that a leaf of the shard tree is planned for.
LEAF = 4096
#: Bounds of the tree that the driver holds: its depth, and the sampled fingerprints for each leaf.
MAX_DEPTH, SAMPLE_PER_LEAF = 14, 24
#: Independent fingerprints and radius for near copies; how far below the stated similarity a sketch's estimate
#: (standard deviation 0.035, so six of them) rules a pair out. Sets that share 0.8 have fingerprints about 10 bits apart.
PRINTS, WIDE, MARGIN = 3, 20, 0.21
#: Points that a task searches at once, however many are alike.
BOUND = 1 << 18
#: Bytes of a word with its space, about, by which the shingles of a text are estimated where tasks are bounded.
WORD_BYTES = 6
#: Shingles that are hashed and counted at once, whatever the length of a text.
BLOCK = 1 << 16
#: Bytes of a sketch and of a band of it; members up to which buckets are searched together, rows of a shard of buckets.
BINS, BAND, FEW, SHARD_ROWS = 128, 4, 32, 1 << 15


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    """The hashes as if by another, independent hash function (splitmix64); salt 0 leaves them."""
    if not salt:
        return h
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64 (seed 42).

    A-Z are lower-cased; words are runs without ASCII white space; a text of fewer words than a
    shingle has is one shingle; one without words has fingerprint 0.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    count, digest = max(1, len(found) - words + 1), xxhash.xxh64_intdigest
    starts = np.concatenate([[0], ends[:-1] + 1])[:count].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, count, BLOCK):
        total += _bits(np.array([digest(line[s:e], 42) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], np.uint64))
    return _print(total, count)


def _bits(h: np.ndarray) -> np.ndarray:
    """Of how many hashes each bit is set, the highest first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _print(total: np.ndarray, count: int) -> int:
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the SimHash of each whole text as a signed 64-bit long ``fp`` (null text: as empty, 0)."""

    @F.pandas_udf("long")
    def hashed(texts):
        return texts.map(lambda t: fingerprint(t, words), na_action=None).astype("uint64").astype("int64")

    return docs.withColumn(out, hashed(F.col(text)))


def set_prints(h: np.ndarray, n: int = PRINTS) -> list[int]:
    """``n`` independent 64-bit SimHashes of a set of hashes; 0 for an empty one.

    How often a text repeats a shingle doesn't count, so what they say of two sets holds whatever the texts repeat.
    """
    total = np.zeros((n, 64), np.int64)
    for at in range(0, len(h), BLOCK):
        for i in range(n):
            total[i] += _bits(_salted(h[at : at + BLOCK], i))
    return [_print(t, len(h)) for t in total]


def set_sketch(h: np.ndarray, bins: int = BINS) -> bytes:
    """A byte per bin of a set of hashes; the share of equal bytes of two sketches estimates the Jaccard similarity of their sets.

    Every round deals all hashes anew into the bins, and the least of the first round that reaches a bin counts; after ``bins``
    rounds each goes to one bin. So small sets are estimated as well as large ones (fast similarity sketching).
    """
    if not len(h):
        h = np.zeros(1, np.uint64)
    least, empty = np.full(bins, np.iinfo(np.uint64).max), np.iinfo(np.uint64).max
    step = max(1, 8 * bins // len(h))
    for at in range(0, 2 * bins, step):
        rounds = np.arange(at, min(at + step, 2 * bins), dtype=np.uint64)[:, None]
        g = mixed(h + (rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        bin_ = np.where(rounds < bins, g % np.uint64(bins), rounds % np.uint64(bins)).astype(np.int64)
        np.minimum.at(least, bin_.ravel(), (rounds << np.uint64(55) | g >> np.uint64(9)).ravel())
        if (least != empty).all():
            break
    return ((mixed(least) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def plan_tree(sample: np.ndarray, depth: int, radius: int = RADIUS) -> list[tuple[int, int] | None]:
    """A balanced vantage-point tree over the sample as an array heap: (vantage point, radius) or None for a leaf."""
    tree: list[tuple[int, int] | None] = [None] * (2 ** (depth + 1) - 1)
    parts = {0: np.unique(sample)}
    for node in range(2**depth - 1):
        part = parts.pop(node, None)
        if part is None or len(part) < 8:
            continue
        best = None
        for v in part[:: max(1, len(part) // 4)][:4]:  # the candidate whose median leaves least next to the surface
            d = distances(part, v)
            mu = int(np.median(d))
            inside, near = (d <= mu).mean(), ((d <= mu) & (d > mu - radius)).mean()
            cost = near + abs(inside - 0.5)
            if 0.1 < inside < 0.9 and (best is None or cost < best[0]):
                best = (cost, int(v), mu, d)
        if best:
            _, v, mu, d = best
            tree[node] = (v, mu)
            parts[2 * node + 1], parts[2 * node + 2] = part[d <= mu], part[d > mu]
    return tree


def route(points: np.ndarray, tree: list[tuple[int, int] | None], radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (leaf, indexes of points, whether at home). A point visits the leaves of later siblings that it may link to."""
    todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, idx, home = todo.pop()
        if not len(idx):
            continue
        if 2 * node + 1 >= len(tree) or tree[node] is None:
            yield node, idx, home
            continue
        vantage, mu = tree[node]
        d = distances(points[idx], vantage)
        inside, near = d <= mu, (d <= mu) & (d > mu - radius)
        # a guest has its home elsewhere and has to meet whatever lies in reach on either side
        to_in = np.where(home, inside, d <= mu + radius)
        to_out = np.where(home, ~inside | near, d > mu - radius)
        todo.append((2 * node + 1, idx[to_in], home[to_in]))
        todo.append((2 * node + 2, idx[to_out], home[to_out] & ~inside[to_out]))


def arranged(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of points by their distances to two vantage points, and those distances in that order."""
    first, second = fps[0], fps[int(np.argmax(distances(fps, fps[0])))]
    da, db = distances(fps, first), distances(fps, second)
    order = np.lexsort((db, da))
    return order, da[order], db[order]


def near_pairs(fps: np.ndarray, da: np.ndarray, db: np.ndarray, home: np.ndarray, radius: int, parent: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of pairs of ``arranged`` points within the radius, one of them at home, that aren't in one group yet.

    By the triangle inequality only a window of the order can hold partners, and a second vantage
    point prunes the window again. A chunk lists at most ``cells`` pairs, or those of 16 points.
    """
    own = np.nonzero(home)[0]
    shells = np.searchsorted(da, np.arange(66))
    block = max(16, min(256, cells // len(fps)))
    for at in range(0, len(own), block):
        rows = own[at : at + block]
        for shell in range(max(0, int(da[rows[0]]) - radius), min(64, int(da[rows[-1]]) + radius) + 1):
            lo, hi = int(shells[shell]), int(shells[shell + 1])
            part = rows[np.abs(da[rows] - shell) <= radius]
            if lo == hi or not len(part):
                continue
            a, b = np.searchsorted(db[lo:hi], [int(db[part].min()) - radius, int(db[part].max()) + radius + 1])
            near = np.bitwise_count(fps[part][:, None] ^ fps[None, lo + a : lo + b]) <= radius
            if np.count_nonzero(near) > 1 << 14:  # a large group: drop what is joined already before it is listed
                near &= roots(parent, part)[:, None] != roots(parent, np.arange(lo + a, lo + b))[None]
            i, j = np.nonzero(near)
            i, j = part[i], j + lo + a
            new = (j > i) | ~home[j]
            if new.any():
                yield i[new], j[new]


def local_links(fps: np.ndarray, ids: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (id, least id of its group) of the points of one shard that lie within the radius of one another.

    Only pairs that join two groups count, so a large group costs no list of pairs.
    """
    order, da, db = arranged(fps)
    fps, ids, home = fps[order], ids[order], home[order]
    parent = np.arange(len(fps))  # of a point: another of its group with a lesser place
    for i, j in near_pairs(fps, da, db, home, radius, parent):
        unite(parent, i, j)
    group = roots(parent, np.arange(len(fps)))
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    linked = ids != least[group]
    return ids[linked], least[group][linked]


def local_candidates(fps: np.ndarray, nodes: np.ndarray, home: np.ndarray, radius: int, sketches: np.ndarray, least: float, checked=None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of a shard within the radius whose sketches share at least ``least`` of their bytes.

    Enough of them to join whatever such pairs join (a forest), the more alike ones of a chunk
    first. With ``checked`` only pairs count that it holds of their places; it is asked about no
    pair whose nodes are joined before its chunk. Nodes with one ``label`` are joined from the start.
    """
    order, da, db = arranged(fps)
    fps, nodes, home, sketches = fps[order], nodes[order], home[order], sketches[order]
    parent, out = np.arange(len(fps)), [np.zeros((2, 0), np.int64)]
    if label is not None:
        _, first, of = np.unique(label[order], return_index=True, return_inverse=True)
        parent = first[of]
    for i, j in near_pairs(fps, da, db, home, radius, parent):
        for cut in range(0, len(i), 1 << 15):
            x, y = i[cut : cut + (1 << 15)], j[cut : cut + (1 << 15)]
            differ = roots(parent, x) != roots(parent, y)
            x, y = x[differ], y[differ]
            share = (sketches[x] == sketches[y]).mean(axis=1)
            alike = np.nonzero(share >= least)[0]
            alike = alike[np.argsort(-share[alike], kind="stable")]
            x, y = x[alike], y[alike]
            if checked is not None:
                sure = checked(order[x], order[y])
                x, y = x[sure], y[sure]
            used = unite(parent, x, y)
            out.append(np.stack([nodes[x[used]], nodes[y[used]]]))
    a, b = np.concatenate(out, axis=1)
    return np.maximum(a, b), np.minimum(a, b)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, leaf: int = LEAF, bound: int = BOUND) -> DataFrame:
    """Links (a, b) that join all points within the radius; ``fps`` has ``fp`` and an ``id`` for each point."""
    points = fps.select(F.array("fp").alias("prints"), F.col("id").alias("node"))

    def searched(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("fp", "node", "home")}
        a, b = local_links(col["fp"].view(np.uint64), col["node"], col["home"].astype(bool), radius)
        return pa.table({"a": a, "b": b})

    return sharded(points, 1, radius, leaf, 0, bound).groupBy("shard", "cell").applyInArrow(searched, "a long, b long")


def cells(nodes: np.ndarray, size: int, bound: int) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (cell, indexes) of the points of a leaf of ``size``: every two points share a cell of about ``bound`` at most.

    A larger leaf is dealt by hash into blocks of half the bound, and a cell is a pair of blocks.
    """
    n = 1 if size <= bound else max(2, -(-2 * size // bound))
    block = (_salted(nodes.view(np.uint64), 7) % np.uint64(n)).astype(np.int64)
    for i in range(n):
        for j in range(i + 1, n):
            yield i * n + j, np.nonzero((block == i) | (block == j))[0]
    if n == 1:
        yield 0, np.arange(len(nodes))


def sharded(points: DataFrame, n_prints: int, radius: int, leaf: int, least_depth: int, bound: int = BOUND) -> DataFrame:
    """Points at their leaves (``shard``) of a tree for each of their ``prints``: fp, home and the further columns.

    Points of a leaf that meet in one task have the same ``cell``, which ``bound`` bounds.
    """
    n = points.count()
    depth = min(MAX_DEPTH, max(least_depth, int(np.ceil(np.log2(max(1, n / leaf))))))
    want = SAMPLE_PER_LEAF * 2**depth
    take = points.select("prints").where(F.pmod(F.xxhash64("prints"), F.lit(max(1, n // want))) == 0).limit(2 * want)
    sample = np.array([r.prints for r in take.collect()] if depth else [], np.int64).reshape(-1, n_prints).view(np.uint64)
    trees = [plan_tree(sample[:, p], depth, radius) if depth else [None] for p in range(n_prints)]
    shared = points.sparkSession.sparkContext.broadcast(trees)  # at most 2 ** (MAX_DEPTH + 1) nodes each
    others = [c for c in points.columns if c != "prints"]
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def counted(batches):
        for batch in batches:
            every = batch.column("prints").flatten().to_numpy().reshape(-1, n_prints).view(np.uint64)
            found = [(p * 2 ** (MAX_DEPTH + 1) + shard, len(idx)) for p, tree in enumerate(shared.value) for shard, idx, _ in route(np.ascontiguousarray(every[:, p]), tree, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64())], names=["shard", "n"])

    sizes = {}
    if n > bound:  # a point comes once to a leaf
        sums = points.select("prints").mapInArrow(counted, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
        sizes = {r.shard: r.n for r in sums.where(F.col("n") > bound).collect()}  # at most a number for each leaf

    def routed(batches):
        for batch in batches:
            every = batch.column("prints").flatten().to_numpy().reshape(-1, n_prints).view(np.uint64)
            for p, tree in enumerate(shared.value):
                fps = np.ascontiguousarray(every[:, p])
                for shard, idx, home in route(fps, tree, radius):
                    shard += p * 2 ** (MAX_DEPTH + 1)
                    for cell, at in cells(batch.column("node").to_numpy()[idx], sizes.get(shard, 0), bound):
                        own = idx[at]
                        rest = [batch.column(c).take(pa.array(own)) for c in others]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(np.full(len(own), cell, np.int64)), pa.array(fps[own].view(np.int64)), pa.array(home[at]), *rest], names=["shard", "cell", "fp", "home", *others])

    return points.mapInArrow(routed, ", ".join(["shard int, cell long, fp long, home boolean", *[f"{c} {kinds[c]}" for c in others]]))


def banded(points: DataFrame, bound: int = BOUND) -> DataFrame:
    """Points (node, prints, sketch) once for each bucket of theirs that holds others too, with its ``key`` and the ``shard`` where it is searched.

    A bucket is a run of ``BAND`` bytes of the sketch. Rows of 16 bytes tell which buckets hold others, so a point that
    is like no other goes no further. Buckets share shards; one beyond ``bound`` is dealt into blocks that meet in pairs.
    """
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", BAND * b + 1, BAND)) for b in range(BINS // BAND)])
    each = points.select(F.col("node").alias("m"), F.explode(keys).alias("key"))
    met = materialise(each.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "met")
    shards = max(1, -(-met.count() // SHARD_ROWS))
    blocks = F.ceil(2 * F.col("n") / bound)
    block = F.pmod(F.xxhash64("m", F.lit(7)), blocks)
    pairs = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != block), lambda j: F.xxhash64("key", F.least(block, j), F.greatest(block, j)))
    dealt = met.select("m", "key", F.explode(F.when(F.col("n") > bound, pairs).otherwise(F.array(F.pmod(F.xxhash64("key"), F.lit(shards))))).alias("shard"))
    return dealt.join(points, dealt.m == points.node).select("shard", "key", "node", "prints", "sketch")


def bucket_pairs(key: np.ndarray, nodes: np.ndarray, prints: np.ndarray, sketches: np.ndarray, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of one bucket that are near by a print and share ``least`` of their sketches: enough to join what such pairs join.

    Small buckets are searched together, neighbours at one distance after the other; large ones each by each print.
    """
    order = np.argsort(key, kind="stable")
    key, nodes, prints, sketches = key[order], nodes[order], prints[order], sketches[order]
    names, place = np.unique(nodes, return_inverse=True)
    parent, out = np.arange(len(names)), [np.zeros((2, 0), np.int64)]
    size = np.diff(np.append(np.nonzero(np.diff(key, prepend=key[:1] - 1))[0], len(key)))
    few = np.nonzero(np.repeat(size <= FEW, size))[0]

    def join(x: np.ndarray, y: np.ndarray) -> None:
        used = unite(parent, x, y)
        out.append(np.stack([names[x[used]], names[y[used]]]))

    for step in range(1, FEW):
        i, j = few[:-step], few[step:]
        together = key[i] == key[j]
        if not together.any():
            break
        i, j = i[together], j[together]
        for cut in range(0, len(i), 1 << 15):
            x, y = i[cut : cut + (1 << 15)], j[cut : cut + (1 << 15)]
            apart = roots(parent, place[x]) != roots(parent, place[y])
            x, y = x[apart], y[apart]
            near = (np.bitwise_count(prints[x] ^ prints[y]) <= radius).any(axis=1)
            x, y = x[near], y[near]
            alike = (sketches[x] == sketches[y]).mean(axis=1) >= least
            join(place[x[alike]], place[y[alike]])
    ends = np.cumsum(size)
    for end, n in zip(ends[size > FEW], size[size > FEW]):
        own = slice(end - n, end)
        for p in range(prints.shape[1]):
            a, b = local_candidates(np.ascontiguousarray(prints[own, p]), place[own], np.ones(n, bool), radius, sketches[own], least, label=roots(parent, place[own]))
            join(a, b)
    a, b = np.concatenate(out, axis=1)
    return np.maximum(a, b), np.minimum(a, b)


def candidates(points: DataFrame, radius: int, least: float, bound: int = BOUND) -> DataFrame:
    """Candidate pairs (a, b) of points (node, prints, sketch), those of ``bucket_pairs`` of each shard."""

    def searched(table: pa.Table) -> pa.Table:
        prints = table.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        a, b = bucket_pairs(table.column("key").to_numpy(), table.column("node").to_numpy(), prints, sketches, radius, least)
        return pa.table({"a": a, "b": b})

    return banded(points, bound).groupBy("shard").applyInArrow(searched, "a long, b long").distinct()


def group_links(prints: np.ndarray, sketches: np.ndarray, label: np.ndarray, radius: int, least: float, same) -> list[tuple[int, int]]:
    """Pairs of places of one group that join what alike pairs join: ``same`` decides on pairs that are near by a print and by sketches.

    It is asked about no pair that is joined by then, by a label or by earlier pairs.
    """
    if len(prints) > 256:
        out = []
        for p in range(prints.shape[1]):
            a, b = local_candidates(np.ascontiguousarray(prints[:, p]), np.arange(len(prints)), np.ones(len(prints), bool), radius, sketches, least, same, label)
            _, first, of = np.unique(label, return_index=True, return_inverse=True)
            parent = first[of]
            unite(parent, a, b)
            label = roots(parent, np.arange(len(parent)))
            out += zip(a.tolist(), b.tolist())
        return out
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    parent = first[of]
    near = (np.bitwise_count(prints[:, None] ^ prints[None]) <= radius).any(axis=2) & (parent[:, None] != parent[None])
    x, y = np.nonzero(np.triu(near, 1))
    share = (sketches[x] == sketches[y]).mean(axis=1)
    x, y = x[share >= least], y[share >= least]
    sure = same(x, y)
    x, y = x[sure], y[sure]
    used = unite(parent, x, y)
    return list(zip(x[used].tolist(), y[used].tolist()))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per document: key, ``fp`` (long) and ``component_id``, the least key it reaches over links.

    Two documents link when their fingerprints differ in at most ``radius`` bits; null
    and empty texts have fingerprint 0 and link like any other. Rows with a null key link too: what
    they join is one component. It never has their key as its name, and is null where no row of it
    has a key. Repeated rows are returned as often as they come; further columns of ``docs``, also
    ones that are named like the results, are left out. An empty table gives an empty result. Texts
    are read whole: a long one is hashed ``BLOCK`` shingles at a time. Only distinct fingerprints
    are searched, so copies cost nothing more.
    """
    hashed = fingerprints(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), words, "t")
    hashed = materialise(hashed.select("id", "fp"), "fingerprints")
    distinct = materialise(hashed.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    found = connected_components(fingerprint_links(distinct.select("fp", F.col("fp").alias("id")), radius, leaf))
    grouped = distinct.join(found, distinct.fp == found.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("id").alias("component_id")).withColumnRenamed("group", "g")
    named = grouped.join(least, grouped.group == least.g).select(F.col("fp").alias("f"), "component_id")
    return hashed.join(named, hashed.fp == named.f, "left").select(F.col("id").alias(key), "fp", "component_id")


def dropped_copies(docs: DataFrame, words: int = 5, radius: int = WIDE, similarity: float = 0.8) -> DataFrame:
    """``id``: every ``doc_id`` but the least of each group of near copies, which share ``similarity`` of their sets of ``words``-word shingles.

    Links are pairs that are alike by their exact shingle sets. Fingerprints and sketches of these sets only spare comparisons: a pair that shares 0.8
    has no equal band with probability 5e-8 (32 bands), sketches that rule it out with 2e-8, and no fingerprint within the radius with under 1e-7,
    however short the texts are and whatever they repeat. A group of m copies
    has m * m pairs, so only a forest of candidates is listed, which tells the groups; the texts of a
    group then meet, and its candidate pairs are compared until its parts are joined or none is left. Texts with the same fingerprints and sketch (128 equal bins) are one point; ``node`` is its 64-bit hash.
    """

    @F.arrow_udf("struct<prints:array<long>,sketch:binary>")
    def marked(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_py(), words) for t in texts)
        marks = [(set_prints(h), set_sketch(h)) for h in sets]
        prints = np.array([p for p, _ in marks], np.uint64).reshape(-1, PRINTS).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * PRINTS), pa.array(prints.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array([s for _, s in marks], pa.binary())], ["prints", "sketch"])

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"))
    size = F.coalesce(F.octet_length("t"), F.lit(0)).cast("long")
    hashed = materialise(docs.select("id", F.xxhash64("t").alias("h"), size.alias("size"), marked("t").alias("m")).select("id", "h", "size", "m.prints", "m.sketch"), "fingerprints")
    first = hashed.groupBy("prints", "sketch").agg(F.min(F.struct("id", "h", "size")).alias("f"))
    points = materialise(first.select(F.xxhash64("prints", "sketch").alias("node"), "prints", "sketch", "f.id", "f.h", F.ceil(F.col("f.size") / WORD_BYTES).alias("n")), "points")
    tried = materialise(candidates(points.select("node", "prints", "sketch"), radius, similarity - MARGIN), "candidates")
    groups = connected_components(tried)
    groups = groups.select("node", F.col("component").alias("group")).unionAll(groups.select(F.col("component").alias("node"), F.col("component").alias("group"))).distinct()

    def near(table: pa.Table, own: np.ndarray):
        prints = table.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)[own]
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)[own]
        return lambda start, same: group_links(prints, sketches, start, radius, similarity - MARGIN, same)

    links = set_links(points, materialise(groups, "groups"), docs, words, similarity, ["prints", "sketch"], near)
    parts = connected_components(links)
    part = lambda n: parts.select(F.col("node").alias(f"n{n}"), F.col("component").alias(f"p{n}"))
    named = points.select("node", "id").join(part("s"), F.col("node") == F.col("ns"), "left")
    keep = named.groupBy(F.coalesce("ps", "node").alias("group")).agg(F.min("id").alias("_keep")).select("_keep")
    every = hashed.select("id").distinct()
    return every.join(keep, every.id == keep._keep, "left_anti")


def hex64(col):
    """A signed long as 16 lower-case hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def deduplicate(docs: DataFrame, words: int = 5, radius: int = WIDE, similarity: float = 0.8) -> DataFrame:
    """Keep the document with the least ``doc_id`` of each group of near copies; columns as given.

    Near copies share at least ``similarity`` of their ``words``-word shingles. Their fingerprints differ
    by more than a few bits, so the radius is wide. A tree of vantage points would send most points
    to both sides at every level, so points meet by bands of their sketches.

    A document is a ``doc_id``: rows that repeat one stay or go together. Rows without an id can't
    be told apart and stay. Null and empty texts are copies of one another; texts are read whole, an
    empty table stays empty, and further columns come through. Only the ids of what goes are joined
    to the documents, as a written table whose size is known.
    """
    gone = materialise(dropped_copies(docs, words, radius, similarity).select(F.col("id").alias("_gone")), "dropped")
    return docs.join(gone, docs.doc_id == gone._gone, "left_anti")
