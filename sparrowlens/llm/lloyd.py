"""Product codes of vectors by the filtering form of Lloyd's algorithm, in whole numbers.

Vectors are packed once into blocks of a bounded number of rows. A block has a kd-tree over its parts for each part
position; a node keeps its bounding box and the cached sum and count of its parts. A round sends every tree through
the codebook: at a node the entry nearest to the box's middle rules out each entry that is nowhere in the box nearer
(or as near with a lower index), and once one is left the whole subtree is its, by the cached sums. Only sums and
counts of entries leave a block, so a round shuffles a bounded table however many vectors there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Vectors of a block, parts of a leaf.
BLOCK_ROWS, LEAF = 1 << 13, 32
#: Components are kept below this size, so that squared distances of up to 1024 of them fit 64 bits.
MOST = 1 << 25
#: Below this size products and their sums are exact in doubles too.
SMALL = 1 << 20


def whole(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x); null if the vector is null or empty or a component is null, not finite or too large to keep."""
    x = F.transform(vector, lambda v: F.floor(scale * v.cast("double")))
    good = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(scale * v.cast("double")) < MOST)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, good), x.cast("array<int>"))


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level of a balanced tree over n places begin, and n."""
    return (np.arange(2**level + 1, dtype=np.int64) * n) >> level


def depth_of(n: int) -> int:
    return max(0, int(np.ceil(np.log2(n / LEAF)))) if n else 0


def kd_order(points: np.ndarray) -> np.ndarray:
    """An order of the points in which every node of the balanced tree is a range, split at the median of its widest side."""
    order, depth = np.arange(len(points)), depth_of(len(points))
    for level in range(depth):
        edges, middles = bounds(len(points), level), bounds(len(points), level + 1)[1::2]
        for a, m, b in zip(edges[:-1], middles, edges[1:]):
            part = points[order[a:b]]
            side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order[a:b] = order[a:b][np.argpartition(part[:, side], m - a)]
    return order


class Tree:
    """A kd-tree over the rows of ``points`` (in tree order): boxes, sums and counts of each level."""

    def __init__(self, points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None):
        self.points, self.n = points.astype(np.int64), len(points)
        self.depth = depth_of(self.n)
        self.levels = levels if levels is not None else [self._cached(level) for level in range(self.depth + 1)]

    def _cached(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = bounds(self.n, level)[:-1]
        return np.minimum.reduceat(self.points, at), np.maximum.reduceat(self.points, at), np.add.reduceat(self.points, at)

    def packed(self) -> bytes:
        return b"".join(x.astype("<i8").tobytes() for level in self.levels for x in level)

    @classmethod
    def unpacked(cls, points: np.ndarray, data: bytes) -> Tree:
        d, at, levels = points.shape[1], 0, []
        flat = np.frombuffer(data, "<i8")
        for level in range(depth_of(len(points)) + 1):
            size = 2**level * d
            levels.append(tuple(flat[at + k * size : at + (k + 1) * size].reshape(-1, d) for k in range(3)))
            at += 3 * size
        return cls(points, levels)

    def filtered(self, entries: np.ndarray):
        """Yield (first place, end, place of its level and node, entries left) of subtrees that no more is ruled out for; places cover all points once."""
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        for level in range(self.depth + 1):
            low, high, _ = self.levels[level]
            edges = bounds(self.n, level)
            keep_n, keep_m = [], []
            for cut in range(0, len(nodes), 64):
                own, mask = nodes[cut : cut + 64], left[cut : cut + 64]
                mask = ruled_out(low[own], high[own], entries, mask)
                single = mask.sum(axis=1) == 1
                done = single | (level == self.depth)
                for k in np.nonzero(done)[0]:
                    yield int(edges[own[k]]), int(edges[own[k] + 1]), (level, int(own[k])), np.nonzero(mask[k])[0]
                keep_n.append(own[~done])
                keep_m.append(mask[~done])
            nodes = np.concatenate(keep_n) if keep_n else nodes[:0]
            left = np.concatenate(keep_m) if keep_m else left[:0]
            if not len(nodes):
                break
            nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
            left = np.repeat(left, 2, axis=0)

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points nearest to each entry."""
        total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        for a, b, (level, node), left in self.filtered(entries):
            if len(left) == 1:
                total[left[0]] += self.levels[level][2][node]
                count[left[0]] += b - a
            else:
                near = left[nearest(self.points[a:b], entries[left])[0]]
                np.add.at(total, near, self.points[a:b])
                count += np.bincount(near, minlength=len(entries))
        return total, count

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point (in tree order) its nearest entry and the squared distance to it."""
        code, error = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for a, b, _, left in self.filtered(entries):
            near, far = nearest(self.points[a:b], entries[left])
            code[a:b], error[a:b] = left[near], far
        return code, error


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties to the lower place) and its squared distance, exact."""
    kind = np.float64 if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) < SMALL else np.int64
    p, z = points.astype(kind), entries.astype(kind)
    far = (z * z).sum(axis=1)[None] - 2 * (p @ z.T)
    near = np.argmin(far, axis=1)
    return near, (((points - entries[near]) ** 2).sum(axis=1)).astype(np.int64)


def ruled_out(low: np.ndarray, high: np.ndarray, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which of the entries that are left for each box can be nearest to any point of it.

    The entry nearest to the middle stays. Another z goes if, at the corner of the box that lies
    farthest towards z, it isn't nearer than that one; if as near, only if its index is higher.
    """
    middle = low + high  # twice the middle, and so are the entries
    far = ((middle[:, None, :] - 2 * entries[None]) ** 2).sum(axis=2)
    best = np.argmin(np.where(left, far, np.iinfo(np.int64).max), axis=1)
    own = entries[best][:, None, :]
    corner = np.where(entries[None] > own, high[:, None, :], low[:, None, :])
    more = ((entries[None] - own) * (entries[None] + own - 2 * corner)).sum(axis=2)  # distance of z less that of the best, at the corner
    number = np.arange(len(entries))[None]
    return left & ((more < 0) | ((more == 0) & (number <= best[:, None])))


def blocks(vectors: DataFrame, parts: int, dim: int) -> DataFrame:
    """Blocks of at most ``BLOCK_ROWS`` vectors (id, v, label): ids, labels, and for each part position tree order, points and cached levels."""
    width = dim // parts

    def built(batches):
        held, n = [], 0

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            points = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            order, data, levels = [], [], []
            for k in range(parts):
                own = points[:, k * width : (k + 1) * width]
                by = kd_order(own)
                order.append(by.astype("<i4").tobytes())
                data.append(own[by].astype("<i4").tobytes())
                levels.append(Tree(own[by]).packed())
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("id", pa.int64()), ("label", pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([len(points)], pa.int32()), *lists, *[pa.array([x], pa.list_(pa.binary())) for x in (order, data, levels)]], names=["n", "ids", "labels", "orders", "points", "levels"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, BLOCK_ROWS - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return vectors.select("id", "v", "label").mapInArrow(built, "n int, ids array<long>, labels array<long>, orders array<binary>, points array<binary>, levels array<binary>")


def trees(batch: pa.RecordBatch, k: int, width: int):
    """The trees of part position k of each block of a batch."""
    for points, levels in zip(batch.column("points"), batch.column("levels")):
        yield Tree.unpacked(np.frombuffer(points[k].as_py(), "<i4").reshape(-1, width), levels[k].as_py())


def next_codebooks(built: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floor of the mean of what is nearest to them; unused ones stay."""
    parts, entries, width = books.shape

    def summed(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for k in range(parts):
                for tree in trees(batch, k, width):
                    s, c = tree.sums(books[k])
                    total[k] += s
                    count[k] += c
        part, entry = np.nonzero(count)
        place = np.tile(np.arange(width), len(part))
        columns = [np.repeat(part, width), np.repeat(entry, width), place, total[part, entry].ravel(), np.repeat(count[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["part", "entry", "place", "total", "n"])

    sums = built.select("points", "levels").mapInArrow(summed, "part int, entry int, place int, total long, n long")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = books.copy()
    for r in sums.collect():  # a row for each component of the codebooks at most
        new[r.part, r.entry, r.place] = r.total // r.n
    return new


def compress(docs: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, ``code`` (an entry number per part), ``error``, ``label_error`` and ``codebooks``.

    Components are floor(scale * x). Codebooks start as the parts of the ``entries`` vectors with
    the smallest keys (equal keys by components; nulls last); then come ``rounds`` rounds of
    Lloyd's algorithm over all vectors, exact in whole numbers, ties to the lower entry. ``error``
    is the squared distance to the chosen entries, ``label_error`` its sum over equal labels (nulls
    together) and ``codebooks`` all final components, comma-joined by part, entry and place.
    Left out are vectors that are null, empty or hold null or non-finite components or some with
    |scale * x| of 2^25 or more, which 64-bit distances couldn't hold, and vectors whose length
    isn't that of the vector with the smallest key. That length must be a multiple of ``parts``,
    else a ValueError is raised. Repeated rows count and return as often as they come, rows with
    null keys too; further columns, also ones named like the results, are left out. No vectors give
    no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"), F.col(label).cast("long").alias("label")).where("v is not null")
    rows = materialise(rows, "vectors")
    start = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    dim = len(start[0].v) if start else parts
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} parts")
    rows = rows.where(F.size("v") == dim)
    start = rows.select("v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    width = dim // parts
    books = np.array([r.v for r in start], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    built = materialise(blocks(rows, parts, dim), "blocks")
    for _ in range(rounds if start else 0):
        books = next_codebooks(built, books)

    def coded(batches):
        for batch in batches:
            for block in range(batch.num_rows):
                n = batch.column("n")[block].as_py()
                code, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
                one = batch.slice(block, 1)
                for k in range(parts):
                    tree = next(trees(one, k, width))
                    order = np.frombuffer(one.column("orders")[0][k].as_py(), "<i4")
                    c, e = tree.assigned(books[k])
                    code[order, k] = c
                    error[order] += e
                ids, labels = one.column("ids").flatten(), one.column("labels").flatten()
                codes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(code.ravel().astype(np.int32)))
                for a in range(0, n, 4096):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 4096) for x in (ids, labels, codes, pa.array(error))], names=["id", "label", "code", "error"])

    found = materialise(built.mapInArrow(coded, "id long, label long, code array<int>, error long"), "codes")
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    text = ",".join(map(str, books.ravel().tolist()))
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(text).alias("codebooks"))


def hex_code(code: Column) -> Column:
    """Entry numbers below 256 as two lower-case hex digits each."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
