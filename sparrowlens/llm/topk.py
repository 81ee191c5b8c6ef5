"""Exact top-k inner products: ball trees over shards of space, searched by branch and bound in rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Vectors that a shard is planned for, queries that meet a shard or all summaries at once, vectors of a leaf.
SHARD, QUERIES, LEAF = 16_384, 4_096, 128
#: Depth of the tree that deals vectors to shards, and sampled vectors for each of its leaves: what the driver holds.
MAX_DEPTH, SAMPLE_PER_LEAF = 12, 16
#: Shards that a query visits in the first round; each further round visits so many times more.
FIRST, MORE = 1, 4
#: Blocks of queries that meet the summaries of all shards at once, and cells of the matrix of their bounds that is held at once.
ASKED, TILE = 4, 1 << 22


class BallTree:
    """Balls over integer vectors; arrays in heap order, a node's rows are rows[start:end]."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        """Build the tree; ``rows`` is the order in which its nodes hold the vectors."""
        self.rows = np.arange(len(vectors))
        self.start, self.end, self.kids, centres, radii = [], [], [], [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            s, e, parent, side = todo.pop()
            own = vectors[self.rows[s:e]]
            centre = own.mean(axis=0)
            node = len(self.start)
            self.start.append(s), self.end.append(e), self.kids.append([-1, -1])
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            if parent >= 0:
                self.kids[parent][side] = node
            if e - s > leaf and radii[-1] > 0:
                a = own[((own - centre) ** 2).sum(axis=1).argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                order = np.argsort(own @ (b - a), kind="stable")
                self.rows[s:e] = self.rows[s:e][order]
                mid = (s + e) // 2
                todo += [(s, mid, node, 0), (mid, e, node, 1)]
        self.centres, self.radii, self.kids = np.array(centres), np.array(radii), np.array(self.kids)
        self.start, self.end = np.array(self.start), np.array(self.end)

    @classmethod
    def stored(cls, start, end, kids, centres, radii) -> BallTree:
        """A tree whose vectors are stored in its own order."""
        tree = cls.__new__(cls)
        tree.start, tree.end, tree.kids, tree.centres, tree.radii = start, end, kids.reshape(-1, 2), centres.reshape(len(start), -1), radii
        tree.rows = np.arange(end[0])
        return tree

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of queries with what lies in nodes, with room for rounding."""
        at = queries @ self.centres[nodes].T
        size = np.sqrt((queries**2).sum(axis=1))[:, None]
        return (at + size * self.radii[nodes]) * 1.0 + 1e-9 * (1 + np.abs(at) + size * self.radii[nodes])


def _better(scores, ids, more_scores, more_ids, k):
    """The k best of two lists per row: scores descending, then ids ascending."""
    s, i = np.concatenate([scores, more_scores], axis=1), np.concatenate([ids, more_ids], axis=1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, tree: BallTree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query among the vectors, or fewer: missing ones have id -1 << 63.

    ``floor``: a score that the query's k-th best is known to reach elsewhere. Every query visits
    leaves in the order of their bounds; a leaf whose bound lies below the current k-th score is
    never opened. Leaves are opened for all queries that want them at once.
    """
    none, low = np.iinfo(np.int64).min, -np.inf
    n = len(queries)
    scores, found = np.full((n, k), low), np.full((n, k), none)
    tree = tree or BallTree(vectors)
    kth = np.full(n, low) if floor is None else floor.astype(float)
    # down the tree: bounds of the leaves that each query may have to open
    level, reach = np.array([0]), np.ones((n, 1), bool)
    leaves, bounds = [], []
    while len(level):
        bound = np.where(reach, tree.bounds(queries, level), low)
        reach = bound >= kth[:, None]
        is_leaf = tree.kids[level, 0] < 0
        leaves.append(level[is_leaf])
        bounds.append(np.where(reach, bound, low)[:, is_leaf])
        inner = ~is_leaf
        level, reach = tree.kids[level[inner]].reshape(-1), np.repeat(reach[:, inner], 2, axis=1)
    leaves, bounds = np.concatenate(leaves), np.concatenate(bounds, axis=1)
    order = np.argsort(-bounds, axis=1, kind="stable")
    width, at = 1, 0
    while at < len(leaves):
        turn = order[:, at : at + width]
        want = np.take_along_axis(bounds, turn, 1)
        want = (want >= kth[:, None]) & (want > low)
        if not want.any():
            break
        who, column = np.nonzero(want)
        which = turn[who, column]
        by_leaf = np.argsort(which, kind="stable")
        for part in np.split(by_leaf, np.nonzero(np.diff(which[by_leaf]))[0] + 1):
            rows = who[part]
            own = tree.rows[tree.start[leaves[which[part[0]]]] : tree.end[leaves[which[part[0]]]]]
            got = queries[rows] @ vectors[own].T
            their = np.broadcast_to(ids[own], got.shape)
            got = np.where(their == query_ids[rows][:, None], low, got)
            if got.shape[1] > 4 * k:  # ties with the k-th stay in
                cut = np.partition(got, -k, axis=1)[:, -k]
                most = int((got >= cut[:, None]).sum(axis=1).max())
                if most <= 4 * k:
                    top = np.argpartition(got, -most, axis=1)[:, -most:]
                    got, their = np.take_along_axis(got, top, 1), np.take_along_axis(their, top, 1)
            scores[rows], found[rows] = _better(scores[rows], found[rows], got, np.where(got == low, none, their), k)
        kth = np.maximum(kth, scores[:, -1])
        at, width = at + width, min(2 * width, 32)
    return scores, found


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v``, the components as floor(scale x component); vectors that are null, empty or hold null, infinite or NaN components go."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(F.col(key).isNotNull() & sound).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def deal(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, float] | None]:
    """A tree of half-spaces over a sample as an array heap, a direction and a limit each, or None for a leaf."""
    planes: list[tuple[np.ndarray, float] | None] = [None] * (2 ** (depth + 1) - 1)
    parts = {0: sample}
    for node in range(2**depth - 1):
        own = parts.pop(node, None)
        if own is None or len(own) < 4:
            continue
        far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        way = own[((own - far) ** 2).sum(axis=1).argmax()] - far
        at = own @ way
        limit = float(np.median(at))
        if (at > limit).any():
            planes[node] = (way, limit)
            parts[2 * node + 1], parts[2 * node + 2] = own[at <= limit], own[at > limit]
    return planes


def leaf_of(x: np.ndarray, planes: list) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    todo = [0]
    while todo:
        at = todo.pop()
        if at < len(planes) and planes[at] is not None:
            here = np.nonzero(node == at)[0]
            way, limit = planes[at]
            node[here] = 2 * at + 1 + (x[here] @ way > limit)
            todo += [2 * at + 1, 2 * at + 2]
    return node


def matrix(column, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def exact_in_doubles(x: np.ndarray) -> bool:
    """Whether inner products of such vectors are whole numbers that doubles hold."""
    return not x.size or float(np.abs(x).max()) ** 2 * x.shape[1] < 2**52


TREE = "shard long, dim int, ids array<long>, v array<long>, start array<int>, stop array<int>, kids array<int>, centres array<double>, radii array<double>, middle array<long>, reach double"


def trees(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard: its vectors in the order of a ball tree, the tree, and a ball of whole numbers around them all.

    Shards are leaves of half-spaces that the driver fits on a bounded sample; a leaf of more than
    two shards, as of very many equal vectors, is dealt into several by hash.
    """
    spark = vectors.sparkSession
    sizes = {r[0]: r[1] for r in vectors.groupBy(F.size("v")).count().collect()}  # a row for each length of vector
    planes = {}
    for dim, n in sizes.items():
        depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(n / shard)))))
        if depth:
            want = SAMPLE_PER_LEAF * 2**depth
            own = vectors.where((F.size("v") == dim) & (F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(max(1, n // want))) == 0)).limit(2 * want)
            planes[dim] = deal(np.array([r.v for r in own.select("v").collect()], np.float64).reshape(-1, dim), depth)
    shared = spark.sparkContext.broadcast(planes)  # at most 2 ** MAX_DEPTH planes for each length

    def dealt(batches):
        for batch in batches:
            dims, leaf = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in shared.value:
                    own = np.nonzero(dims == dim)[0]
                    leaf[own] = leaf_of(matrix(batch.column("v").take(pa.array(own)), len(own)).astype(np.float64), shared.value[dim])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("dim"), pa.array(leaf)], names=["id", "v", "dim", "leaf"])

    table = materialise(vectors.select("id", "v", F.size("v").alias("dim")).mapInArrow(dealt, "id long, v array<long>, dim int, leaf long"), "dealt")
    many = table.groupBy("dim", "leaf").count().where(F.col("count") > 2 * shard).select(F.col("dim").alias("d"), F.col("leaf").alias("f"), F.ceil(F.col("count") / shard).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(2), "id", "v"), F.col("parts")), F.lit(0))
    numbered = table.join(materialise(many, "large"), (F.col("dim") == F.col("d")) & (F.col("leaf") == F.col("f")), "left")
    numbered = numbered.select("id", "v", "dim", (F.shiftleft(F.col("dim").cast("long"), 40) + F.shiftleft(F.col("leaf"), 24) + part).alias("shard"))

    def built(table: pa.Table) -> pa.Table:
        v, ids = matrix(table.column("v"), table.num_rows), table.column("ids").to_numpy()
        if exact_in_doubles(v):
            x = v.astype(np.float64)
            tree = BallTree(x)
            middle = np.rint(tree.centres[0])
            reach = float(np.sqrt(((x - middle) ** 2).sum(axis=1).max()))
            v, ids = v[tree.rows], ids[tree.rows]
            parts = [tree.start, tree.end, tree.kids.ravel(), tree.centres.ravel(), tree.radii]
        else:  # no ball bounds it: every query visits it and plain whole numbers score it
            middle, reach, parts = np.zeros(v.shape[1]), float("inf"), [[], [], [], [], []]
        kinds = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.float64())] * 2
        columns = [table.column("shard").slice(0, 1), table.column("dim").slice(0, 1), pa.array([ids], pa.list_(pa.int64())), pa.array([v.ravel()], pa.list_(pa.int64()))]
        columns += [pa.array([np.asarray(x)], kind) for x, kind in zip(parts, kinds)] + [pa.array([middle.astype(np.int64)], pa.list_(pa.int64())), pa.array([reach])]
        return pa.table(columns, names=[c.split()[0] for c in TREE.split(", ")])

    return materialise(numbered.withColumnRenamed("id", "ids").groupBy("shard").applyInArrow(built, TREE), "trees")


def tiles(rows: int, columns: int) -> list[tuple[int, int]]:
    """Ranges of rows such that a matrix of a range and so many columns has at most ``TILE`` cells, or is one row."""
    step = max(1, TILE // max(1, columns))
    return [(a, min(rows, a + step)) for a in range(0, rows, step)]


def next_shards(q: np.ndarray, centre: np.ndarray, reach: np.ndarray, seen: np.ndarray, kth: np.ndarray, take: int, sure: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query row, shard place) of the next ``take`` shards of each query in the order of their bounds, as far as these reach its k-th score."""
    size = np.sqrt((q**2).sum(axis=1))[:, None]
    with np.errstate(invalid="ignore"):
        far = size * reach[None]
        bound = q @ centre.T  # whole numbers: the same in every round, whatever the order of rows
        bound = bound + far * (1 + 1e-12) + 1e-9
    bound[np.isnan(bound) | np.isinf(reach)[None]] = np.inf
    if not sure:
        bound[:] = np.inf
    turn = np.argsort(-bound, axis=1, kind="stable")
    at = seen[:, None] + np.arange(min(take, len(reach)))[None]
    place = np.take_along_axis(turn, np.minimum(at, len(reach) - 1), 1)
    who, where = np.nonzero((at < len(reach)) & (np.take_along_axis(bound, place, 1) >= kth[:, None]))
    return who, place[who, where]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """The k best integer inner products of each query: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have ``id`` and ``v`` (array of long); further columns are left out.
    A query never meets rows of its own id; ties go to the smaller id, and rows that repeat an id
    count once each. Query rows that repeat an id count once (the least vector). Vectors of another
    length than the query's are no candidates; no candidates give no rows, and neither does an empty
    table. A stated query set meets all rows: every shard has one ball tree, built once, and each
    query goes through the shards in the order of the upper bounds that their balls give, in rounds
    that share its current k-th score. A round sends a query only to the next shards whose bound
    reaches that score, so shards out of reach get neither query nor vectors. Values whose products
    doubles don't hold (over 2^52) are scored by Python's whole numbers, without bounds.
    """
    held = trees(vectors, shard)
    balls = held.select("shard", "dim", "middle", "reach")
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // (ASKED * block)))
    state = queries.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("block"), F.lit(float("-inf")).alias("kth"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("array<struct<neg:long,vec_id:long>>").alias("best"))
    state = materialise(state, "queries")
    every = balls.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    take = FIRST
    while True:

        def chosen(asked: pa.Table, balls: pa.Table) -> pa.Table:
            """The next shards of each query by their bounds, as far as they reach its k-th score."""
            out = [np.zeros(0, np.int64)] * 2
            if asked.num_rows and balls.num_rows:
                order = np.argsort(balls.column("shard").to_numpy())
                q, centre, reach = matrix(asked.column("v"), asked.num_rows).astype(np.float64), matrix(balls.column("middle"), balls.num_rows)[order].astype(np.float64), balls.column("reach").to_numpy()[order]
                seen, kth, sure = asked.column("seen").to_numpy(), asked.column("kth").to_numpy(), exact_in_doubles(q)
                parts = [next_shards(q[a:b], centre, reach, seen[a:b], kth[a:b], take, sure) for a, b in tiles(len(q), len(reach))]
                out = [np.concatenate([who + a for (who, _), (a, _) in zip(parts, tiles(len(q), len(reach)))]), balls.column("shard").to_numpy()[order][np.concatenate([where for _, where in parts])]]
            own = asked.take(pa.array(out[0], pa.int64()))
            return pa.table({"id": own.column("id"), "v": own.column("v"), "kth": own.column("kth"), "shard": pa.array(out[1], pa.int64())})

        theirs = every.select(*[F.col(c).alias(c) for c in every.columns])
        visits = materialise(state.select("id", "v", "dim", "block", "kth", "seen").groupBy("dim", "block").cogroup(theirs.groupBy("dim", "block")).applyInArrow(chosen, "id long, v array<long>, kth double, shard long"), "visits")
        if visits.isEmpty():
            break
        # a shard is sent once for so many queries; its other queries get copies of it
        loads = materialise(visits.groupBy(F.col("shard").alias("s")).agg(F.ceil(F.count("*") / (8 * block)).alias("copies")), "loads")
        going = visits.join(loads, visits.shard == loads.s).select("id", "v", "kth", "shard", F.pmod(F.xxhash64(F.lit(4), "id"), F.col("copies")).alias("copy"))
        there = held.drop("middle", "reach").join(loads, held.shard == loads.s).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("s", "copies")
        there = there.select(*[F.col(c).alias(c) for c in there.columns])

        def searched(asked: pa.Table, shard: pa.Table) -> pa.Table:
            out = {"query_id": [], "neg": [], "vec_id": []}
            if asked.num_rows and shard.num_rows:
                row = {c: shard.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "v", "start", "stop", "kids", "centres", "radii")}
                q, qid, kth = matrix(asked.column("v"), asked.num_rows), asked.column("id").to_numpy(), asked.column("kth").to_numpy()
                v, vid = row["v"].reshape(len(row["ids"]), -1), row["ids"]
                for at in range(0, len(q), block):
                    part, own = q[at : at + block], qid[at : at + block]
                    if len(row["start"]) and exact_in_doubles(part):
                        tree = BallTree.stored(row["start"], row["stop"], row["kids"], row["centres"], row["radii"])
                        scores, ids = search(part.astype(np.float64), own, v.astype(np.float64), vid, k, kth[at : at + block], tree)
                    else:
                        scores, ids = plain(part.astype(object), own, v.astype(object), vid, k)
                    who, column = np.nonzero((ids != np.iinfo(np.int64).min) & (scores >= kth[at : at + block][:, None]))
                    out["query_id"] += own[who].tolist()
                    out["neg"] += [-int(s) for s in scores[who, column]]
                    out["vec_id"] += ids[who, column].tolist()
            return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

        found = going.groupBy("shard", "copy").cogroup(there.groupBy("shard", "copy")).applyInArrow(searched, "query_id long, neg long, vec_id long")
        # no list is longer than the k best of the shards of a round
        lists = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("neg", "vec_id"))), 1, k).alias("more"))
        gone = visits.groupBy(F.col("id").alias("g")).agg(F.count("*").alias("went"))
        now = state.join(gone, state.id == gone.g, "left").join(lists, F.col("id") == F.col("query_id"), "left")
        empty = F.array().cast("array<struct<neg:long,vec_id:long>>")
        best = F.slice(F.sort_array(F.concat(F.coalesce("best", empty), F.coalesce("more", empty))), 1, k)
        now = now.select("id", "v", "dim", "block", F.when(F.size(best) >= k, -F.element_at(best, k)["neg"].cast("double")).otherwise(F.col("kth")).alias("kth"), (F.col("seen") + F.coalesce("went", F.lit(0))).alias("seen"), best.alias("best"))
        state = materialise(now, "queries")
        take *= MORE
    top = state.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "b"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score"))


def plain(q, qid, v, vid, k):
    """The same answer by Python's whole numbers; a score that no long holds raises."""
    none = np.iinfo(np.int64).min
    scores, ids = np.full((len(q), k), none, object), np.full((len(q), k), none, np.int64)
    for i in range(len(q)):
        every = sorted((-int(s), int(j)) for s, j in zip(v @ q[i], vid) if j != qid[i])[:k]
        for r, (s, j) in enumerate(every):
            scores[i, r], ids[i, r] = -s, j
    return scores, ids
