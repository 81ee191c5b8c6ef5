"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import best_of, materialise

#: Tables; vectors that a cell of a table holds on average, so that a hash has log2(n / CELL) bits.
TABLES, CELL = 4, 24
#: Of ``c`` cells a query probes share x c ** GROWTH: fewer of them, as a share, the more there are. The share is fitted
#: for each length of vector: with it ``COVERED`` of the true neighbours of ``SAMPLE`` queries, found by comparing these
#: queries with all vectors, lie in probed cells. A cell beyond the ``RANKED`` likeliest counts as never probed.
GROWTH, COVERED, SAMPLE, RANKED = 0.62, 0.95, 96, 1 << 15
#: Bounds of a fitted share, and its factor from one pass to the next for queries that found fewer than k.
LEAST, WIDER = 0.3, 4
#: Bands of norms to a doubling; each has tables of its own.
BANDS = 4
#: Vectors of neighbouring cells that are stored together and meet queries in a task, and queries that meet them at once.
REGION, QUERIES = 32_768, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width) / np.sqrt(width)


def pseudo_rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """H D3 H D2 H D1 x with random signs D; rows are padded with zeros to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes_of(width: int, bits: int) -> list[int]:
    """How many axes each pseudo-rotation of a hash of so many bits chooses from (each with both signs): all but in the last."""
    whole, out = (2 * width).bit_length() - 1, []
    while bits > 0:
        out.append(1 << (min(bits, whole) - 1))
        bits -= whole
    return out


def width_of(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def homes(unit: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The cell of each unit vector in a table: its nearest signed axis in each of the hash's rotations."""
    code = np.zeros(len(unit), np.int64)
    for r, m in enumerate(axes_of(width_of(unit.shape[1]), bits)):
        y = pseudo_rotation(unit, 1000 * table + r)[:, :m]
        code = code * (2 * m) + np.concatenate([y, -y], axis=1).argmax(axis=1)
    return code


def probes(unit: np.ndarray, table: int, bits: int, n: int, ranked: bool = False) -> np.ndarray:
    """The ``n`` likeliest cells of neighbours of each unit vector, by how little their axes lie behind the nearest ones; ``ranked``: the likeliest first."""
    code, behind = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for r, m in enumerate(axes_of(width_of(unit.shape[1]), bits)):
        y = pseudo_rotation(unit, 1000 * table + r)[:, :m]
        y = np.concatenate([y, -y], axis=1)
        loss = (y.max(axis=1, keepdims=True) - y) ** 2
        code = (code[:, :, None] * (2 * m) + np.arange(2 * m)[None, None]).reshape(len(unit), -1)
        behind = (behind[:, :, None] + loss[:, None, :]).reshape(len(unit), -1)
        if behind.shape[1] > n:  # losses only add up, so what is out stays out
            best = np.argpartition(behind, n - 1, axis=1)[:, :n]
            code, behind = np.take_along_axis(code, best, 1), np.take_along_axis(behind, best, 1)
    return np.take_along_axis(code, np.argsort(behind, axis=1, kind="stable"), 1) if ranked else code


def wanted(share: float, cells: int) -> int:
    """How many of so many cells are probed at a share."""
    return cells if share * cells**GROWTH >= cells else max(1, int(np.ceil(share * cells**GROWTH)))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j].astype(np.float64) * b[:, j]
    return total


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(rows, -1)


def first_of_copies(v: np.ndarray, vid: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """Places, by cell and id, of all vectors but those with at least ``k`` copies of lesser id: they can't be among k best."""
    order = np.lexsort((vid, np.unique(np.ascontiguousarray(v).view(f"V{v.shape[1] * v.itemsize}").ravel(), return_inverse=True)[1]))
    same = np.concatenate([[False], (v[order[1:]] == v[order[:-1]]).all(axis=1)])
    turn = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    kept = order[turn < k]
    return kept[np.lexsort((vid[kept], cell[kept]))]


def nearest(q: np.ndarray, qid: np.ndarray, asks: np.ndarray, cells: np.ndarray, v: np.ndarray, vid: np.ndarray, home: np.ndarray, k: int, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each query among the vectors of its cells, exactly scored; ties by id.

    ``asks`` and ``cells`` are the probes: query rows and cells. Products in single precision choose
    what is scored again in double precision, with room for their rounding.
    """
    place = first_of_copies(v, vid, home, k + 1)  # one of them may be the query itself
    v, vid, home = v[place], vid[place], home[place]
    some, start = np.unique(home, return_index=True)
    stop = np.append(start[1:], len(home))
    at = np.minimum(np.searchsorted(some, cells), len(some) - 1)
    hit = some[at] == cells
    asks, at = asks[hit], at[hit]
    order = np.argsort(at, kind="stable")
    asks, at = asks[order], at[order]
    # scaled: a block's vectors are of one band of norms, and a query's own size doesn't change the order
    wide = lambda x, axis: x / np.abs(x.astype(np.float64)).max(axis=axis, keepdims=True, initial=1e-300)
    q32, v32 = wide(q, 1).astype(np.float32), wide(v, None).astype(np.float32)
    room = np.sqrt((q32**2).sum(axis=1)) * np.sqrt((v32**2).sum(axis=1).max(initial=0)) * q.shape[1] * 3e-7
    kth = np.full(len(q), -np.inf)
    who, what, rough, n = [], [], [], 0

    def pruned():
        a, b, c = np.concatenate(who), np.concatenate(what), np.concatenate(rough)
        by = np.lexsort((-c, a))
        a, b, c = a[by], b[by], c[by]
        first = np.searchsorted(a, a)
        last = np.minimum(first + k, np.searchsorted(a, a, "right")) - 1
        full = np.searchsorted(a, a, "right") - first >= k
        limit = np.where(full, c[last] - room[a], -np.inf)
        kth[a] = limit
        keep = c >= limit
        return [a[keep]], [b[keep]], [c[keep]], int(keep.sum())

    for part in np.split(np.arange(len(at)), np.nonzero(np.diff(at))[0] + 1) if len(at) else ():
        rows, lo, hi = asks[part], start[at[part[0]]], stop[at[part[0]]]
        got = q32[rows] @ v32[lo:hi].T
        i, j = np.nonzero((got >= kth[rows][:, None]) & (qid[rows][:, None] != vid[None, lo:hi]))
        who.append(rows[i]), what.append(j + lo), rough.append(got[i, j])
        n += len(i)
        if n > held:
            who, what, rough, n = pruned()
            held = max(held, 2 * n)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    (who,), (what,), _, _ = pruned()
    score = np.concatenate([inner(q[who[a : a + (1 << 16)]], v[what[a : a + (1 << 16)]]) for a in range(0, len(who), 1 << 16)])
    order = np.lexsort((vid[what], -score, who))
    who, what, score = who[order], what[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], vid[what[keep]], score[keep]


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (floats as they are, other numbers as doubles) without vectors that are null, empty, zero or hold null or non-finite components."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.where(F.col(key).isNotNull() & sound).where(F.exists(x, lambda c: c != 0)).select(F.col(key).cast("long").alias("id"), x.cast(kind).alias("v"))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay in range
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def true_neighbours(index: DataFrame, sample: list, k: int) -> DataFrame:
    """For each sampled query (its number ``q``) its k nearest among all vectors of ``index``: score, band and cells of each.

    Every task keeps its own k best, and these are reduced in two steps.
    """
    dims = sorted({r.dim for r in sample})
    of = {d: (np.array([i for i, r in enumerate(sample) if r.dim == d]), np.array([r.v for r in sample if r.dim == d], np.float64), np.array([r.id for r in sample if r.dim == d], np.int64)) for d in dims}

    def best(batches):
        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for d in set(np.unique(sizes).tolist()) & set(dims):
                own = batch.filter(pa.array(sizes == d))
                number, q, qid = of[d]
                scores = q @ _matrix(own.column("v"), own.num_rows).astype(np.float64).T
                ids = own.column("id").to_numpy()
                scores[qid[:, None] == ids[None]] = -np.inf
                bands, cells = own.column("band").to_numpy(), _matrix(own.column("cell"), own.num_rows)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                for n, row, some in zip(number.tolist(), scores, top):
                    new = [(-row[j], int(bands[j]), cells[j].tolist()) for j in some if np.isfinite(row[j])]
                    held[n] = sorted(held[n] + new)[:k]
        rows = [(n, *x) for n, own in held.items() for x in own]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int64())))], names=["q", "neg", "band", "cells"])

    found = index.select("id", "v", "dim", "band", "cell").mapInArrow(best, "q int, neg double, band int, cells array<long>")
    found = found.withColumn("part", F.spark_partition_id() % 64)
    for keys in (["q", "part"], ["q"]):
        lists = found.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("neg", "band", "cells"))), 1, k).alias("best"))
        found = lists.select(*keys, F.inline("best"))
    return found


def fitted_shares(index: DataFrame, asking: DataFrame, bits: dict[int, dict[int, int]], k: int, tables: int) -> dict[int, float]:
    """By length of vector: the share of cells at which queries probe the cells of most of their true neighbours."""
    sample = asking.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("id", "v", "dim").collect()
    ranks, shares = {}, defaultdict(list)
    for r in true_neighbours(index, sample, k).collect() if sample else ():  # k rows for each of the sample
        dim, row = sample[r.q].dim, sample[r.q]
        n = bits[dim][r.band]
        best = np.inf
        for t in range(tables):
            if (r.q, r.band, t) not in ranks:
                order = probes(unit_vectors(np.array([row.v])), t, n, min(1 << n, RANKED), ranked=True)[0]
                ranks[r.q, r.band, t] = dict(zip(order.tolist(), range(1, len(order) + 1)))
            best = min(best, ranks[r.q, r.band, t].get(r.cells[t], np.inf) / (1 << n) ** GROWTH)
        shares[dim].append(best)
    return {dim: max(LEAST, float(np.quantile(own, COVERED, method="higher"))) for dim, own in shares.items()}


def approximate_top_k(vectors: DataFrame, is_query, k: int, tables: int = TABLES, cell: int = CELL, region: int = REGION) -> DataFrame:
    """The k nearest found of each query by inner product: query_id, rank, vec_id, score.

    ``vectors`` has ``id`` and ``v`` as from ``usable`` (further columns are left out); ``is_query``
    is a condition on ``id``. Every vector is indexed in every table by its direction, in the band of
    its norm. A band of n vectors has tables of about n / ``cell`` cells, so hashes grow with log n,
    and queries probe a share of the cells that falls with their number and is fitted to the vectors (see ``fitted_shares``).
    Queries that find fewer than k probe again, more cells in each pass, until they have k or have
    probed all: only a query with fewer than k candidates gets fewer rows. Cells are searched whole:
    neighbouring ones are a region, and regions and their queries of any size are dealt into blocks.
    A query never meets rows of its own id; an id that is repeated with other vectors counts by its
    best score, and as a query by each vector together. Vectors of other lengths don't meet. Ties go
    to the lesser id; an empty table gives an empty result, and a query that has no candidates none.
    """
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    most = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))  # where squares leave the range of doubles
    size = F.when(squares.between(1e-280, 1e280), 0.5 * F.log2(squares)).otherwise(F.log2(most))
    band = F.floor(size * BANDS + 0.5).cast("int")
    asked = vectors.select("id", "v", F.size("v").alias("dim"), band.alias("band"), F.expr(is_query).alias("is_query") if isinstance(is_query, str) else is_query.alias("is_query"))
    bits, regions = defaultdict(dict), {}
    for r in asked.groupBy("dim", "band").count().collect():  # a row for each length and band of norms
        bits[r.dim][r.band] = max(0, int(np.ceil(np.log2(r["count"] / cell))))
        regions[r.dim, r.band] = min(bits[r.dim][r.band], max(0, int(np.ceil(np.log2(r["count"] / region)))))

    def units(batch: pa.RecordBatch):
        """The batch's rows by length of vector: (dim, their part of the batch, unit vectors)."""
        sizes = batch.column("dim").to_numpy()
        for dim in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == dim))
            yield dim, own, unit_vectors(_matrix(own.column("v"), own.num_rows))

    kind = vectors.schema["v"].dataType.simpleString()

    def indexed(batches):
        for batch in batches:
            for dim, own, unit in units(batch):
                bands = own.column("band").to_numpy()
                for b in np.unique(bands).tolist():
                    here = np.nonzero(bands == b)[0]
                    n, shift = bits[dim][b], bits[dim][b] - regions[dim, b]
                    code = np.stack([homes(unit[here], t, n) for t in range(tables)], axis=1)
                    flat = lambda x: pa.ListArray.from_arrays(np.arange(len(here) + 1, dtype=np.int32) * tables, pa.array(x.ravel()))
                    taken = own.take(pa.array(here))
                    yield pa.RecordBatch.from_arrays([taken.column(c) for c in ("id", "v", "dim", "band")] + [flat(code), flat(code >> shift)], names=["id", "v", "dim", "band", "cell", "region"])

    index = materialise(asked.mapInArrow(indexed, f"id long, v {kind}, dim int, band int, cell array<long>, region array<long>"), "polytopes")
    spot = ["dim", "band", "table", "region"]
    held = lambda *columns: index.select(*columns, "dim", "band", F.posexplode(F.arrays_zip("cell", "region")).alias("table", "z")).select(*columns, "dim", "band", "table", F.col("z.cell").alias("cell"), F.col("z.region").alias("region"))
    n_held = held().groupBy(*spot).agg(F.ceil(F.count("*") / region).cast("int").alias("vs"))

    def search(asking: DataFrame, share: dict[int, float]) -> DataFrame:
        """query_id, rank, vec_id, neg of queries that probe a share of the cells."""

        def seeking(batches):
            for batch in batches:
                for dim, own, unit in units(batch):
                    for b, n in bits[dim].items():
                        want, shift = wanted(share.get(dim, 1.0), 1 << n), n - regions[dim, b]
                        step = max(1, (1 << 22) // (want * 2 * width_of(dim)))
                        for t in range(tables):
                            for at in range(0, len(unit), step):
                                code = np.sort(probes(unit[at : at + step], t, n, want), axis=1)
                                rows, cells = np.repeat(np.arange(len(code)), code.shape[1]) + at, code.ravel()
                                place = rows * (1 << regions[dim, b]) + (cells >> shift)  # sorted: cells are, row by row
                                first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
                                taken = own.take(pa.array(rows[first]))
                                whole = lambda x: pa.array(np.full(len(first), x, np.int32))
                                lists = pa.ListArray.from_arrays(np.append(first, len(cells)).astype(np.int32), pa.array(cells))
                                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("v"), whole(dim), whole(b), whole(t), pa.array(cells[first] >> shift), lists], names=["id", "v", "dim", "band", "table", "region", "cells"])

        sought = materialise(asking.mapInArrow(seeking, f"id long, v {kind}, dim int, band int, table int, region long, cells array<long>"), "probes")
        n_sought = sought.groupBy(*spot).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs"))
        blocks = materialise(n_held.join(n_sought, spot), "regions")  # a row for each region that is sought and holds something
        parts = blocks.agg(F.sum("vs")).first()[0] or 1
        place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = sought.join(blocks, spot).withColumn("qb", place("qs", 2)).withColumn("vb", upto("vs"))
        right = held("id", "v").join(blocks.select(*[F.col(c).alias(c) for c in blocks.columns]), spot).withColumn("vb", place("vs", 1)).withColumn("qb", upto("qs"))
        keys = [*spot, "vb", "qb"]

        def searched(left: pa.Table, right: pa.Table) -> pa.Table:
            who, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if left.num_rows and right.num_rows:
                q, qid = _matrix(left.column("v"), left.num_rows), left.column("id").to_numpy()
                lists = left.column("cells").combine_chunks()
                asks = np.repeat(np.arange(left.num_rows), lists.value_lengths().to_numpy())
                v, vid = _matrix(right.column("v"), right.num_rows), right.column("id").to_numpy()
                who, ids, score = nearest(q, qid, asks, lists.flatten().to_numpy(), v, vid, right.column("cell").to_numpy(), k)
                who = qid[who]
            part = hash(tuple(int(right.column(c)[0].as_py()) for c in ("band", "table", "region", "vb"))) % parts if len(who) else 0
            return pa.table({"query_id": pa.array(who, pa.int64()), "neg": pa.array(-score, pa.float64()), "vec_id": pa.array(ids, pa.int64()), "part": pa.array(np.full(len(who), part), pa.int64())})

        left = left.select(*[F.col(c).alias(c) for c in ("id", "v", "cells", *keys)])
        right = right.select(*[F.col(c).alias(c) for c in ("id", "v", "cell", *keys)])
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(searched, "query_id long, neg double, vec_id long, part long")
        return materialise(best_of(found, k, parts), "found")

    asking = asked.where("is_query")
    ids = materialise(asking.select("id").distinct(), "queries")
    share = fitted_shares(index, asking, bits, k, tables)
    share = {dim: share.get(dim, 1.0) for dim in bits}
    found, n = search(asking, share), ids.count()
    while found.count() < n * k and any(wanted(share[dim], 1 << b) < 1 << b for dim, own in bits.items() for b in own.values()):
        share = {dim: WIDER * x for dim, x in share.items()}
        have = found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("query_id")
        short = materialise(ids.join(have, ids.id == have.query_id, "left_anti").select(F.col("id").alias("q")), "short")
        again = search(asking.join(short, asking.id == short.q, "left_semi"), share)
        found = found.join(short, found.query_id == short.q, "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", (-F.col("neg")).alias("score"))
