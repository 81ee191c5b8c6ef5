"""Rendezvous (highest random weight) hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_ROWS, gapless_rank, materialise, slices


def rendezvous(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) that wins for the keys: the one with the greatest -weight / ln(u).

    u in (0, 1) comes from XXH64 of the keys and the shard number, so a shard's score depends on the
    keys, its number and its own weight alone, whatever the other shards weigh: one more shard of any
    weight takes rows only into itself, and a changed weight moves rows only from or to that shard.
    A shard of weight 0 gets nothing. Ties go to the lesser number.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scored = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
            scored.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["shard"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", out: str = "shard", slot: str = "slot", grown: str | None = "grown_shard", slice_rows: int = SLICE_ROWS, write: bool = False) -> DataFrame:
    """Add each row's shard, its slot in it (gapless from 0) and the shard it would have with one more.

    Law ``key``: key and shard weights decide. Rows with one key share a shard, however many they
    are; null keys count as one key. Slots follow hashed slices of the rows, then keys; which of
    several rows with the same key comes first is open. Slices hash every column, so rows that
    repeat a key are dealt to many of them unless they agree in all columns. Every row gets a shard;
    further columns stay, and columns named like the outputs are replaced. The new shard's weight is
    the mean. An empty table gives an empty result. With ``write`` rows are written once with
    their shards, so that scores aren't worked out again to count and number them: for narrow rows.
    """
    docs = docs.drop(out, slot, *([grown] if grown else []))
    with_shard = docs.withColumn(out, rendezvous([F.col(key)], weights))
    if grown:
        with_shard = with_shard.withColumn(grown, rendezvous([F.col(key)], [*weights, sum(weights) / len(weights)]))
    if write:
        with_shard = materialise(with_shard, "sharded")
    hashable = [f.name for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    spread = F.xxhash64(F.lit("slot"), *[F.col(f"`{c}`") for c in hashable])
    ranked = gapless_rank(with_shard, [out], spread, [F.col(key)], slot, slices(with_shard.count() if write else docs.count(), slice_rows))
    return ranked.select(*[F.col(f"`{c}`") for c in docs.columns], out, slot, *([grown] if grown else []))
