"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One round over links (a, b): neighbours of each node move to the least node of its neighbourhood.

    Only minima are aggregated and joined back; no neighbourhood is gathered in one task, so a hub
    with very many links costs as much as its links (an adaptive join splits it).
    """
    if small:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        near = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    moved = near.join(least, near.a == least.n).select("a", "b", "m")
    if small:
        moved = moved.select("b", "m").unionAll(moved.select(F.col("a").alias("b"), "m"))
    else:
        moved = moved.where("b > a").select("b", "m")
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Map every linked node to the least node it reaches: columns ``node``, ``component``.

    ``links`` has long columns ``a``, ``b``. Links of a node to itself and nulls are ignored; an
    empty table gives an empty map. Each double round is written to the shared folder, so rounds
    never recompute one another. Stops when a double round leaves the star links unchanged.
    """
    links = materialise(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        links = materialise(_star(_star(links, small=False), small=True), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(now):
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
