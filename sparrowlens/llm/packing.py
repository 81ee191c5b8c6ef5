"""Sequence packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import from_json, ids_of
from .shared import SLICE_ROWS, gapless_rank, materialise, slices

Pattern = tuple[int, ...]
#: Places in patterns (36 bytes each) that every executor may hold.
BROADCAST_PLACES = 1 << 20


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how often each is used, by shortest-pack-first: lengths are placed longest first.

    Each piece goes to the shortest pack there is, that with the most room, if it still takes the
    piece, or else opens a pack. Packs of one pattern are one entry with a count, and all of them
    take a piece of the length in one step, so a step costs the same however many rows are counted.
    A length splits at most one entry and opens at most two, so there are at most 3 x ``size``
    patterns, each of at most ``size`` pieces.
    """
    open_packs: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # room left -> patterns and their counts
    most = 0  # no pack has more room
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left = counts[length]
        took: list[tuple[int, Pattern, int]] = []  # packs that took a piece come back when no shorter one is there
        while left:
            while most > 0 and not open_packs[most]:
                most -= 1
            back = max((room for room, _, _ in took), default=0)
            if back > most:
                for room, pattern, count in took:
                    open_packs[room].append((pattern, count))
                took, most = [], back
                continue
            if most < length:
                fit = size // length  # a new pack is the shortest until it's full
                for n, packs in ((fit, left // fit), (left % fit, 1)):
                    if n and packs:
                        took.append((size - n * length, (length,) * n, packs))
                left = 0
            else:
                pattern, count = open_packs[most].pop()
                if count > left:
                    open_packs[most].append((pattern, count - left))
                    count = left
                took.append((most - length, pattern + (length,), count))
                left -= count
        for room, pattern, count in took:
            open_packs[room].append((pattern, count))
            most = max(most, room)
    return [(pattern, count) for room in sorted(open_packs) for pattern, count in open_packs[room]]


def slots(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): which ranks of a length go where."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, rank[length], rank[length] + count - 1, sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, size: int, order: list[str], length: str = "length", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``size`` tokens; columns stay.

    The driver sees the histogram (at most ``size`` counts) and makes the patterns; pieces are
    ranked within their length in hashed slices, so that a length that very many pieces share is
    spread over tasks, and meet the patterns by rank. Pieces with a null or other length raise.
    ``pieces`` is read twice and should be a written table. ``order`` are columns that tell pieces
    apart; pieces that agree in all of them are interchangeable. No pieces give an empty result.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most size different lengths
    if wrong := [n for n in counts if n is None or not 1 <= n <= size]:
        raise ValueError(f"lengths must be 1 to {size}: {wrong[:5]}")
    places = slots(pack_histogram(counts, size))
    large = {n: slices(c, slice_rows) for n, c in counts.items() if c > slice_rows}
    of_length = F.create_map(*[F.lit(int(x)) for pair in large.items() for x in pair])
    ranked = gapless_rank(pieces, [length], F.xxhash64(*order), [F.col(c) for c in order], "_rank", F.coalesce(F.element_at(of_length, F.col(length).cast("int")), F.lit(1)) if large else 1)
    table = spark.createDataFrame(places, "_length int, _from long, _to long, _sequence long, _offset long")
    # bounded by the sequence size alone, but by its square at worst: past the limit an ordinary join
    joined = ranked.join(F.broadcast(table) if len(places) <= BROADCAST_PLACES else table, (F.col(length) == F.col("_length")) & F.col("_rank").between(F.col("_from"), F.col("_to")))
    return joined.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from")).withColumn("offset", F.col("_offset")).drop("_rank", "_length", "_from", "_to", "_sequence", "_offset")


def pieces(docs: DataFrame, tokenizer: str, size: int, end: int, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut each document's ids, with ``end`` after them, into pieces of ``size`` and a rest.

    One row per piece: the key, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens``, and the
    ids themselves (little-endian uint32) if ``with_ids``. A null text is an empty one, which
    still has its end token.
    """

    def cut(batches):
        encoding = from_json(tokenizer)
        for batch in batches:
            rows = []
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, t in zip(keys, texts):
                ids = np.append(ids_of(t.as_py(), encoding), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size].tobytes()
                    rows.append((k, at, len(part) // 4, zlib.crc32(part), len(ids)) + ((part,) if with_ids else ()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset each has; ids are computed once and written.

    Null and empty texts are the end id alone, a piece of one. Every row of ``docs`` is packed, also
    those that repeat an id or have none (null ids stay null; pieces of rows with one id are told
    apart by where they are, not by whose they are). Texts are read whole, a long one gives several
    pieces; further columns, also ones named like the results, are left out. An empty table gives an
    empty result.
    """
    table = materialise(pieces(docs, tokenizer, size, end, with_ids), "pieces")
    return pack(table, size, ["doc_id", "start", "ids_crc32"])
