"""Token counts from distinct pre-tokens: pieces are counted once per pre-token and joined to frequencies."""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import stretches
from .shared import materialise

#: Documents and characters after which a task closes a block of frequencies.
BLOCK_DOCS, BLOCK_CHARS = 20_000, 32_000_000
#: Bytes of counts on their way back to blocks that a task holds before it hands them on.
HELD = 64 << 20
_PATTERN = regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def specials(path: str) -> tuple[str, ...]:
    return tuple(sorted((t.content for t in library(path).get_added_tokens_decoder().values()), key=len, reverse=True))


@lru_cache(maxsize=2)
def single_pieces(path: str) -> frozenset[str]:
    """Pre-tokens that the library gives one id: at most as many as the vocabulary has entries."""
    tokenizer = library(path)
    words = [w for w in (tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size())) if "�" not in w and len(_PATTERN.findall(w)) == 1]
    return frozenset(w for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False)) if len(e.ids) == 1)


def pretokens(text: str, special: tuple[str, ...]) -> Counter:
    """The pre-tokens of a whole text and how often each occurs; a special string is one of its own."""
    found: Counter = Counter()
    if any(s in text for s in special):
        parts = regex.split("(" + "|".join(map(regex.escape, special)) + ")", text)
    else:
        parts = [text]
    for i, part in enumerate(parts):
        if i % 2:
            found[part] += 1
        else:
            for stretch in stretches(part):
                found.update(_PATTERN.findall(stretch))
    return found


def packed(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as steps of 16 bits and their counts of 8 bits; what is larger takes several entries."""
    step = np.diff(at, prepend=0)
    if not len(at) or (step.max() < 1 << 16 and counts.max() < 256):
        return step.astype("<u2"), counts.astype("u1")
    skip, turns = step // 65535, np.maximum(1, -(-counts // 255))
    size = skip + turns
    of = np.repeat(np.arange(len(at)), size)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    skipped, last = place < skip[of], place == size[of] - 1
    steps = np.where(skipped, 65535, np.where(place == skip[of], step[of] - 65535 * skip[of], 0))
    each = np.where(skipped, 0, np.where(last, counts[of] - 255 * (turns[of] - 1), 255))
    return steps.astype("<u2"), each.astype("u1")


def blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pre-token frequencies of blocks of documents, one row per block.

    ``docs`` has ``key`` and ``text`` and is a stored table: a block is named by its place in it.
    Pre-tokens of one piece are counted at once (``base``); of the others a row holds the distinct
    ones and, document by document, ``entries`` packed numbers of them with counts.
    """

    def gathered(batches):
        single, special = single_pieces(tokenizer), specials(tokenizer)
        name, state = TaskContext.get().partitionId() << 24, None

        def close(state):
            keys, sizes, base, entries, number, steps, counts = state
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([base], pa.list_(pa.int64())), pa.array([entries], pa.list_(pa.int32())), pa.array([list(number)], pa.list_(pa.string())), pa.array([b"".join(steps)]), pa.array([b"".join(counts)])],
                names=["block", "keys", "n_bytes", "base", "entries", "pretokens", "steps", "counts"],
            )

        chars = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if state is None:
                    state, chars = ([], [], [], [], {}, [], []), 0
                keys, sizes, base, entries, number, steps, counts = state
                found = pretokens(text, special)
                rest = [t for t in found if t not in single]
                base.append(sum(found.values()) - sum(map(found.__getitem__, rest)))
                at = np.array([number.setdefault(t, len(number)) for t in rest], np.int64)
                order = np.argsort(at)
                step, count = packed(at[order], np.array([found[t] for t in rest], np.int64)[order])
                steps.append(step.tobytes())
                counts.append(count.tobytes())
                keys.append(key)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                entries.append(len(step))
                chars += len(text)
                if len(keys) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    yield close(state)
                    name, state = name + 1, None
        if state:
            yield close(state)

    return docs.mapInArrow(gathered, "block long, keys array<long>, n_bytes array<long>, base array<long>, entries array<int>, pretokens array<string>, steps binary, counts binary")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Tokens are those of the ``tokenizers`` library for the file, without begin, end or added
    special tokens; special strings in a text are its special tokens, as by default. Null texts
    count as empty. Every row of ``docs`` gives a row, also if keys are null or repeated; further
    columns are left out. No token ids are made for texts: a pre-token's rows, at most one per
    block for even the most frequent, meet in one sorted partition, where its pieces are counted
    once and joined to them; counts then return to their blocks. Texts are read whole, long ones in
    stretches; an empty table gives an empty result.
    """
    table = materialise(blocks(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), tokenizer), "frequencies", compression="zstd")
    used = table.select("block", F.posexplode("pretokens").alias("at", "pretoken"))

    def pieces(batches):
        """Runs of one pre-token are counted once; what a partition knows of a block is a packed row for each HELD bytes."""
        lib, last, known, held = library(tokenizer), (None, 0), {}, 0

        def handed():
            names = list(known)
            for a in range(0, len(names), 256):
                rows = [(n, b"".join(x for x, _ in known[n]), b"".join(x for _, x in known[n])) for n in names[a : a + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["block", "at", "pieces"])

        for batch in batches:
            words = batch.column(2)
            runs = words.dictionary_encode()
            distinct = runs.dictionary.to_pylist()
            fresh = [w for w in distinct if w != last[0]]
            counted = dict(zip(fresh, (len(e.ids) for e in lib.encode_batch_fast(fresh, add_special_tokens=False)))) | {last[0]: last[1]}
            of = np.array([counted[w] for w in distinct], "<i4")[runs.indices.to_numpy()]
            last = (words[-1].as_py(), int(of[-1]))
            block, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(block[order]))[0] + 1):
                known.setdefault(int(block[part[0]]), []).append((at[part].astype("<i4").tobytes(), of[part].tobytes()))
            held += 8 * len(order)
            if held >= HELD:
                yield from handed()
                known, held = {}, 0
        yield from handed()

    sorted_used = used.where("length(pretoken) > 0").repartition("pretoken").sortWithinPartitions("pretoken")
    joined = sorted_used.mapInArrow(pieces, "block long, at binary, pieces binary")

    def summed(numbers: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        at = np.frombuffer(b"".join(numbers.column("at").to_pylist()) if numbers.num_rows else b"", "<i4")
        of = np.frombuffer(b"".join(numbers.column("pieces").to_pylist()) if numbers.num_rows else b"", "<i4")
        each = np.zeros(len(at) + 1, np.int64)
        each[at] = of
        for row in block.to_pylist():
            entries = np.array(row["entries"], np.int64)
            doc = np.repeat(np.arange(len(entries)), entries)
            run = np.cumsum(np.frombuffer(row["steps"], "<u2").astype(np.int64))
            before = np.concatenate([[0], run])[np.cumsum(entries) - entries]
            tokens = each[run - before[doc]] * np.frombuffer(row["counts"], "u1")
            total = np.array(row["base"], np.int64) + np.bincount(doc, weights=tokens, minlength=len(entries)).astype(np.int64)
            out.append(pa.table({key: pa.array(row["keys"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": total}))
        return pa.concat_tables(out) if out else pa.table({key: pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64())})

    table = table.drop("pretokens")
    table = table.select(*[F.col(c).alias(c) for c in table.columns])  # columns of its own beside those of ``joined``
    result = joined.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(summed, f"`{key}` long, n_bytes long, n_tokens long")
    return result.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
