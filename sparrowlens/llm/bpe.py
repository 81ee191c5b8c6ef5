"""Byte-level BPE encoding and decoding with the tiktoken library and local rank files."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest stretch of text, in characters, that is handed to the library at once where a safe boundary allows.
STRETCH = 1 << 16
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cut a text where white space follows other characters: no piece of PATTERN spans such a place.

    Every alternative of the pattern either takes white space alone or one leading space and then
    other characters, and none looks behind, so both sides split as they do in the whole text.
    Text without such a place stays whole.
    """
    if len(text) <= size:
        yield text
        return
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=4)
def from_ranks(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 of the bytes, then the rank), without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def from_json(path: str) -> tiktoken.Encoding:
    """The encoding of a byte-level BPE ``tokenizer.json``: its vocabulary as ranks, its added tokens as special ones.

    In such a vocabulary a merge's place is the id of what it makes, so ranks and merges say the
    same; the tests and the README compare it with the ``tokenizers`` library, which is four times
    slower on these texts. A file that asks for anything else than plain byte-level BPE raises.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = {
        "normalizer": spec.get("normalizer") is None,
        "pre_tokenizer": before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True),
        "model": model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if not all(plain.values()):
        raise ValueError(f"{path}: {', '.join(k for k, v in plain.items() if not v)} of another kind than byte-level BPE")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    byte = {c: b for b, c in char.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    if [ranks.get(bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))) for m in spec["model"]["merges"]] != sorted(i for b, i in ranks.items() if len(b) > 1):
        raise ValueError(f"{path}: the merges aren't in the order of the ids")
    return tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(text: str | None, encoding: tiktoken.Encoding) -> np.ndarray:
    """The ids of a whole text as little-endian uint32; special strings give their id if the encoding has them."""
    if not text:
        return np.zeros(0, "<u4")
    special = encoding.special_tokens_set
    between = regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text) if any(s in text for s in special) else [text]
    parts = []
    for i, part in enumerate(between):  # every second one is a special string
        parts += [np.array([encoding.encode_single_token(part)], "<u4")] if i % 2 else [encoding.encode_to_numpy(s, disallowed_special=()) for s in stretches(part)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


def encode(docs: DataFrame, rank_file: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of each whole text: a binary of little-endian unsigned 32-bit ids.

    ``rank_file`` is a path that every executor has. A null text is encoded as an empty one (no
    ids). Long texts are cut at safe boundaries first. Rows, ties and further columns stay as they
    are; a column that is named like ``out`` is replaced.
    """

    @F.pandas_udf("binary")
    def encoded(texts):
        encoding = from_ranks(rank_file)
        return texts.map(lambda t: ids_of(t, encoding).tobytes(), na_action=None)

    return docs.withColumn(out, encoded(F.col(text)))


def decode(docs: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for (null ids: as none). Bytes, as ids may end inside a character."""

    @F.pandas_udf("binary")
    def decoded(packed):
        encoding = from_ranks(rank_file)
        return packed.map(lambda b: encoding.decode_bytes(np.frombuffer(b or b"", "<u4").tolist()), na_action=None)

    return docs.withColumn(out, decoded(F.col(ids)))


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")
