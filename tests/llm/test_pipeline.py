"""run() on a small corpus against a plain version of its stages, and each stage on odd rows."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparrowlens.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_near_copies(texts):
    """The ids that stay: the least of each group that pairs of 0.8 or more common five-word shingles join."""
    sets = {}
    for d, t in texts.items():
        words = t.lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    group = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return {min(d for d in group if group[d] == g) for g in set(group.values())}


def test_run(spark, tmp_path):
    rng = np.random.default_rng(11)
    # words of their own shapes, many of them, so that texts differ
    vocabulary = {"aa": [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "sa", "tu") for b in ("na", "ta", "ko", "ri", "mu") for c in ("la", "no", "pi", "")], "bb": [f"{a}{b}{c}" for a in ("gru", "schl", "dwu", "kle") for b in ("nf", "ek", "rp", "zch", "st") for c in ("er", "ung", "en", "")]}
    words = lambda lang, n=120: list(rng.choice(vocabulary[lang], n))
    texts = {i: words("aa" if i % 3 else "bb") for i in range(60)}
    rows = [(i, " ".join(t), "aa" if i % 3 else "bb", f"s{i % 4}", 0) for i, t in texts.items()]
    copied = {100: texts[4], 101: texts[5] + ["mail", "bob@x.example", "soon"], 102: texts[7] + words("aa", 14), 103: texts[8] + words("aa", 55)}
    edited = texts[10].copy()
    edited[30], edited[90] = "bana", "lota"
    copied[104] = edited
    rows += [(d, " ".join(t), "aa", "s1", 0) for d, t in copied.items()]
    rows += [(110, "qxjw vkzq " * 50, None, "s1", 0), (111, " ".join(words("aa")) + " mail amy@x.example or +1 415 555 2671 now", "aa", None, 0), (112, " ".join(words("bb", 3000)), "bb", "s2", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    plain = {r[0]: r[1] for r in rows if r[0] != 110}  # the only document in no language
    kept = plain_near_copies(plain)
    assert {100, 101, 102, 104}.isdisjoint(kept) and 103 in kept
    assert {r.doc_id for r in out} == kept
    library = Tokenizer.from_file(TOKENIZER)
    hidden = lambda t: re.sub(r"[a-z]+@x\.example", "[EMAIL]", re.sub(r"\+1 415 555 2671", "[PHONE]", t))
    for d in kept:
        ids = library.encode(hidden(plain[d]), add_special_tokens=False).ids + [1]
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out if r.doc_id == d)
        assert pieces == [(at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 2048) for part in [ids[at : at + 2048]]]
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(places) == list(range(len(places)))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "simhash", "pii", "packing"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_rows(spark, stage):
    name, function = corpus_pipeline.STAGES[stage]
    good = "this is some english text of many words that goes on " * 4
    rows = [(1, good, "en", "s", 1, "x", 2.0), (1, good, "en", "s", 1, "x", 2.0), (None, good + "more", "en", None, None, None, None), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, "y", 1.0), (4, good + "long words " * 20_000, "en", "s", 1, "z", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", spans string, fp double").repartition(2)
    out = function(spark, docs, "")
    got = out.collect()
    if name == "packing":
        assert len({(r.doc_id, r.start) for r in got}) == len(got) - 1 and {r.doc_id for r in got} == {1, 2, 3, 4, None}
    else:
        assert out.columns == docs.columns and {r.doc_id for r in got} >= {1, None, 4} and sum(r.doc_id == 1 for r in got) == 2
    assert function(spark, docs.where("false"), "").collect() == []
