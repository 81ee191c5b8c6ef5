"""Near copies are those that share 0.8 of their sets of five-word shingles, however short they are and whatever they repeat."""

import numpy as np

from sparrowlens.llm import simhash


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def alike(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8


def test_no_near_copy_is_lost(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"v{i}" for i in rng.integers(0, 1 << 40, n)]
    pairs = []
    for length in (12, 24, 40, 60) * 60:  # short texts that share just 0.8
        a = fresh(length)
        b = a + fresh((length - 4) // 4)
        assert alike(a, b) and not alike(a, b + fresh(1))
        pairs.append((a, b))
    for times in (3, 40, 300):  # one line of a text, repeated in its copy
        for _ in range(6):
            a, line = fresh(200), fresh(12)
            pairs.append((a + line + line, a + line * times))
            assert alike(*pairs[-1])
    rows = [(2 * i + k, " ".join(p[k])) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(len(pairs))}


def test_marks_of_sets():
    rng = np.random.default_rng(4)
    for n in (1, 4, 40, 1000, simhash.BLOCK + 5):
        h = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
        own, more = (np.frombuffer(simhash.set_sketch(x), np.uint8) for x in (h[:n], h))
        assert len(own) == simhash.BINS and abs((own == more).mean() - n / len(h)) <= 0.2
        near = [(a ^ b).bit_count() for a, b in zip(simhash.set_prints(h[:n]), simhash.set_prints(h))]
        assert min(near) <= simhash.WIDE and (n > 1 or near == [0] * simhash.PRINTS)
    assert simhash.set_prints(np.zeros(0, np.uint64)) == [0] * simhash.PRINTS
