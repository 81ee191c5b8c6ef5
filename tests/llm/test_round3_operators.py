"""Runs, odd sketches and filtering Lloyd against plain versions, with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import hashlib
import json
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowlens.llm import ann, bpe, langid, lloyd, minhash, packing, pii, queries, runs, topk


def plain_words(text):
    out, word = [], b""
    for c in (text or "").encode() + b" ":
        if c in b" \t\n\v\f\r":
            if word:
                out.append(word)
            word = b""
        else:
            word += bytes([c])
    return out


# ---- runs


def plain_runs(w, least_length=6, least_exponent=4):
    out = set()
    for p in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i + p - start
            if length >= max(least_length, least_exponent * p) and not any(all(w[k] == w[k + q] for k in range(start, start + length - q)) for q in range(1, p)):
                out.add((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_words(least):
    rng = random.Random(sum(least))
    for _ in range(1500):
        k, n, w = rng.choice([1, 2, 3, 5]), rng.randrange(0, 90), []
        while len(w) < n:
            root = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
            w += (root * rng.randrange(1, 7))[: rng.randrange(1, 70)]
        assert runs.find_runs(w, *least) == plain_runs(w, *least), w


def test_long_repeats_stay_cheap():
    for w, want in ((["a"] * 40_000, [(0, 40_000, 1)]), (["a", "b"] * 20_000 + ["a"], [(0, 40_001, 2)]), ([str(i) for i in range(5000)] * 9, [(0, 45_000, 5000)])):
        assert runs.find_runs(w) == want


def plain_row(doc_id, text):
    w = plain_words(text)
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    best = (None,) * 4
    if found:
        s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_of_runs(spark, tmp_path):
    rng = random.Random(11)
    texts = [None, "", " \n\t ", "one", "a a a a a a", "x a b a b a b a b y", "A a A a A a A a", "ba ba " * 7, "é é é é é é é", "q " * 3000, "           "]
    for _ in range(150):
        texts.append(" ".join(rng.choice(["a", "b", "c", "dd", "é"]) + ("" if rng.random() < 0.5 else "\n") for _ in range(rng.randrange(0, 120))))
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(5, "x a b a b a b a b y", "clash", 2), (None, "a a a a a a", "clash", 3), (None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, start long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(r[0], r[1]) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5  # some are planted


def test_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", "x")], "doc_id long, text string, collapsed string")
    (r,) = runs.periodic_runs(docs).collect()
    assert r.collapsed == "a b" and [tuple(x) for x in r.runs] == [(0, 6, 1)]
    assert runs.periodic_runs(docs.where("false")).collect() == []


# ---- odd sketches


def plain_set(text, k=5):
    w = plain_words(text.lower() if text and text.isascii() else text)
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({b" ".join(w)} if w else set())


def plain_components(rows, least=85):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for (d, _), s, g in zip(rows, sets, group):
        ids = [e for (e, _), h in zip(rows, group) if h == g and e is not None]
        name = min(ids) if ids else None
        out.append((d, len(s), name, d is not None and d == name))
    return out


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus(rng):
    texts = [None, "", "  ", "one", "ONE", "one two three", "a b c d e", "A b\tc  d E", "a b c d e f", "word " * 30_000]
    for _ in range(12):  # chains of copies, some of them only linked through others
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 20, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.5:
                base = edited(rng, base, rng.randrange(0, 3))
                texts.append(" ".join(base))
            else:
                texts.append(" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 40)))))
    base = [f"t{i}" for i in range(120)]  # a large group around one text
    texts += [" ".join(edited(rng, base, 1)) for _ in range(40)]
    return texts


@pytest.mark.parametrize("bound,sketches", [(minhash.SHINGLES, minhash.SKETCHES), (900, 4)])
def test_near_duplicates(spark, bound, sketches):
    rng = random.Random(5)
    texts = corpus(rng)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(3, "one"), (None, "ONE"), (None, "alone without an id"), (None, None), (10_000, texts[12])]
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, n_shingles int, node string").repartition(3)
    got = minhash.near_duplicates(docs, bound=bound, sketches=sketches)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_components(rows), key=str)
    assert minhash.near_duplicates(docs.where("false")).collect() == []


def test_no_link_is_lost_at_the_threshold(spark):
    rng = random.Random(6)
    rows = []
    for g in range(120):
        n = rng.choice([17, 40, 100, 300])
        w = [f"g{g}x{i}" for i in range(n + 4)]  # n shingles; a longer ending has a similarity of n / (n + extra)
        extra = int(n * 15 / 85) + (g % 2)
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w + [f"y{g}x{i}" for i in range(extra)]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: c for d, _, c, _ in plain_components(rows)}
    assert got == want and len(set(want.values())) == 180


def test_parts_that_only_meet_across_blocks(spark):
    rng = np.random.default_rng(9)
    odd = rng.integers(0, 1 << 62, (60, 4), dtype=np.uint64)
    odd[30:] = odd[:30] ^ np.uint64(1)  # each has one near partner
    rows = [(1, int(i), int(i), odd[i].view(np.int64).tolist()) for i in range(60)]
    members = spark.createDataFrame(rows, "group long, node long, label long, odd array<long>")
    for bound in (8, 1000):
        pairs = {(r.a, r.b) for r in minhash.sketch_links(members, 0.99, bound).collect()}
        assert pairs == {(i + 30, i) for i in range(30)}
    major = members.withColumn("label", F.when(F.col("node") < 45, 0).otherwise(F.col("node")))  # most are joined already
    assert {(r.a, r.b) for r in minhash.sketch_links(major, 0.99, 8).collect()} == {(i + 30, i) for i in range(15, 30)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for j in (0.7, 0.85, 0.95):
        found = []
        for _ in range(60):
            u = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            both = round(400 * j)
            a, b = (minhash.samples(x) for x in (u[: both + (400 - both) // 2], np.concatenate([u[:both], u[both + (400 - both) // 2 :]])))
            found.append(minhash.estimate(int(np.bitwise_count(minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).sum())))
        assert abs(np.mean(found) - j) < 0.015 and np.std(found) < 0.045


# ---- filtering Lloyd


def plain_lloyd(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, k) for _, v, _ in first] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, z)), e) for e, z in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, k), books[k])[1], []).append(cut(v, k))
            books[k] = [[sum(c) // len(c) for c in zip(*own[e])] if e in own else z for e, z in enumerate(books[k])]
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(cut(v, k), books[k]) for k in range(parts)]
        error = sum(f for f, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, [e for _, e in found], error, label))
    text = ",".join(str(c) for book in books for z in book for c in z)
    return [(i, code, error, sums[label], text) for i, code, error, label in out]


@pytest.mark.parametrize("n,entries,levels,block", [(700, 16, 3, 150), (90, 256, 1000, 1 << 13), (500, 8, 2, 64)])
def test_codes_of_vectors(spark, monkeypatch, n, entries, levels, block):
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", block)
    rng = np.random.default_rng(n)
    rows = [(int(i), (rng.integers(-levels, levels + 1, 8) / 16).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(n)]  # coarse values: many ties
    rows += [(5, rows[0][1], None), (5, rows[0][1], None), (None, rows[1][1], 1), (n + 1, None, 1), (n + 2, [None] * 8, 1), (n + 3, [float("nan")] * 8, 1), (n + 4, [float("inf")] + [0.0] * 7, None), (n + 5, [], 2)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    got = lloyd.compress(docs, parts=4, entries=entries, rounds=3, scale=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_lloyd(rows, 4, entries, 3, 16), key=str)


def test_whole_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(1)
    centres = rng.integers(-20_000, 20_000, (16, 4))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-30, 31, (4000, 4))).astype(np.int64)
    tree = lloyd.Tree(points[lloyd.kd_order(points)])
    found = list(tree.filtered(centres))
    assert sum(b - a for a, b, _, _ in found) == 4000
    assert sum(b - a for a, b, _, left in found if len(left) == 1) > 3000  # by cached sums
    total, count = tree.sums(centres)
    near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert count.tolist() == np.bincount(near, minlength=16).tolist() and (total.sum(axis=0) == points.sum(axis=0)).all()
    again = lloyd.Tree.unpacked(tree.points, tree.packed())
    assert all((x == y).all() for a, b in zip(again.levels, tree.levels) for x, y in zip(a, b))


def test_large_components_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [30_000.0, -3.0], 1), (2, [-30_000.0, 2.0], 1), (3, [1e30, 0.0], 1), (4, [0.0], 1)]  # too large; another length
    got = lloyd.compress(spark.createDataFrame(rows, schema), parts=2, entries=1, rounds=1).collect()
    assert [(r.vec_id, r.code, r.error) for r in sorted(got)] == [(i, c, e) for i, c, e, _, _ in plain_lloyd(rows[:2], 2, 1, 1, 1024)]
    assert lloyd.compress(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError):
        lloyd.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], schema), parts=2)


def test_hex_code(spark):
    assert spark.range(1).select(lloyd.hex_code(F.array(F.lit(0), F.lit(255), F.lit(16)))).first()[0] == "00ff10"


# ---- nearest neighbours of other dimensions, and queries on their own


def recall_of(spark, x, k=20):
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.approximate_top_k(ann.usable(table), "id % 20 = 0", k).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    q = np.arange(0, len(x), 20)
    s = x[q].astype(float) @ x.astype(float).T
    s[np.arange(len(q)), q] = -np.inf
    true = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return np.mean([len(found[i] & set(t)) / k for i, t in zip(q.tolist(), true.tolist())]), {len(found[i]) for i in q.tolist()}


@pytest.mark.parametrize("dim,kind", [(8, "random"), (256, "random"), (768, "random"), (128, "clusters"), (64, "lone")])
def test_recall_and_whole_answers(spark, dim, kind):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(6000, dim))
    if kind == "clusters":
        x = 0.4 * x + 6 * rng.normal(size=(30, dim))[rng.integers(0, 30, 6000)]
    if kind == "lone":  # all around one direction but a query at the opposite
        x = 0.05 * x + np.ones(dim)
        x[20] = -x[20]
    share, sizes = recall_of(spark, x)
    assert share >= 0.9 and sizes == {20}


def test_few_candidates(spark):
    x = spark.createDataFrame([(i, [float(i % 3) - 1.0, 1.0]) for i in range(12)] + [(40, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.approximate_top_k(ann.usable(x), "id % 20 = 0", 20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(v) for q, v in got.items()} == {0: 11}  # query 40 has no candidates of its length


def test_words_beside_a_span_are_whole():
    words = lambda t: pii.Words(t)
    far = "please contactmenowplease" + " " * 500 + "+1 415 555 2671" + "." * 300 + "thank you"
    at = far.index("+")
    assert pii.contexts(words(far), at, at + 15) == ["<please contactmenowplease", ">thank you"]
    assert pii.contexts(words("Call x1.2.3.4y now ok"), 6, 13) == ["<call x", ">y now"]  # words that touch the span give their part
    assert pii.contexts(words("one 12345678"), 4, 12) == [] and pii.contexts(words(""), 0, 0) == []
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice(["ab", "Cé", " ", ". ", "1"]) for _ in range(12))
        s = rng.randrange(0, len(t))
        e = rng.randrange(s, len(t)) + 1
        before, after = pii._WORD.findall(t[:s])[-2:], pii._WORD.findall(t[e:])[:2]
        want = (["<" + " ".join(before).lower()] if len(before) == 2 else []) + ([">" + " ".join(after).lower()] if len(after) == 2 else [])
        assert pii.contexts(words(t), s, e) == want


def test_many_languages_in_one_plan(spark):
    rng = random.Random(7)
    names = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"][:250]
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = {n: ["".join(random.Random(f"{n}{i}").choice(letters) for _ in range(6)) for i in range(12)] for n in names}
    text = lambda n: " ".join(rng.choice(word[n]) for _ in range(60))
    model = langid.fit(spark.createDataFrame([(text(n), n) for n in names for _ in range(4)], "text string, lang string"))
    truth = [rng.choice(names) for _ in range(200)]
    pages = [(i, f"https://h{i % 40}.example/x", f"<html lang='{n}'><p>{text(n)}</p></html>") for i, n in enumerate(truth)]
    began = time.perf_counter()
    got = {r.page_id: r for r in langid.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert time.perf_counter() - began < 30
    assert sum(got[i].language == n for i, n in enumerate(truth)) > 190 and all(0 < r.confidence <= 1 for r in got.values())


@pytest.mark.parametrize("part,value", [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True}), ("added_tokens", [{"id": 50256, "content": "<|endoftext|>", "lstrip": True}]), ("model", {"type": "Unigram"})])
def test_other_tokenizers_are_refused(tmp_path, part, value):
    with open(queries.TOKENIZER, encoding="utf-8") as file:
        spec = json.load(file)
    spec[part] = spec["model"] | value if part == "model" else value
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match=part):
        bpe.from_json(str(path))
    assert bpe.from_json(queries.TOKENIZER).n_vocab == 50257


def test_ids_of_repeated_and_missing_documents(spark):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "one two"), (None, None), (2, "")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, length int, sequence_id string")
    encode = bpe.from_json(queries.TOKENIZER).encode_ordinary
    got = packing.pack_documents(docs, queries.TOKENIZER, size=3, end=1).collect()
    want = {}
    for d, t in rows:
        n = len(encode(t or "")) + 1
        want.setdefault(d, []).append(n)
    total = {}
    for r in got:
        total.setdefault(r.doc_id, [0, []])[0] += r.length
        total[r.doc_id][1].append(r.doc_tokens)
    assert {d: t[0] for d, t in total.items()} == {d: sum(n) for d, n in want.items()}
    assert all(set(t[1]) == set(want[d]) for d, t in total.items())
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert (s2 == s and o2 == o + n) or (s2 == s + 1 and o2 == 0)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in got if r.doc_id == 2}
    assert crc == {(2, 0): zlib.crc32(np.array([1], "<u4").tobytes())}


def test_top_k_with_clashing_columns_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-9, 10, (60, 4))
    rows = [(int(i % 50), x.tolist(), "clash") for i, x in enumerate(v)]
    table = spark.createDataFrame([(i, [float(c) for c in x], s, 1) for i, x, s in rows], "vec_id long, embedding array<double>, score string, rank int")
    vectors = topk.quantised(table, 1)
    got = {}
    for r in topk.exact_top_k(vectors, vectors.where("id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 50, 10):
        own = min(x for i, x, _ in rows if i == q)  # a repeated query counts once, by its least vector
        best = sorted((-int(np.dot(own, x)), i) for i, x, _ in rows if i != q)[:5]  # repeated candidates once each
        want = [(n, i, s) for n, (s, i) in enumerate(best, 1)]
        assert sorted(got[q]) == [(n, i, -s) for n, i, s in want]


def test_bounds_are_held_in_tiles(spark, monkeypatch):
    for rows, columns in ((10, 3), (7, 1 << 30), (0, 5), (1000, 61_000)):
        found = topk.tiles(rows, columns)
        assert [r for a, b in found for r in range(a, b)] == list(range(rows)) and all((b - a) * columns <= topk.TILE or b - a == 1 for a, b in found)
    rng = np.random.default_rng(8)
    v = rng.integers(-50, 51, (900, 6))
    table = spark.createDataFrame([(i, [int(c) for c in x]) for i, x in enumerate(v)], "id long, v array<long>")
    monkeypatch.setattr(topk, "TILE", 64)
    got = sorted(map(tuple, topk.exact_top_k(table, table.where("id % 9 = 0"), 4, shard=20, block=16).collect()))
    want = []
    for q in range(0, 900, 9):
        best = sorted((-int(v[q] @ x), i) for i, x in enumerate(v) if i != q)[:4]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
