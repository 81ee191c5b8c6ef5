"""Each pipeline operator against a plain version, with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import base64
import gzip
import hashlib
import math
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparrowlens.llm import ann, bpe, components, langid, packing, pii, queries, sharding, simhash, tokencount, topk, warc
from sparrowlens.llm.queries import MULTI_RANKS, TOKENIZER

LONG = ("word number 7 and " * 30_000) + "x" * 5_000
TEXTS = [None, "", " \n\t", "one", "one two", "A b C d", "a B c D", LONG, LONG, "mail bob@ex.example now", "x <|endoftext|> y  <|endoftext|>", "日本語 🙂 ünï", "  lead   spaces\n\n\nlines", "it's we'll 1234567890"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, i, "clash") for i, t in enumerate(TEXTS)] + [(3, "one", 3, "clash"), (None, "A b C d", 0, "clash")]
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, "doc_id long, text string, fp long, ids string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(r):
    return (r[0] is None, *map(str, r))


def plain_fingerprint(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    lines = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in lines]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h) > 0)


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs, leaf=2).select("doc_id", simhash.hex64(F.col("fp")).alias("h"), "component_id").collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    assert sorted(((r.doc_id, r.h) for r in got), key=key) == sorted(((d, f"{f:016x}") for (d, _), f in zip(rows, prints)), key=key)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(d for (d, _), h in zip(rows, group) if h == g and d is not None) for g in group}
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(((d, least[g]) for (d, _), g in zip(rows, group)), key=key)
    assert simhash.near_duplicates(empty).collect() == []


def test_rows_without_a_key_link(spark):
    rng = np.random.default_rng(12)
    while True:  # A-B and B-C are near, A-C isn't
        a = [f"w{i}" for i in rng.integers(0, 900, 150)]
        b, c = a.copy(), None
        for p in rng.choice(150, 2, replace=False):
            b[p] = "edited"
        c = b.copy()
        for p in rng.choice(150, 2, replace=False):
            c[p] = "changed"
        x, y, z = (simhash.fingerprint(" ".join(t)) for t in (a, b, c))
        if (x ^ y).bit_count() <= 3 and (y ^ z).bit_count() <= 3 < (x ^ z).bit_count():
            break
    a, b, c = (" ".join(t) for t in (a, b, c))
    schema = "doc_id long, text string, fp string, component_id string"
    got = simhash.near_duplicates(spark.createDataFrame([(1, a, "x", "x"), (None, b, "x", "x"), (3, c, "x", "x"), (9, "apart", "x", "x"), (None, "alone here too", "x", "x")], schema)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == [(1, 1), (3, 1), (9, 9), (None, 1), (None, None)]


@pytest.mark.parametrize("radius", [3, 10])
def test_vantage_tree_loses_no_link(radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    near = [base.copy() for _ in range(6)]
    for k, x in enumerate(near):
        for _ in range(2 * k + 1):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    points = np.unique(np.concatenate([base, *near]))
    ids = rng.permutation(len(points))

    def merged(links):
        parent = {int(i): int(i) for i in ids}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(int(i)) for i in ids]

    tree = simhash.plan_tree(points[::3], 4, radius)
    found = [(int(a), int(b)) for _, idx, home in simhash.route(points, tree, radius) for a, b in zip(*simhash.local_links(points[idx], ids[idx], home, radius))]
    every = [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= radius)) if i < j]
    assert merged(found) == merged(every)


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(30):
        text = list(rng.choice(words, 400))
        rows.append((10 * g, " ".join(text)))
        changed = text.copy()
        for p in (37, 111, 250):  # 15 of 396 shingles
            changed[p] = "edited"
        rows.append((10 * g + 1, " ".join(changed)))
        half = text[:200] + list(rng.choice(words, 200))
        rows.append((10 * g + 2, " ".join(half)))
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {10 * g for g in range(30)} <= kept and {10 * g + 2 for g in range(30)} <= kept
    assert sum(10 * g + 1 in kept for g in range(30)) <= 1


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {}
    for a, b in links:
        if a is not None:
            group.setdefault(a, a), group.setdefault(b, b)
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    singles = {k for k in group if sum(v == group[k] for v in group.values()) == 1}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in group.items() if k != v and k not in singles}


def plain_spans(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    tricky = ["a@b.c@d.e", "a@b c@@d.ef", "x.y+z%@q-r.s.t-u..v", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "0001.2.3.4", "4111 1111 1111 1111 2", "4111-1111-1111-1111", "+1 (415) 555-2671, +12", "+1+1 415 555 2671+49 30 123456", "é@ü.de a@ü.de", "4785380592391139$$$"]
    rng = np.random.default_rng(3)
    tricky += ["".join(rng.choice(list("a1.@+- ()9Z%_é"), 60)) for _ in range(3000)]
    for t in tricky:
        assert pii.base_spans(t) == plain_spans(t), t
    zeros = "0" * 5000  # more digits than int() takes
    assert pii.base_spans(f"{zeros}1.2.3.{zeros}") == [("ip", 0, 10006)]


UGLY = ["x", "7", "a@", "[at]", "x[at]", "1.", "1[.]", "1 ", "1-", "+1", "(", "<", "<!--", "<script>", "<html ", "</script ", "&#1", "[at]a-", "@a."]


@pytest.mark.parametrize("unit", UGLY)
def test_scanners_are_linear(unit):
    text = unit * (10**6 // len(unit))
    began = time.perf_counter()
    base = pii.base_spans(text)
    list(pii.loose_spans(text, base))
    middle = time.perf_counter()
    langid.visible_text(text)
    assert middle - began < 3 and time.perf_counter() - middle < 3  # a second or less on a free machine


def test_loose_shapes():
    found = lambda t: [t[s:e] for s, e in pii.loose_spans(t, pii.base_spans(t))]
    assert found("bob [at] ex [dot] org and amy(AT)x.org, tel (415) 555-2671 or 10[.]0[.]0[.]1") == ["bob [at] ex [dot] org", "amy(AT)x.org", "(415) 555-2671", "10[.]0[.]0[.]1"]
    assert found("v1.2345678 +1 415 555 2671 a1234567 1234567b 123 [at] no") == []
    rng = np.random.default_rng(4)
    for _ in range(300):
        t = "".join(rng.choice(["a@b.de", "x[at]y.z", "+1 415 555 2671", "1 2 3 4 5 6 7 8", " ", "(", "9[.]9[.]9[.]9", ","], 12))
        base, loose = pii.base_spans(t), list(pii.loose_spans(t, pii.base_spans(t)))
        assert all(e <= b or f <= s for _, b, f in base for s, e in loose) and all(a[1] <= b[0] for a, b in zip(loose, loose[1:]))


def plain_graph(mentions):
    """``pii.score_graph`` by plain Python; mentions are (row, kinds, seed, value, pattern)."""
    edges = {}
    for row, kinds, seed, value, pattern in mentions:
        for k in kinds:
            e = edges.setdefault((k, pattern, value), [False, row, row])
            e[0], e[1], e[2] = e[0] or seed, min(e[1], row), max(e[2], row)
    known = {}
    while True:
        score = lambda k, v, e: 1.0 if e[0] else known.get((k, v), 0.0)
        sums = {}
        for (k, p, v), e in edges.items():
            s = score(k, v, e)
            entry = sums.setdefault((k, p), [0.0, 0.0, 0, set()])
            entry[0], entry[1], entry[2] = entry[0] + s, entry[1] + 1 - s, entry[2] + (s > 0)
            entry[3] |= {e[1], e[2]} if s > 0 else set()
        sure = {x: a / (a + 0.25 * b + 0.5) for x, (a, b, n, rows) in sums.items() if n >= 3 and len(rows) >= 3}
        sure = {x: p for x, p in sure.items() if p >= 0.8}
        doubt = {}
        for (k, p, v), e in edges.items():
            if not e[0] and (k, p) in sure:
                doubt[(k, v)] = doubt.get((k, v), 1.0) * (1 - min(sure[(k, p)], 0.999))
        grown = dict(known)
        for x, d in doubt.items():
            if 1 - d >= 0.9:
                grown[x] = max(known.get(x, 0.0), 1 - d)
        if len(grown) == len(known):
            return grown
        known = grown


def test_score_graph(spark):
    rng = np.random.default_rng(14)
    rows = [(int(r), ["phone", "card"][: int(n)], bool(s), f"v{v}", f"p{int(v) % 5 if rng.random() < 0.8 else int(x)}") for r, n, s, v, x in zip(rng.integers(0, 90, 500), rng.integers(1, 3, 500), rng.random(500) < 0.5, rng.integers(0, 120, 500), rng.integers(0, 40, 500))]
    got = {(r.kind, r.value): r.confidence for r in pii.score_graph(spark.createDataFrame(rows, "row long, kinds array<string>, seed boolean, value string, pattern string")).collect()}
    want = plain_graph(rows)
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_patterns_discover(spark, docs, empty):
    rows = [(i, f"Text number one. please call me at +1 415 555 {2000 + i} today thanks, bye") for i in range(12)]
    rows += [(100 + i, f"Other text. please call me at 415 555 {3000 + i} today thanks, bye") for i in range(4)]
    rows += [(200, "the year was about 1234567 units of stock"), (201, None), (202, "")]
    # the second hop: numbers found beside "me at" stand beside another pattern, which finds further ones
    rows += [(300 + i, f"so reach our desk 415 555 {3000 + i} within office hours ok") for i in range(4)]
    rows += [(400, "so reach our desk 415 777 9000 within office hours ok"), (400, "so reach our desk 415 777 9000 within office hours ok")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(table).collect()}
    text = dict(rows)
    for d, number in [(100 + i, f"415 555 {3000 + i}") for i in range(4)] + [(300 + i, f"415 555 {3000 + i}") for i in range(4)] + [(400, "415 777 9000")]:
        assert [(s.kind, text[d][s.start : s.stop]) for s in got[d].spans] == [("phone", number)] and not got[d].base, d
    assert not got[200].spans and not got[201].spans and all(got[i].base == got[i].spans for i in range(12))
    assert len(pii.find(table).collect()) == len(rows)
    assert len(pii.find(docs).collect()) == docs.count() and pii.find(empty).collect() == []
    odd = [(1, "a bob@x.example b", 99, "m"), (2, None, 5, "m"), (3, "fine", 4, None), (None, "+1 415 555 2671", 1, "m"), (1, "a bob@x.example b", 99, "m")]
    red = pii.redact(spark.createDataFrame(odd, "doc_id long, text string, n_chars long, mentions string"))
    assert red.columns == ["doc_id", "text", "n_chars", "mentions"]
    assert sorted(map(tuple, red.collect()), key=key) == sorted([(1, "a [EMAIL] b", 11, "m"), (2, None, 5, "m"), (3, "fine", 4, None), (None, "[PHONE]", 7, "m"), (1, "a [EMAIL] b", 11, "m")], key=key)
    assert pii.redact(empty).collect() == []


def test_bpe(spark, docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI_RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs, MULTI_RANKS), MULTI_RANKS).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, MULTI_RANKS).collect() == []
    assert "".join(bpe.stretches(LONG, 100)) == LONG and len(list(bpe.stretches("x" * 1000, 100))) == 1


def test_json_vocabulary_is_that_of_the_library():
    library, own = Tokenizer.from_file(TOKENIZER), bpe.from_json(TOKENIZER)
    rng = np.random.default_rng(4)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(list("abcdefgh THE'll 123é日🙂\n\t<|>"), 80)) for _ in range(500)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert bpe.ids_of(t, own).tolist() == e.ids


def test_token_counts(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(tokencount, "BLOCK_DOCS", 3)
    library = Tokenizer.from_file(TOKENIZER)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect()), key=key)
    assert sorted(map(tuple, tokencount.count_tokens(docs, TOKENIZER).collect()), key=key) == want
    assert tokencount.count_tokens(empty, TOKENIZER).collect() == []


def test_packed_frequencies():
    rng = np.random.default_rng(0)
    for _ in range(100):
        at = np.sort(rng.choice(400_000, rng.integers(0, 30), replace=False)).astype(np.int64)
        n = rng.choice([1, 2, 255, 256, 510, 511, 1000], len(at)).astype(np.int64)
        steps, counts = tokencount.packed(at, n)
        total = {}
        for place, c in zip(np.cumsum(steps.astype(np.int64)).tolist(), counts.tolist()):
            total[place] = total.get(place, 0) + c
        assert {k: v for k, v in total.items() if v} == dict(zip(at.tolist(), n.tolist()))


def test_markup_is_dropped_as_by_the_pattern():
    drop = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")
    rng = np.random.default_rng(15)
    parts = ["<!--", "-->", "<script", "<style>", "</script >", "</STYLE>", "<p>", ">", "<", "a", " ", "x<y", "<Script a>", "</script", "<!-->", "<scripted>"]
    for _ in range(5000):
        page = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert langid.without_markup(page) == drop.sub(" ", page), page
    assert langid.visible_text("a&amp;b &#" + "1" * 6000 + "; c") == "a&b \ufffd c" and langid.visible_text(None) == ""


def plain_fusion(rows, model):
    """``langid.identify`` for pages by plain Python loops: the posteriors of each (key, url, html)."""
    names = model.languages
    size = len(names)
    norm = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    parsed = []
    for k, url, page in rows:
        m = re.search(r"(?i)<html\b[^<>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})", page or "")
        u = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
        host = u[1].lower() if u else None
        log = model.log_likelihood(langid.visible_text(page))
        said = None if not m else names.index(m[1].lower()) if m[1].lower() in names[:-1] else size
        labels = host.split(".") if host else None
        parsed.append((k, log, norm(log), said, host, ".".join(labels[-2:]) if host else None, labels[-1] if host else None))
    total = sum((p[2] for p in parsed), np.zeros(size)) + 1
    top = total / total.sum()
    trust = np.ones((size + 1, size))
    level = [{}, {}, {}]
    for _, _, post, said, *address in parsed:
        if said is not None:
            trust[said] += post
        for i, name in enumerate(address):
            if name is not None:
                n, c = level[i].get(name, (0, np.zeros(size)))
                level[i][name] = (n + 1, c + post)
    trust = trust / trust.sum(axis=0)
    smooth = lambda c, n, p: (np.maximum(c, 0) + 5 * p) / (n + 5)
    out = []
    for k, log, post, said, host, domain, suffix in parsed:
        prior = top
        if host is not None:
            for i, name in ((2, suffix), (1, domain)):
                n, c = level[i][name]
                prior = smooth(c, n, prior)
            n, c = level[0][host]
            prior = smooth(c - post, n - 1, prior)
        fused = norm(log + np.log(prior) + (np.log(trust[said]) if said is not None else 0))
        out.append((k, names[int(fused.argmax())], fused.max(), names[int(post.argmax())], post.max()))
    return out


def test_fusion_is_that_of_plain_bayes(spark):
    rng = np.random.default_rng(16)
    vocabulary = {"aa": ["bana", "lota", "miko", "sato"], "bb": ["grunf", "schlek", "dwurp", "zorch"]}
    labelled = spark.createDataFrame([(" ".join(rng.choice(vocabulary[x], 40)), f"{x}-XX") for x in ("aa", "bb") for _ in range(40)], "text string, lang string")
    model = langid.fit(labelled)
    assert model.languages == ["aa", "bb", "und"]
    hosts = [None, "", "http://a.x.aa/1", "https://u@b.x.aa:80/", "http://b.y.bb?q", "ftp://localhost/z", "nonsense"]
    heads = ["<html lang='aa'>", "<HTML class=x lang=bb-AT>", '<html lang="zz">', "<html>", ""]
    rows = [(int(i % 70), hosts[rng.integers(len(hosts))], heads[rng.integers(len(heads))] + " ".join(rng.choice([*vocabulary["aa"], *vocabulary["bb"], "<b>", "12", "&amp;"], rng.integers(0, 6)))) for i in range(80)]
    rows += [(90, None, None), (91, hosts[2], ""), (92, hosts[2], "bana lota " * 20_000), (None, hosts[3], "<p>grunf")]
    got = langid.page_languages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, language string"), model).collect()
    place = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[2], 6), round(r[4], 6))
    want, got = sorted(plain_fusion(rows, model), key=place), sorted(map(tuple, got), key=place)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g[0], g[1], g[3]) == (w[0], w[1], w[3]) and abs(g[2] - w[2]) < 1e-5 and abs(g[4] - w[4]) < 1e-5, (g, w)


def test_languages_are_not_cut(spark):
    many = spark.range(70).select(F.concat(F.lit("text of its own "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    assert len(langid.fit(many).languages) == 71
    with pytest.raises(ValueError):
        langid.fit(many, max_languages=69)
    copies = spark.range(5000).select(F.lit("the same text").alias("text"), F.lit("aa").alias("lang"))
    assert langid.fit(copies, per_language=10).log_p.shape == (2, langid.BUCKETS)


def test_languages(spark, empty):
    rng = np.random.default_rng(6)
    vocabulary = {"aa": ["bana", "lota", "miko", "sato"], "bb": ["grunf", "schlek", "dwurp", "zorch"]}
    text = lambda lang, n=60: " ".join(rng.choice(vocabulary[lang], n))
    labelled = spark.createDataFrame([(text(x), x) for x in ("aa", "bb") for _ in range(40)] + [(None, "aa"), ("x", None)], "text string, lang string")
    model = langid.fit(labelled)
    assert model.languages == ["aa", "bb", "und"]
    pages = [(i, f"http://h{i % 3}.x.{'bb' if i % 2 else 'aa'}/", f"<html lang='{'aa' if i % 2 == 0 else 'bb'}'><script>zorch</script><p>{text('aa' if i % 2 == 0 else 'bb')}</p>") for i in range(30)]
    pages += [(90, None, None), (91, "nonsense", ""), (92, "http://h0.x.aa/", "<p>1234 !!</p>"), (1, pages[1][1], pages[1][2])]
    got = langid.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert all(by[i].language == ("bb" if i % 2 else "aa") for i in range(30))
    assert by[92].language == "aa" and by[92].text_confidence < 0.5  # the host decides where the text says nothing
    docs = spark.createDataFrame([(1, text("aa"), "aa", "s"), (2, text("bb"), None, None), (3, "qxjw vkzq pfjq xzvw " * 20, "aa", "s"), (4, text("bb"), "aa", "s")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in langid.keep_identified(docs, model).collect()} == {1, 2, 4}
    nothing = langid.document_languages(docs.where("false"), langid.fit(labelled.where("false")))
    assert nothing.collect() == []


def plain_warc(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    return first


def test_warc(spark, tmp_path):
    big = "<html>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 200
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (4, None, big), (1, "http://c/", "small"), (2, "http://d/", "small"), (6, "http://e/", None), (7, "http://f/", ""), (3, "http://b/\r\nX: y", big), (None, "http://g/", "z" * 150)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    got = warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()
    out = sorted(((r.page_id, r.response.payload_bytes if r.response.payload_bytes is not None else r.first.payload_bytes, r.response.payload_digest, r.type, r.refers_to) for r in got), key=key)
    want, seen = [], set()
    for i, _, h in rows:
        data = (h or "").encode()
        first = plain_warc(rows).get(h)
        again = first is not None and i is not None and (first != i or (i, h) in seen)
        seen.add((i, h))
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert out == sorted(want, key=key)
    assert all(r.request is not None and r.metadata is not None for r in got)
    stored = {bytes(r.block).partition(b"\r\n\r\n")[2] for r in warc.read(spark, str(tmp_path / "w"), with_block=True).where("type = 'response'").collect()}
    assert big.encode() in stored
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "none"))).collect() == []
    for torn in (b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort", b"junk", b"WARC/1.1\r\nno end", gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n")[:-9]):
        with pytest.raises(ValueError):
            list(warc.parse([torn]))


def test_warc_members_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CHUNKS", 2)
    rng = np.random.default_rng(30)
    noise = lambda n: "".join(map(chr, rng.integers(32, 0x2000, n)))
    rows = [(i, f"http://h/{i}", noise(int(rng.integers(0, 4000)))) for i in range(300)] + [(300, "http://long/", noise(3_000_000))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, turn int")
    for compression in ("gzip", "none"):
        path = tmp_path / compression
        warc.write(pages.repartition(2), str(path), compression, chunk=100_000)
        files = [f.read_bytes() for f in path.glob("part-*")]
        assert len(files) > 4
        one = max(files, key=len)
        records = list(warc.parse(one[a : a + 777] for a in range(0, len(one), 777)))
        if compression == "gzip":  # a member for each record, each of which can be read alone
            members, rest = [], one
            while rest:
                inflate = zlib.decompressobj(31)
                members.append(inflate.decompress(rest))
                assert inflate.eof
                rest = inflate.unused_data
            assert len(members) == len(records) and all(len(list(warc.parse([m]))) == 1 for m in members)
        read = warc.read(spark, str(path), with_block=True)
        got = {r.target_uri: bytes(r.block).partition(b"\r\n\r\n")[2] for r in read.where("type = 'response'").collect()}
        assert got == {u: h.encode() for _, u, h in rows}
        # the same records in archives of another make, read as a stream
        other = tmp_path / f"other-{compression}"
        other.mkdir()
        (other / "all.warc.gz").write_bytes(b"".join(files) if compression == "gzip" else gzip.compress(b"".join(files)))
        (other / "one.warc").write_bytes(files[0])
        want = sorted(r.record_id for r in read.collect()) + [h["warc-record-id"] for _, h, _ in warc.parse([files[0]])]
        assert sorted(r.record_id for r in warc.read(spark, str(other)).collect()) == sorted(want)
        blocks = {r.target_uri: bytes(r.block).partition(b"\r\n\r\n")[2] for r in warc.read(spark, str(other), with_block=True).where("type = 'response'").collect()}
        assert blocks == got


def vectors(spark, n=1500, dim=16):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:400] = x[100]  # a common vector: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    odd = [(5000, None), (5050, [float("nan")] * dim), (5100, [None] + [0.1] * (dim - 1)), (5150, [float("inf")] + [0.0] * (dim - 1)), (5200, [0.5, 0.5]), (5250, [0.1, 0.2])]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")


def test_exact_top_k(spark):
    rows, table = vectors(spark)
    own = topk.quantised(table, 256)
    got = sorted(map(tuple, topk.exact_top_k(own, own.where("id % 50 = 0"), 5, shard=300, block=16).collect()))
    v = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows} | {5200: np.array([128, 128]), 5250: np.array([25, 51])}
    want = []
    for q in v:
        if q % 50 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.exact_top_k(own.where("false"), own.where("false"), 5).collect() == []
    huge = spark.createDataFrame([(0, [2**31, 1]), (1, [2**30, 3]), (2, [2**30, 5])], "id long, v array<long>")
    assert [(r.vec_id, r.score) for r in topk.exact_top_k(huge, huge.where("id = 0"), 5).orderBy("rank").collect()] == [(2, 2**61 + 5), (1, 2**61 + 3)]


def test_hadamard_and_cells():
    rng = np.random.default_rng(20)
    x = rng.normal(size=(50, 48))
    y = ann.pseudo_rotation(x, 3)
    assert y.shape == (50, 64) and np.allclose((y**2).sum(axis=1), (x**2).sum(axis=1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for bits in (0, 1, 5, 7, 9, 15):
        home, every = ann.homes(unit, 2, bits), ann.probes(unit, 2, bits, 1 << bits)
        assert sorted(every[0].tolist()) == list(range(1 << bits))  # all cells, once each
        assert (ann.probes(unit, 2, bits, 1)[:, 0] == home).all()
    assert ann.axes_of(64, 9) == [64, 2] and ann.axes_of(64, 0) == []


def recall(found, x, ids, k=20):
    """The share of the k true neighbours that were found, and the fewest rows that a query got."""
    asks = np.nonzero(ids % 20 == 0)[0]
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -np.inf
    best = np.argpartition(-score, k, axis=1)[:, :k]
    got = [len(by.get(ids[q], set()) & set(ids[row].tolist())) / k for q, row in zip(asks, best)]
    return float(np.mean(got)), min(len(by.get(ids[q], ())) for q in asks)


@pytest.mark.parametrize("norms", ["unit", "spread", "outlier"])
def test_recall(spark, norms):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= {"unit": np.ones((10_000, 1)), "spread": rng.lognormal(size=(10_000, 1)), "outlier": np.where(np.arange(10_000) == 77, 10.0, 1.0)[:, None]}[norms]
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = ann.approximate_top_k(ann.usable(table), "id % 20 = 0", 20, region=2000).collect()
    share, least = recall(found, x.astype(float), np.arange(10_000))
    assert share >= 0.9 and least == 20


def test_approximate_top_k(spark):
    rows, table = vectors(spark)
    zero = spark.createDataFrame([(6000, [0.0] * 16), (1, [3.0] + [0.0] * 15), (40, [0.0] * 15 + [1.0])], "vec_id long, embedding array<float>")
    both = table.unionAll(zero).withColumn("v", F.lit("clash")).withColumn("score", F.lit(1))
    got = ann.approximate_top_k(ann.usable(both), "id % 20 = 0", 20, cell=1 << 20).collect()  # one cell: all are met
    x = [(i, np.array(v, np.float32).astype(float)) for i, v in rows] + [(1, np.array([3.0] + [0.0] * 15)), (40, np.array([0.0] * 15 + [1.0]))]
    ids, m = np.array([i for i, _ in x]), np.stack([v for _, v in x])
    want = []
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        best = {}
        for own in m[ids == q]:
            for i, s in zip(ids.tolist(), ann.inner(np.broadcast_to(own, m.shape), m).tolist()):
                if i != q:
                    best[i] = max(s, best.get(i, -np.inf))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:20])]
    want += [(5200, 1, 5250, float(np.float32(0.1)) * 0.5 + float(np.float32(0.2)) * 0.5)]
    assert sorted(map(tuple, got)) == sorted(want)
    blocks = ann.approximate_top_k(ann.usable(both), "id % 20 = 0", 20, cell=1 << 20, region=50).collect()
    assert sorted(map(tuple, blocks)) == sorted(want)  # a region in many blocks gives the same
    few = ann.usable(table.where("vec_id in (20, 1, 2)"))
    assert len(ann.approximate_top_k(few, "id % 20 = 0", 20).collect()) == 2
    assert ann.approximate_top_k(few.where("false"), "id % 20 = 0", 20).collect() == []
    doubles = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e-200, 0.0]), (2, [1.0, 1e-9])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.approximate_top_k(ann.usable(doubles), "id = 0", 5).orderBy("rank").collect()] == [(2, 1e200), (1, 1.0)]


def test_packing(spark, docs, empty):
    out = packing.pack_documents(docs, TOKENIZER, size=64, end=1, with_ids=True).collect()
    library = Tokenizer.from_file(TOKENIZER)
    want = sorted(((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in docs.collect()), key=key)
    pieces = sorted(((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.ids_crc32, r.length, r.doc_tokens) for r in out), key=key)
    assert sum(len(p[2]) for p in pieces) == sum(len(w[1]) for w in want)
    for d, w in want:
        if d not in (3, None):
            assert [t for p in sorted(p[:3] for p in pieces if p[0] == d) for t in p[2]] == list(w)
    assert all(zlib.crc32(np.array(p[2], "<u4").tobytes()) == p[3] and len(p[2]) == p[4] <= 64 for p in pieces)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(empty, TOKENIZER).collect() == []
    alike = spark.range(3000).select("id", (F.col("id") % 3 + 8).cast("int").alias("length"))
    packed = packing.pack(alike, 10, ["id"], slice_rows=100).collect()  # lengths in many slices
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert len(set(places)) == 3000 and all(n + o <= 10 for _, o, n in places)


def plain_shortest_pack_first(counts, size):
    """One piece after the other: to the pack with the most room, if it fits there."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            if room and max(room) >= length:
                room[room.index(max(room))] -= length
            else:
                room.append(size - length)
    return sorted(room)


def test_pack_histogram():
    assert sorted(packing.pack_histogram({6: 1, 5: 1, 2: 1}, 10)) == [((5, 2), 1), ((6,), 1)]
    rng = np.random.default_rng(9)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        counts = {int(n): int(rng.integers(0, 20)) for n in rng.integers(1, size + 1, 8)}
        used, rooms, found = {}, [], packing.pack_histogram(counts, size)
        for pattern, n in found:
            assert sum(pattern) <= size and n > 0
            rooms += [size - sum(pattern)] * n
            for length in pattern:
                used[length] = used.get(length, 0) + n
        assert used == {k: v for k, v in counts.items() if v}
        assert sorted(rooms) == plain_shortest_pack_first(counts, size) and len(found) <= 3 * size
    # a corpus: lengths as of documents, with full pieces; little padding, and as many patterns for more rows
    counts = {2048: 5000} | {int(k): int(v) for k, v in zip(*np.unique(np.minimum(2047, rng.lognormal(5, 1, 20_000).astype(int) + 1), return_counts=True))}
    few, many = packing.pack_histogram(counts, 2048), packing.pack_histogram({k: 1000 * v for k, v in counts.items()}, 2048)
    tokens = sum(k * v for k, v in counts.items())
    assert tokens / (2048 * sum(n for _, n in few)) > 0.99 and len(many) <= 3 * 2048


def plain_shard(k, weights):
    """The shard by plain Python: Spark's xxhash64 of a long and an int hashes one after the other."""
    best = None
    for i, w in enumerate(weights):
        seed = 42 if k is None else xxhash.xxh64_intdigest(struct.pack("<q", k), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", i), seed)
        score = -w / math.log(((h >> 11) + 0.5) * 2.0**-53) if w > 0 else -1.0
        if best is None or score > best[0]:
            best = (score, i)
    return best[1]


def placed(spark, n, weights):
    rows = spark.range(n).select("id", sharding.rendezvous([F.col("id")], weights).alias("s")).collect()
    return {r["id"]: r["s"] for r in rows}


@pytest.mark.parametrize("weights", [[1.0] * 40, [1.0, 3.0, 0.0, 0.5], [2.0]])
def test_rendezvous_is_that_of_plain_python(spark, weights):
    assert placed(spark, 3000, weights) == {k: plain_shard(k, weights) for k in range(3000)}


def test_no_row_moves_between_old_shards(spark):
    n, even = 20_000, placed(spark, 20_000, [1.0] * 10)
    for added in (1.0, 2.0, 0.3):
        grown = placed(spark, n, [1.0] * 10 + [added])
        assert {g for k, g in grown.items() if g != even[k]} == {10}
        assert abs(sum(g == 10 for g in grown.values()) / n - added / (10 + added)) < 0.02
    for changed in (1.0001, 3.0, 0.2):
        after = placed(spark, n, [1.0] * 9 + [changed])
        assert all(9 in (after[k], even[k]) for k in even if after[k] != even[k])
    slightly = placed(spark, n, [1.0] * 9 + [1.0001])
    assert sum(slightly[k] != even[k] for k in even) < 20


def test_sharding(spark, docs, empty):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("slot")).unionByName(spark.createDataFrame([(7, "y", 2)] * 50 + [(None, "z", 3)], "doc_id long, shard string, slot int"))
    out = sharding.shard(many, [1.0] * 40, slice_rows=1000).collect()
    assert len(out) == 20_051 and len({r.shard for r in out if r.doc_id == 7}) == 1
    assert all(r.shard == plain_shard(r.doc_id, [1.0] * 40) and r.grown_shard == plain_shard(r.doc_id, [1.0] * 41) for r in out)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40
    weighted = many.withColumn("w", sharding.rendezvous([F.col("doc_id")], [1.0, 3.0, 0.0])).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20_051 for r in weighted}
    assert set(share) == {0, 1} and 0.72 < share[1] < 0.78
    assert sharding.shard(empty, [1.0] * 4).collect() == [] and len(sharding.shard(docs, [1.0] * 4).collect()) == docs.count()
    with pytest.raises(ValueError):
        sharding.rendezvous([F.col("doc_id")], [])


def test_sharding_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_rendezvous_shards(spark, str(tmp_path)).collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()), "key", plain_shard(r.doc_id, [1.0] * 40), plain_shard(r.doc_id, [1.0] * 41)) for r in docs.collect()]
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=key) == sorted(want, key=key)


def edited_pairs(rng, n_each=12):
    """Pairs of texts with a true five-word similarity of 0.8 to 0.9 or, as many, of 0.7 to 0.79: short and long, appended and scattered."""
    out = []
    for length in (40, 80, 200, 1000):
        for scattered in (False, True):
            for low, high in ((0.8, 0.82), (0.82, 0.9), (0.7, 0.79)):
                found = 0
                while found < n_each:
                    a = [f"v{i}" for i in rng.integers(0, 1 << 40, length)]
                    b = a.copy()
                    if scattered:
                        for p in rng.choice(length, max(1, int(rng.uniform(0.005, 0.05) * length)), replace=False):
                            b[p] = "edited"
                    else:
                        b += [f"v{i}" for i in rng.integers(0, 1 << 40, int(rng.uniform(0.08, 0.45) * length))]
                    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
                    if low <= len(x & y) / len(x | y) < high:
                        out.append((" ".join(a), " ".join(b), low >= 0.8))
                        found += 1
    return out


def test_near_copies_at_the_threshold(spark):
    pairs = edited_pairs(np.random.default_rng(5))
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    assert all(2 * i + 1 in kept for i, p in enumerate(pairs) if not p[2])  # confirmed exactly: nothing below 0.8 goes
    lost = [2 * i + 1 in kept for i, p in enumerate(pairs) if p[2]]
    assert np.mean(lost) <= 0.02


def test_forest_of_candidates_is_searched_again_where_it_tears(spark):
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in rng.integers(0, 1 << 40, 300)]
    rows = []
    for i in range(60):  # one template with changes: pairs lie on both sides of 0.8
        text = base.copy()
        for p in rng.choice(300, int(rng.integers(1, 9)), replace=False):
            text[p] = f"x{i}p{p}"
        rows.append((i, " ".join(text)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert len(set(group)) > 1
    assert {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(group)


def test_leaf_of_one_template_is_split(spark):
    rng = np.random.default_rng(8)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (700, 2))})
    points = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    prints = points.select(F.array("fp").alias("prints"), F.col("id").alias("node"))
    dealt = simhash.sharded(prints, 1, 3, simhash.LEAF, 0, bound=200).groupBy("shard", "cell").agg(F.collect_set("node").alias("n")).collect()
    assert len(fps) > 400 and max(len(r.n) for r in dealt) <= 300
    assert len({(a, b) for r in dealt for a in r.n for b in r.n}) == len(fps) ** 2  # every two points meet
    links = simhash.fingerprint_links(points, 3, bound=200)
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    whole = {r.node: r.component for r in components.connected_components(simhash.fingerprint_links(points, 3)).collect()}
    assert found == whole and len(whole) > 0


def test_points_like_no_other_are_not_sent_around(spark):
    """What moves for near copies are the points that share a bucket with another, however many points there are."""
    rng = np.random.default_rng(8)
    sketches = rng.integers(0, 256, (600, 128), dtype=np.uint8)
    sketches[300:310] = sketches[299]
    sketches[300:310, :20] = rng.integers(0, 256, (10, 20))  # ten that share 0.84 with one
    prints = rng.integers(0, 1 << 62, (600, 3))
    prints[300:310] = prints[299]
    prints[310], sketches[310] = ~prints[0], sketches[0]  # alike by the sketch alone
    points = spark.createDataFrame([(i, prints[i].tolist(), sketches[i].tobytes()) for i in range(600)], "node long, prints array<long>, sketch binary")
    for bound in (simhash.BOUND, 4):  # buckets of eleven, whole and in blocks
        assert {r.node for r in simhash.banded(points, bound).select("node").distinct().collect()} == {0, *range(299, 311)}
        found = components.connected_components(simhash.candidates(points, simhash.WIDE, 0.68, bound)).collect()
        assert {(r.node, r.component) for r in found} == {(n, 299) for n in range(300, 310)}
    few = simhash.bucket_pairs(np.zeros(600, np.int64), np.arange(600), prints.view(np.uint64), sketches, simhash.WIDE, 0.68)
    many = simhash.bucket_pairs(np.repeat(np.arange(20), 30), np.arange(600), prints.view(np.uint64), sketches, simhash.WIDE, 0.68)
    assert len(few[0]) == 10 and set(few[0]) | set(few[1]) == set(range(299, 310)) and len(many[0]) == 9
