"""Node tables, marks, titles and results of pages against a plain walk over the trees that the pages were written from."""

import html
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowlens.functions import web
from sparrowlens.operators import pages as op
from sparrowlens.sources import nodes


class El:
    def __init__(self, tag, attrs=None, kids=()):
        self.tag, self.attrs, self.kids, self.up = tag, attrs or {}, list(kids), None
        for k in self.kids:
            if isinstance(k, El):
                k.up = self

    def below(self):
        for k in self.kids:
            if isinstance(k, El):
                yield k
                yield from k.below()

    def strings(self, gone=lambda e: False):
        for k in self.kids:
            if isinstance(k, str):
                yield k
            elif not gone(k):
                yield from k.strings(gone)

    def text(self, sep=" ", gone=lambda e: False):
        return sep.join(s.strip() for s in self.strings(gone) if s.strip())

    def raw(self):
        return "".join(self.strings())

    def ups(self):
        e = self
        while e is not None:
            yield e
            e = e.up

    def get(self, name):
        return self.attrs.get(name, "")

    def write(self):
        attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        inner = "".join(html.escape(k, quote=False) if isinstance(k, str) else k.write() for k in self.kids)
        return f"<{self.tag}{attrs}>" + ("" if self.tag in ("br", "img") else f"{inner}</{self.tag}>")


WORDS = ["Silver teapot", "New", "Sale", "€ 12,50", "19.99 EUR", "Blue wool scarf for winter", "ok", "+3 colors", "Oak chair", "12 %", "Add to cart", "Top deals", "Lamp & shade", "é ü", "kr 20", "read"]
CLASSES = ["product-card", "item", "grid", "js-header", "sidebar", "product-grid-sidebar", "promo", "title", "name", "price", "badge", "sr-only", "desc", "x", "amount tag", "hover-content", "card-title", "is-hidden", "col"]
TAGS = ["div", "div", "li", "a", "span", "article", "section", "h2", "h5", "p", "ul", "nav", "x-root", "b", "footer", "tr", "figure", "br"]


def tree(rng, depth=0):
    tag = rng.choice(TAGS) if depth else "body"
    attrs = {}
    if rng.random() < 0.5:
        attrs["class"] = " ".join(rng.sample(CLASSES, rng.choice([1, 1, 2])))
    if rng.random() < 0.1:
        attrs["id"] = rng.choice(["cookie-wall", "results", "main"])
    if tag == "a" and rng.random() < 0.8:
        attrs["href"] = rng.choice(["#", "/p/1", "https://x.example/p?a=1&b=2", "", "#top"])
    for name, values, share in (("data-testid", ["hover-overlay", "card-7", "a"], 0.05), ("data-nc", ["badge-x", "q"], 0.05), ("data-product-name", ["y"], 0.06), ("data-flag", [""], 0.04), ("role", ["heading", "listitem"], 0.08), ("aria-label", ["Add to cart", "A fine teapot", "abc"], 0.2 if tag == "a" else 0), ("data-props", ['{"title": " From data ", "brandLine1": "Brand"}', "broken", '{"name": 5}', "[1]"], 0.04)):
        if rng.random() < share:
            attrs[name] = rng.choice(values)
    kids = []
    if tag != "br":
        for _ in range(rng.randrange(0, 5 if depth else 9)):
            if depth < 5 and rng.random() < 0.6:
                kids.append(tree(rng, depth + 1))
                if rng.random() < 0.3:  # siblings that are alike
                    kids += [like(rng, kids[-1]) for _ in range(rng.randrange(1, 7))]
            elif not kids or isinstance(kids[-1], El):
                kids.append(rng.choice(["", " ", "\n "]) + rng.choice(WORDS) + rng.choice(["", "\n"]))
    return El(tag, attrs, kids)


def like(rng, e):
    return El(e.tag, dict(e.attrs), [like(rng, k) if isinstance(k, El) else rng.choice(WORDS) for k in e.kids])


def sub(pattern, text):
    return re.search(pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace(r"\x{200B}", "​"), text)


def chrome(e):
    for n in e.ups():
        if n.tag in ("body", "html") or "-" in n.tag:
            continue
        if n.tag in ("header", "footer", "nav") or any(sub(op.CHROME, t) and not sub(op.CONTENT, t) for t in [*n.get("class").split(), n.get("id")]):
            return True
    return False


def own_hidden(e):
    return bool(sub(op.HIDDEN, e.get("class")) or re.search(op.HIDDEN_TEST, e.get("data-testid")))


def hidden(e):
    return any(own_hidden(n) for n in e.ups())


def badge(e):
    return any(k.startswith("data-") and sub(op.BADGE, k) for k in e.attrs) or "badge" in e.get("data-nc") or (e.up is not None and "badge" in e.up.get("data-nc")) or bool(sub(op.BADGE, e.get("class")))


def price(text):
    for pattern in (web.PRICE, op.SHORT_PRICE):
        if m := re.search(pattern, text):
            return m.group(0).strip()
    return None


def title(card):
    inner = list(card.below())
    shown = [e for e in inner if not hidden(e) and not badge(e)]
    head = lambda e: re.match("^h[1-6]$", e.tag)
    if head(card) and card.text():
        return card.text()[:300], "heading"
    for e in [card, *inner]:
        for a in op.DATA_ATTRS:
            try:
                data = json.loads(e.get(a))
            except ValueError:
                continue
            parts = [data[k].strip() for k in op.TITLE_KEYS if isinstance(data.get(k), str) and data[k].strip()] if isinstance(data, dict) else []
            if parts:
                return " ".join(parts)[:300], "data"
    for step, test in (("name", lambda e: any(k.startswith("data-") and sub(op.NAME_ATTR, k) for k in e.attrs)), ("class", lambda e: any(w in e.get("class").lower() for w in ("title", "name", "heading")))):
        for e in shown:
            if test(e) and len(e.text()) > 2:
                return e.text()[:300], step
    for step, test in (("role", lambda e: e.get("role") == "heading"), ("inner", head)):
        e = next(filter(test, inner), None)
        if e is not None and not hidden(e) and e.text():
            return e.text()[:300], step
    link = next((e for e in inner if e.tag == "a"), None)
    if link is not None:
        label = link.get("aria-label").strip()
        if len(label) > 4 and not sub(op.BUTTONS, label):
            return label[:300], "label"
        own = link.text(gone=lambda e: own_hidden(link) or own_hidden(e) or badge(e))
        if len(own) > 2:
            return own[:300], "link"
    parts = []
    for e in shown:
        t = e.text()
        if any(isinstance(k, El) for k in e.kids) or not t:
            continue
        if price(t):
            break
        if 3 <= len(t) <= 150 and not sub(op.NO_NAME, t) and not sub(op.ONLY_SIGNS, t):
            parts.append(t)
            if len(parts) == 3 or sum(map(len, parts)) >= 80:
                break
    return (" ".join(parts)[:300], "words") if parts else (None, None)


def details(card):
    inner = list(card.below())
    styled = lambda words: [e for e in inner if any(w in e.get("class").lower() for w in words)]
    cost = next((p for p in (price(e.text()) for e in styled(["price", "cost", "amount", "money"])) if p), None) or price(card.text())
    snippet = next((e.text()[:300] for e in styled(["description", "snippet", "subtitle", "detail", "desc"]) if len(e.text()) > 5), None)
    good = lambda h: h if h not in ("", "#") else None
    link = next((e for e in inner if e.tag == "a" and "href" in e.attrs), None)
    url = (good(card.up.get("href")) if card.up is not None and card.up.tag == "a" else None) or (good(link.get("href")) if link is not None else None)
    return *title(card), cost, snippet, url


def linked(e):
    return any(d.tag == "a" and "href" in d.attrs for d in e.below())


def number(found, limit, least):
    out = [r for r in found if r[0] and len(r[0]) >= least][:limit]
    junk = lambda t: len(t) < 8 or not any(c.isalpha() for c in t) or any(t.lower().startswith(p) for p in web.JUNK_STARTS) or t.lower() in web.JUNK_TITLES
    return [(i, *r) for i, r in enumerate((r for r in out if not junk(r[0].strip())), 1)]


def plain_cards(body, limit=15, many=op.MANY):
    every = [body, *body.below()]

    def is_card(e):
        names = [v for k, v in e.attrs.items() if k.startswith("data-") or k in ("class", "id")]
        if e.tag in op.INLINE or not (any(sub(op.CARD, v) for v in names) or e.tag in ("article", "figure") or e.get("role") == "listitem") or chrome(e):
            return False
        if sub(op.CHROME, e.get("class")) or sub(op.CHROME, e.get("id")) or len(e.text("")) < 15:
            return False
        if e.tag == "li" and not (e.up is not None and any(w in (e.up.get("class") + " " + e.up.get("id")).lower() for w in op.LISTS)):
            return False
        head = next((d for d in e.below() if d.tag in ("h1", "h2", "h3")), None)
        return head is None or not sub(op.SECTION, head.text(""))

    cards = [e for e in every if is_card(e)]
    if len(cards) > many:
        own = lambda e: [c for c in e.get("class").split() if sub(op.CARD, c)]
        seen = [c for e in cards for c in own(e)]
        if seen:
            top = max(dict.fromkeys(seen), key=seen.count)
            if seen.count(top) / len(cards) > 0.5:
                cards = [e for e in cards if any(c != top for c in own(e))]
        cards = [] if len(cards) > many else cards
    leaf = [e for e in cards if not any(d in cards for d in e.below())]
    groups = {}
    for i, tag in enumerate(op.REPEATED):
        for at, e in enumerate(every):
            if e.tag == tag and linked(e) and len(e.text("")) >= 20 and not chrome(e):
                groups.setdefault((i, id(e.up)), {}).setdefault((e.get("class").split() or [""])[0], []).append(e)
    best = max((g for own in groups.values() for g in own.values()), key=len, default=[])
    best = best[: 3 * limit] if len(best) >= 5 else []
    good = lambda own: sum(linked(e) and price(e.raw()) is not None for e in own) / len(own) if own else 0.0
    chosen = best if best and (good(best) > good(leaf) + 0.2 or (good(best) > 0 and len(best) >= len(leaf))) else leaf
    told = lambda e: any(w in d.get("class").lower() for d in e.below() for w in ("desc", "snippet", "subtitle", "detail"))
    chosen = sorted(chosen, key=lambda e: 2 * (not linked(e)) + (not (price(e.raw()) or told(e))))
    return number([details(e) for e in chosen], limit, 2)


def plain_list(body, limit=15):
    groups = {}
    for tag in op.LISTED:
        for e in [body, *body.below()]:
            if e.tag == tag and any(d.tag == "a" for d in e.below()) and len(e.text("")) >= 10 and not chrome(e):
                groups.setdefault(id(e.up), []).append(e)
    best = max(groups.values(), key=len, default=[])
    found = [details(e) for e in best] if len(best) > 1 else []
    return number([(t, s, p, None, u) for t, s, p, _, u in found], limit, 3)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(21)
    bodies = [tree(rng) for _ in range(120)]
    return bodies, spark.createDataFrame([(i, b.write(), f"https://h{i % 3}.example/s") for i, b in enumerate(bodies)], "page_id long, html string, url string").repartition(4).cache()


def test_nodes(made):
    bodies, pages = made
    got = {}
    for r in nodes.page_nodes(pages).collect():
        got.setdefault(r.page_id, {})[r.pre] = r
    for i, body in enumerate(bodies):
        every = [body, *body.below()]
        at = {id(e): k for k, e in enumerate(every)}
        assert [(r.tag, r.last, r.parent, r.text) for _, r in sorted(got[i].items())] == [(e.tag, k + len(list(e.below())), at.get(id(e.up), -1), e.text()) for k, e in enumerate(every)]


def test_marks(made):
    bodies, pages = made
    got = {(r.page_id, r.pre): (r.tag, r.chrome, r.hidden, r.badge) for r in op.page_marks(pages).collect()}
    want = {(i, k): (e.tag, chrome(e), hidden(e), badge(e)) for i, b in enumerate(bodies) for k, e in enumerate([b, *b.below()])}
    assert got == want and sum(w[1] for w in want.values()) > 100 and sum(w[2] for w in want.values()) > 100


def test_candidates_and_results(made):
    bodies, pages = made
    found = op.candidates(pages).cache()
    steps = set()
    for r in found.collect():
        e = [bodies[r.page_id], *bodies[r.page_id].below()][r.pre]
        assert (r.title, r.step, r.price, r.snippet, r.url) == details(e), e.write()
        steps.add(r.step)
    assert steps >= {"data", "name", "class", "role", "inner", "label", "link", "words"}
    for rows, plain in ((op.card_results(found), plain_cards), (op.list_results(found), plain_list)):
        got = {}
        for r in rows.collect():
            got.setdefault(r.page_id, []).append((r["rank"], r.title, r.step, r.price, r.snippet, r.url))
        want = {i: w for i, b in enumerate(bodies) if (w := plain(b))}
        assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 8


def test_many_cards_of_one_class(spark, monkeypatch):
    monkeypatch.setattr(op, "MANY", 6)
    card = lambda i, cls: El("section", {"class": cls}, [El("a", {"href": f"/p/{i}"}, [f"Teapot number {i} of many"])])
    bodies = [El("body", {}, [card(i, "grid-item") for i in range(9)]), El("body", {}, [El("div", {}, [card(i, "grid-item offer" if i % 3 == 0 else "grid-item")]) for i in range(9)]), El("body", {}, [El("div", {}, [card(i, "item" if i % 2 else "offer")]) for i in range(9)])]
    pages = spark.createDataFrame([(i, b.write()) for i, b in enumerate(bodies)], "page_id long, html string")
    got = {}
    for r in op.card_results(op.candidates(pages)).collect():
        got.setdefault(r.page_id, []).append((r["rank"], r.title, r.step, r.price, r.snippet, r.url))
    assert {k: sorted(v) for k, v in got.items()} == {i: w for i, b in enumerate(bodies) if (w := plain_cards(b, many=6))}
    assert [len(got.get(i, [])) for i in range(3)] == [0, 3, 4]


SHOP = [f'<div class="tile"><a href="/p/{i}"><h3>Copper kettle number {i}</h3></a><span class="price">€ {i},00</span></div>' for i in range(6)]
DATA = '<script type="application/ld+json">{"@type": "Product", "name": "Declared kettle of copper", "url": "/d", "offers": {"price": 3}}</script>'


def test_the_best_way_wins_and_is_learned(spark, tmp_path):
    rows = [(1, "<body>" + "".join(SHOP) + DATA, "https://a.example/s?q=1"), (2, DATA + "<p>nothing else here to read</p>", "https://b.example/"), (3, None, "https://a.example/"), (4, "", None), (5, "<div <p <<< &amp", "x"), (6, "<ul><li><a href='javascript:x'>Accept the cookies now</a></li><li><a href='/t'>A second list entry</a></li></ul>", "https://c.example/")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("title", F.lit("clash"))
    first = op.extracted_results(pages)
    got = {}
    for r in first.collect():
        got.setdefault(r.page_id, []).append((r.strategy, r.score, r["rank"], r.title, r.url))
    assert {k: v[0][0] for k, v in got.items()} == {1: "cards", 2: "declared", 6: "list"}
    assert sorted(got[1])[0] == ("cards", 6 * 8.0, 1, "Copper kettle number 0", "/p/0")
    assert got[6] == [("list", 11.0, 2, "A second list entry", "/t")]  # the banner counts for the score, not for the result
    op.learned_selectors(first, pages).write.parquet(f"{tmp_path}/selectors")
    known = spark.read.parquet(f"{tmp_path}/selectors")
    assert [tuple(r) for r in known.collect()] == [("a.example", "div", "tile")]
    # the second run reads the host's tiles although the page declares more, and sweeps where fewer than three are found
    second = [(1, "<body>" + "".join(SHOP[:3]) + DATA * 9, "https://a.example/2"), (2, "<body>" + "".join(SHOP[:2]) + DATA * 9, "https://a.example/3"), (3, "<body>" + "".join(SHOP), "https://z.example/")]
    found = op.extracted_results(spark.createDataFrame(second, "page_id long, html string, url string"), known)
    got = {}
    for r in found.collect():
        got.setdefault(r.page_id, []).append((r.strategy, r["rank"], r.title))
    assert sorted(got[1]) == [("learned", i + 1, f"Copper kettle number {i}") for i in range(3)]
    assert got[2][0][0] == "list" and len(got[2]) == 2 and {g[0] for g in got[3]} == {"cards"}


def test_broken_markup(spark):
    rows = [(1, "<div><p>a<p>b</div></span><b>c<!-- x -->d<br/>e</b>"), (2, "<script>if (a < b) { '</p>' }</script>t<style>x</style>"), (3, None), (4, ""), (5, "plain &amp; &eacute;"), (6, "<p " * 50), (7, "<div>" * 3000 + "deep"), (1, "<i>again</i>")]
    got = {}
    for r in nodes.page_nodes(spark.createDataFrame(rows, "page_id long, html string")).collect():
        got.setdefault(r.page_id, []).append((r.pre, r.last, r.parent, r.tag, r.text))
    assert sorted(got[1]) == [(0, 0, -1, "i", "again"), (0, 2, -1, "div", "a b"), (1, 2, 0, "p", "a b"), (2, 2, 1, "p", "b"), (3, 4, -1, "b", "c d e"), (4, 4, 3, "br", "")]
    assert sorted(got[2]) == [(0, 0, -1, "script", ""), (1, 1, -1, "style", "")]
    assert len(got[7]) == 3000 and all(g[4] == "deep" and g[1] == 2999 for g in got[7]) and not {3, 4, 5} & set(got)


def test_pages_are_read_a_few_at_a_time():
    texts = ["x" * 300_000] * 10 + [None, ""] + ["y"] * 200 + ["z" * 3_000_000, "a"]
    parts = list(nodes.slices(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == texts and max(map(len, parts)) == nodes.SLICE
    assert all(p.nbytes <= nodes.SLICE_BYTES or len(p) == 1 for p in parts)


BITS = ["<div>", "</div>", "<p class=' a  b '>", "<a href=x>", "<a href='x/'>", "<br/>", "<input disabled>", "<A HREF=\"Q\">", "</a >", "</ a>", "<script>", "</script>", "</SCRIPT >", "<style>", "</style>", "<template>", "</template>", "text", " ", "\n", "&amp;", "&am", "&", "<", ">", "<3", "<!-- c -->", "<!DOCTYPE html>", "<!x>", "<a b=c/>", "<p\xa0x>", "<p x=\"a>b\">", "<x-y a a=1 A=2>", "<li>", "<pre>", "  z 　", "<a title='&lt;'>", "<p x = 'y'>", "<!---->", "<!-->", "</>", "<p/ a>", "<a @c=1 :d='2'>", "<script/>", "</p x>", "<p =a>", "<p a=>", "<br></br>", "<p\tk\n=\"v\">"]


def test_plain_markup_is_read_as_the_parser_reads_it(monkeypatch):
    rng = random.Random(5)
    pages = ["".join(rng.choices(BITS, k=rng.randrange(0, 14))) for _ in range(4000)] + ["", None, *BITS]
    fast = [nodes.read_pages(pages, implied).to_pylist() for implied in (False, True)]
    assert sum(nodes._plain(p or "") is not None for p in pages) > 400
    monkeypatch.setattr(nodes, "_plain", lambda html: None)
    assert fast == [nodes.read_pages(pages, implied).to_pylist() for implied in (False, True)]


def test_plain_markup_needs_no_parser(monkeypatch):
    monkeypatch.setattr(nodes.HTMLParser, "feed", lambda *a: pytest.fail("read by the parser"))
    page = '<!DOCTYPE html><script>var t="</p>"</script><!-- x --><ul class="a b"><li data-p=\'{"k": 1}\'><a href="/p?q=1">one &amp; two</a><br/></ul>'
    got = nodes.read_pages([page, None]).to_pylist()
    assert [n["tag"] for n in got[0]["nodes"]] == ["script", "ul", "li", "a", "br"] and got[0]["spaced"] == "one & two" and got[1] is None


def test_only_what_a_strategy_reads_is_looked_for(made, monkeypatch):
    _, pages = made
    monkeypatch.setattr(op, "declared_products", lambda html: pytest.fail("goods as data aren't asked for"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    found = {way: op.candidates(pages, strategies=[way]).cache() for way in ("cards", "list")}
    assert found["cards"].where("listed or declared").count() == found["list"].where("card or repeated or declared").count() == 0
    monkeypatch.undo()
    every = op.candidates(pages).cache()
    assert rows(op.card_results(found["cards"])) == rows(op.card_results(every)) and rows(op.list_results(found["list"])) == rows(op.list_results(every))


def test_marked_pages_are_read_as_the_parser_reads_them(monkeypatch):
    rng = random.Random(6)
    tags = ['<div class="badge Hero" data-nc="Badge">', "<span>", "</span>", "</div>", '<li class="card">', '<ul id="result-list">', "</ul>", '<x-top class="sr-only">', "</x-top>"]
    pages = ["".join(rng.choices([*BITS, *tags], k=rng.randrange(0, 16))) for _ in range(6000)] + ["", None, *BITS]
    quick = nodes.read_marked(pages, op.marks_of).to_pylist()
    assert sum(nodes._quick(p or "", op.marks_of) is not None for p in pages) > 400
    monkeypatch.setattr(nodes, "_plain", lambda html: None)
    monkeypatch.setattr(nodes, "_quick", lambda html, marks: None)
    assert quick == nodes.read_marked(pages, op.marks_of).to_pylist()
    plain = nodes.read_pages(pages).to_pylist()
    for one, other in zip(quick, plain):
        assert (one is None) == (other is None)
        assert one is None or ([{k: v for k, v in n.items() if k != "marks"} for n in one["nodes"]], one["raw"], one["spaced"], one["tight"]) == (other["nodes"], other["raw"], other["spaced"], other["tight"])


def test_marks_are_worked_out_once_for_a_kind_of_tag():
    """Not for every element of every page, as expressions over nodes were."""
    asked = []
    pages = ['<div class="product-card"><a href="/p/1">one</a></div>' * 5] * 100
    got = nodes.read_marked(pages, lambda tag, attrs: asked.append(tag) or (1, 2, 4)).to_pylist()
    assert len(asked) <= 2 and [n["marks"] for n in got[99]["nodes"]] == [1, 7] * 5
