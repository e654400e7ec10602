"""Source divergence, main text of pages, ranked lexical search: against brute force and on odd inputs."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import divergence, htmltext, lexical
from ledgerlens.llm.label_pages import labelled_pages

DOCS = "doc_id long, text string, lang string, source string, term string, value int, df int, n long"
LONG = "harbour " * 40_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, "x", 1, 2, 3) for i, (t, l, s) in enumerate(rows)], DOCS)


def brute_audit(rows):
    rows = [tuple(x or "" for x in r) for r in rows]
    term = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(term(t), s) for t, l, s in rows if l == lang]
        df = Counter(w for ws, _ in mine for w in set(ws))
        kept = [w for w in df if df[w] >= 3]
        uses = defaultdict(Counter)
        for ws, s in mine:
            uses[s].update(w for w in ws if df[w] >= 3)
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        whole = sum(uses.values(), Counter())
        for s in uses:
            pairs = [(o, sum((share(uses[s], w) - share(uses[o], w)) ** 2 // share(uses[o], w) for w in kept)) for o in uses if o != s]
            marks = [(w, (share(uses[s], w) - share(whole, w)) ** 2 // share(whole, w)) for w in kept if uses[s][w] and share(uses[s], w) > share(whole, w)]
            for part, found, top in (("pair", pairs, None), ("term", marks, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, r) for r, (item, value) in enumerate(found[:top], 1)}
    return out


def audited(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(df).collect()]


def test_divergence_equals_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "é", "ß", "İx", "A1b", "naïve", "日本"]
    some = [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(40)]
    rows = [(r.choice(some), r.choice(["en", "fr", "", None]), r.choice(["a", "b", "c", "é", "", None])) for _ in range(300)]
    rows += [(some[0], "en", "hot")] * 200 + [(None, "en", "silent"), ("", "xx", "only"), ("1 2 3", "yy", "p"), ("one", "yy", "q"), (LONG, "en", "a")]
    want = brute_audit(rows)
    got = audited(docs(spark, rows).repartition(7))
    assert len(got) == len(want) and set(got) == want
    assert ("yy", "p", "pair", "q", 0, 1) in want  # no kept term: pairs of value 0
    monkeypatch.setattr(divergence, "SOURCES", 2)  # a text's sources go two at a time; sums of a task are handed on at once
    monkeypatch.setattr(divergence, "HELD", 3)
    assert set(audited(docs(spark, rows))) == want


def test_divergence_of_an_empty_table(spark):
    assert audited(docs(spark, [])) == []


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute_search(rows, items, k=10):
    read = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, length = sum(bool(c) for _, c in read), sum(sum(c.values()) for _, c in read)
    df = Counter(w for _, c in read for w in c)
    out = {}
    for item in {i for i, _ in items}:
        wanted = Counter(w for t in {t for i, t in items if i == item} for w in terms(t))
        scored = []
        for doc, c in read:
            m = 25 + 75 * sum(c.values()) * n_docs // length if length else 0
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                    for w, times in wanted.items() if c[w])
            if s > 0:
                scored.append((-s, doc is None, doc))
        if scored:
            out[item] = [(d, -s) for s, _, d in sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


def searched(spark, rows, items, k=10):
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, score int, rank int, item_id string").repartition(5)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    got = defaultdict(list)
    for r in sorted(lexical.search(d, q, k).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r["rank"])):
        assert r["rank"] == len(got[r.item_id]) + 1
        got[r.item_id].append((r.doc_id, r.score))
    return dict(got)


WORDS = ["the", "The", "a", "aa", "b", "ab", "é", "É", "\x85x", "x\xa0y", "日本語", "本", "9", "99", "_", "-", "K", "İ"]


def test_search_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: r.choice(["", " ", "\n"]) + r.choice([" ", "-", ", ", "_"]).join(r.choices(WORDS, k=r.randint(0, n)))
    rows = [(i, text(30)) for i in range(150)] + [(7, "the the"), (7, "the the"), (None, "the ab"), (None, None), (200, ""), (201, LONG + " rare"), (202, "rare")]
    rows += [(300 + i, "same words here") for i in range(15)]
    items = [(i, text(12)) for i in range(12)] + [(20, "rare rare THE"), (21, "same"), (21, "same"), (21, "same words"), (22, None), (23, "unseen"), (None, "ab 99"), (24, "harbour")]
    want = brute_search(rows, items)
    assert searched(spark, rows, items) == want
    assert [d for d, _ in want[21]] == list(range(300, 310))  # equal scores by id
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 4)  # many blocks, short pieces of texts
    monkeypatch.setattr(lexical, "CHUNK", 3)
    assert searched(spark, rows[:60] + rows[-20:-14], items) == brute_search(rows[:60] + rows[-20:-14], items)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == {} and searched(spark, [(1, "a")], []) == {} and searched(spark, [(1, None)], [(1, "a")]) == {}


@pytest.fixture(scope="module")
def model():
    return htmltext.train(labelled_pages())


def test_messages_give_exact_marginals_and_joints():
    r = np.random.default_rng(2)
    for n in (1, 2, 6, 9):
        parent = np.array([-1] + [int(r.integers(0, i)) for i in range(1, n)])
        parent[n // 2:n // 2 + 1] = -1  # two trees
        depth = np.zeros(n, np.int64)
        for i in range(n):
            depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
        kind = r.integers(0, htmltext.N_KINDS, n)
        unary, edge = r.normal(size=(n, 2)) * 2, r.normal(size=(htmltext.N_KINDS, 2, 2)) * 2
        trees = htmltext.Forest(parent, depth, kind, np.zeros(0, np.int64), np.zeros(0, np.int64))
        total, ones, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(unary[i, y[i]] + (edge[kind[i], y[parent[i]], y[i]] if parent[i] >= 0 else 0) for i in range(n)))
            total += w
            for i in range(n):
                ones[i] += w * y[i]
                if parent[i] >= 0:
                    joint[i, y[parent[i]], y[i]] += w
        got, pairs = htmltext.sum_product(trees, unary, edge)
        assert np.allclose(got, ones / total) and np.allclose(pairs[parent >= 0], joint[parent >= 0] / total)


#: Pages unlike the labelled ones, with their main text.
UNSEEN = [
    ("<html><body><div class=topNav><a href=1>Home</a> <a href=2>News</a></div><div class='articleBody'><h1>Rain &amp; wind</h1><p>It rained.<p>Then\n\n it&nbsp;stopped, <i>sud</i>denly.</div>"
     "<div class=readerComments><p>I like rain very much, thank you.</p></div><footer><p>&copy; 2020 Weather. All rights reserved.</p></footer>",
     "Rain & wind It rained. Then it stopped, suddenly."),
    ("<body><header><h2>My site</h2></header><main><article><h1>Stones</h1><p>Some stones are grey. Others are red.</p><ul><li>Granite is hard.</li><li>Chalk is soft.</li></ul>"
     "<div class='advertisement'>Buy stones now, they are cheap.</div><p>The end.</p></article></main><aside><h3>Related</h3><ul><li><a href=/a>Trees</a></li></ul></aside></body>",
     "Stones Some stones are grey. Others are red. Granite is hard. Chalk is soft. The end."),
    ("<div id='cookieConsent'><p>We use cookies to make this site better. Do you agree?</p></div><div><div><h1>On boats</h1><p>Boats float on water, which is what they are made for, and have done so ever since."
     " A boat that does not float is a wreck.</p><p>Most boats are small.</p></div></div><form><p>Write to us:</p><input></form>",
     "On boats Boats float on water, which is what they are made for, and have done so ever since. A boat that does not float is a wreck. Most boats are small."),
]


def test_unseen_layouts(model):
    assert htmltext.extract_pages([h for h, _ in UNSEEN], model) == [t for _, t in UNSEEN]


def test_held_out_layouts(model):
    """Trained without one in five of the labelled pages, the labels of those are found."""
    pages = labelled_pages()
    weights, edge = htmltext.train([p for i, p in enumerate(pages) if i % 5])
    held = [htmltext.parse(p) for i, p in enumerate(pages) if i % 5 == 0]
    trees = htmltext.forest(held)
    marginal, _ = htmltext.sum_product(trees, htmltext.unary_potentials(trees, weights), edge)
    truth = np.concatenate([htmltext.node_labels(p) for p in held])
    assert ((marginal >= 0.5) == truth).mean() > 0.97


def test_odd_markup(model):
    body = "<article><p>Plain words stand here, and more of them.</p>{}</article>"
    plain = "Plain words stand here, and more of them."
    cases = {
        None: "", "": "", "<": "", "just words": "", "<p": "", "<!-- x": "", "<script>": "",
        body.format("<script>if (a < b) { x = '</p>' }</script>"): plain,
        body.format("<!-- <p>no</p> -->"): plain,
        body.format("<p title='a > b'>Second &lt;one&gt; &#65;&#x42;.</p>"): plain + " Second <one> AB.",
        body.format("<p>a < b and c<br>d</p>"): plain + " a < b and c d",
        body.format("<textarea>no</textarea><svg><text>no</text></svg><noscript>no</noscript>"): plain,
        body.format("<p>cut <a href='x"): plain + " cut",
        body.format("</div></span></li><p>Kept.</p>"): plain + " Kept.",
    }
    assert dict(zip(cases, htmltext.extract_pages(list(cases), model))) == cases


def test_long_and_deep_pages_take_linear_time(model):
    deep = "<article>" + "<div><b>" * 20_000 + "<p>Deep down there are words.</p>"
    many = "<article>" + "<p>Words stand here. " * 30_000
    quotes = "<article><p>Words stand here, a lot.</p>" + "<a title=\"" * 20_001
    ends = "<article><p>Words stand here, a lot.</p>" + "<i>" * 5000 + "</b>" * 50_000 + "<textarea" * 20_000
    got = htmltext.extract_pages([deep, many, quotes, ends], model)
    assert got[1] == " ".join(["Words stand here."] * 30_000) and got[2] == got[3] == "Words stand here, a lot."


def test_pages_of_the_table(spark, model):
    """The template of the given pages, undone by hand, for every page."""
    import html

    from conftest import SF

    def by_hand(page):
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1)>|<br>", " ", inside))).split())

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in htmltext.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id] == (r.url, by_hand(r.html), len(by_hand(r.html)))


def test_page_rows_are_kept(spark):
    rows = [(1, "u", None, "t", 5), (1, "u", "", "t", 5), (None, None, "<article><h1>Title</h1><p>It is a text.</p></article>", "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, htmltext.main_text(df).collect()), key=str)
    assert got == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "Title It is a text.", 19)]
    assert htmltext.main_text(df.limit(0)).collect() == []
