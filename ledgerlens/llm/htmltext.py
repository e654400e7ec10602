"""Main text of web pages by a tree-structured graphical model over their DOM.

Every block element (and every inline one with a class, id or role) is a node with a hidden label: main text or not. Its
own looks give a unary potential, each parent-child edge a 2 x 2 potential that depends on the child's kind, and
sum-product messages, upward from the leaves and then downward from the roots, give each node's exact marginal. Text
belongs to the node it stands in and is kept where the marginal reaches one half. Weights are trained by the gradient of
the labelled pages' likelihood, which the same messages provide (``label_pages.py`` holds the pages; they are a
parameter, and few, so they are trained on the driver).

Elements that never show text (head, script, style, template and the like) hold no nodes. A tag that is not closed ends
with its parent or where its kind cannot go on; a tag or comment that never ends is dropped. A null or empty page, or
one without main text, gives the empty text. Rows that repeat an id are pages of their own; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import rows

#: Raw text runs to the end tag of these; the other silent ones are parsed, but hold no nodes.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
SILENT = {"head", "template", "svg", "math", "noscript", "select", "button", "object", "audio", "video", "canvas", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "html body main article section div header footer nav aside form fieldset p pre blockquote address h1 h2 h3 h4 h5 h6 ul ol li "
    "dl dt dd menu table caption thead tbody tfoot tr td th figure figcaption details summary dialog center".split())
#: An open element of the first kind ends when one of the second starts, unless one of the third lies in between.
ENDS = {
    "p": (BLOCK - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"} | {"hr"}, {"table", "td", "th", "caption"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot", "thead"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "tfoot", "thead"}, {"table"}),
    "tr": ({"tr", "tbody", "tfoot", "thead"}, {"table"}),
    "head": (BLOCK - {"html"}, set()),
}
STARTERS = {starter: [e for e in ENDS if starter in ENDS[e][0]] for starter in BLOCK | {"hr"}}

NAME = r"([a-zA-Z][^\s/<>]*+)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>|<(/?)" + NAME + r"((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)" + NAME + r"([^>]*+)>", re.S)
UNENDED = re.compile(r"<[a-zA-Z!?/]")  # after the last ">": a tag that never ends
ATTRIBUTE = re.compile(r"""([^\s"'=/<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: What the tag and the words of a class, id or role say about an element. Weights are learned; the lists only group the words.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip toolbar links",
    "header": "header masthead banner topbar logo branding hero",
    "footer": "footer copyright legal colophon contentinfo imprint",
    "side": "sidebar aside side rail widget related recommended more teaser teasers complementary trending popular",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast message warning dialog paywall",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners dfp outbrain taboola",
    "form": "form search newsletter subscribe signup login share sharing social feedback contact",
    "comment": "comment comments reply replies respond discussion disqus thread responses reader readers",
    "meta": "meta byline author date tags tag category categories info details caption credit",
    "content": "content article post entry story main body text prose page copy",
}
CUE_OF = {}
for _cue, _words in CUES.items():
    for _word in _words.split():
        CUE_OF.setdefault(_word, []).append(_cue)
TAGS = sorted(BLOCK)
KINDS = {"container": "html body main article section div td th center details dialog table tbody thead tr fieldset ul ol dl menu figure",
         "heading": "h1 h2 h3 h4 h5 h6 caption summary dt",
         "text": "p pre blockquote li dd figcaption address",
         "frame": "header footer nav aside form"}
KIND_OF = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
N_KINDS = len(KINDS) + 1  # the last: inline elements
NAMES = (
    ["bias"] + [f"tag {t}" for t in TAGS] + ["tag inline"] + [f"cue {c}" for c in CUES] + ["hidden", "rights"]
    + [f"own words {b}" for b in range(5)] + [f"own links {b}" for b in range(3)] + [f"all words {b}" for b in range(5)]
    + [f"all links {b}" for b in range(4)] + ["sentence", "no sentence"])
INDEX = {name: i for i, name in enumerate(NAMES)}
OWN_WORDS, OWN_LINKS, ALL_WORDS, ALL_LINKS = (INDEX[f"{x} 0"] for x in ("own words", "own links", "all words", "all links"))


@dataclass
class Page:
    """The nodes of a page in document order (a parent before its children) and its text in pieces."""

    parent: list[int] = field(default_factory=list)  # -1 above the top
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)  # node (-1: none), text, inside a link


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


def parse(text: str | None) -> Page:
    """The nodes and pieces of a page, in time linear in its length."""
    page = Page()
    text = text or ""
    stack: list[tuple[str, int, bool]] = []  # tag, its node (or the one it lies in), silent
    at: dict[str, list[int]] = {}  # places of the open elements of each tag
    blocks: list[int] = []  # places of the open block elements
    links = 0
    end_tags: dict[str, int] = {}

    def pop_to(place: int) -> None:
        nonlocal links
        while len(stack) > place:
            tag = stack.pop()[0]
            at[tag].pop()
            if tag == "a":
                links -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    def add(piece: str) -> None:
        if piece and not (stack and stack[-1][2]):
            page.pieces.append((stack[-1][1] if stack else -1, piece, links > 0))

    pos, stop = 0, len(text)
    last = text.rfind(">") + 1
    while pos < stop:
        token = TOKEN.search(text, pos, last) if pos < last else None
        begin = token.start() if token else stop
        if token is None:
            tail = UNENDED.search(text, pos)
            begin = tail.start() if tail else stop
        if begin > pos:
            add(text[pos:begin])
        if token is None:
            break
        pos = token.end()
        name = token[2] or token[5]
        if not name:
            continue
        name = name.lower()
        if token[1] or token[4]:  # an end tag
            open_at = at.get(name)
            if open_at and (name in BLOCK or name in SILENT or not blocks or open_at[-1] > blocks[-1]):
                if name in BLOCK:
                    add(" ")
                pop_to(open_at[-1])
                if name in BLOCK:
                    add(" ")
            continue
        if name in RAW:
            closing = end_tags.get(name, 0)
            if closing >= 0 and closing < pos:
                found = re.compile(rf"</{name}\b", re.I).search(text, pos)
                closing = end_tags[name] = found.start() if found else -1
            if closing < 0:
                break  # never closed: nothing after it is text
            pos = closing
            continue
        if name in VOID:
            if name in ("br", "hr"):
                add(" ")
            if name not in STARTERS:
                continue
        for open_tag in STARTERS.get(name, ()):
            if at.get(open_tag):
                place = at[open_tag][-1]
                if all(not at.get(b) or at[b][-1] < place for b in ENDS[open_tag][1]):
                    pop_to(place)
        if name in VOID:
            continue
        given = attributes(token[3] or token[6] or "")
        above = stack[-1] if stack else ("", -1, False)
        silent = above[2] or name in SILENT
        node = above[1]
        if not silent and (name in BLOCK or given.keys() & {"class", "id", "role", "hidden", "aria-hidden"}):
            page.parent.append(node)
            page.depth.append(page.depth[node] + 1 if node >= 0 else 0)
            page.tag.append(name if name in BLOCK else "inline")
            page.attributes.append(given)
            node = len(page.parent) - 1
        if name in BLOCK:
            add(" ")
            blocks.append(len(stack))
        at.setdefault(name, []).append(len(stack))
        stack.append((name, node, silent))
        links += name == "a"
        if name in BLOCK:
            add(" ")
    page.pieces = [(node, html.unescape(piece), link) for node, piece, link in page.pieces]
    return page


@lru_cache(1 << 16)
def looks(tag: str, named: str, hidden: bool) -> tuple[int, ...]:
    """The features that a tag and the words of its class, id and role give."""
    cues = {c for w in WORD_PARTS.findall(named) for c in CUE_OF.get(w.lower(), ())}
    return tuple(INDEX[f] for f in ("bias", f"tag {tag}", *(f"cue {c}" for c in sorted(cues)), *(["hidden"] if hidden else [])))


def features(page: Page) -> list[list[int]]:
    """The features of each node, as numbers of NAMES: its tag, the words of its class, its text and links."""
    n = len(page.parent)
    own, linked, sentence, rights = [0] * n, [0] * n, [False] * n, [False] * n
    for node, piece, link in page.pieces:
        if node >= 0 and not piece.isspace():
            words = len(piece.split())
            own[node] += words
            linked[node] += words if link else 0
            sentence[node] |= piece.rstrip().endswith((".", "!", "?", "…", "。", ":", ";", "»", "”", '"'))
            rights[node] |= "©" in piece or "rights reserved" in piece.lower()
    words, links = list(own), list(linked)
    for node in range(n - 1, -1, -1):
        if page.parent[node] >= 0:
            words[page.parent[node]] += words[node]
            links[page.parent[node]] += links[node]
    out = []
    for node in range(n):
        given = page.attributes[node]
        named = " ".join([page.tag[node], *(given[k] for k in ("class", "id", "role", "itemprop") if k in given)])
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")) is not None
        f = [*looks(page.tag[node], named, hidden), OWN_WORDS + bisect((1, 4, 10, 30), own[node]), ALL_WORDS + bisect((1, 10, 50, 200), words[node])]
        if rights[node]:
            f.append(INDEX["rights"])
        if own[node]:
            f += [OWN_LINKS + bisect((0.01, 0.6), linked[node] / own[node]), INDEX["sentence" if sentence[node] else "no sentence"]]
        if words[node]:
            f.append(ALL_LINKS + bisect((0.01, 0.25, 0.6), links[node] / words[node]))
        out.append(f)
    return out


@dataclass
class Forest:
    """The nodes of several pages, one after the other."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    flat: np.ndarray  # features of all nodes ...
    start: np.ndarray  # ... from where each node's begin


def forest(pages: list[Page]) -> Forest:
    parent, depth, kind, flat, start, base = [], [], [], [], [], 0
    for page in pages:
        parent += [p + base if p >= 0 else -1 for p in page.parent]
        depth += page.depth
        kind += [KIND_OF.get(t, N_KINDS - 1) for t in page.tag]
        for f in features(page):
            start.append(len(flat))
            flat += f
        base += len(page.parent)
    return Forest(*(np.array(x, np.int64) for x in (parent, depth, kind, flat, start)))


def _sum_out(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis=axis, keepdims=True)
    return (high + np.log(np.exp(x - high).sum(axis=axis, keepdims=True))).squeeze(axis)


def sum_product(trees: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of label 1 of each node, joint of (parent's, own) label of each node that has a parent).

    ``unary`` [nodes, 2] and ``edge`` [kinds, parent's label, own label] are log potentials. All pages pass their
    messages together, a level of depth at a time: upward from the deepest, then downward.
    """
    n = len(trees.parent)
    below = unary.copy()  # own potential and the messages of all children
    up, above = np.zeros((n, 2)), np.zeros((n, 2))
    order = np.argsort(trees.depth, kind="stable")
    cuts = np.searchsorted(trees.depth[order], np.arange(1, (trees.depth.max() if n else 0) + 2))
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]  # without the tops
    for nodes in reversed(levels):
        up[nodes] = _sum_out(edge[trees.kind[nodes]] + below[nodes][:, None, :], 2)
        np.add.at(below, trees.parent[nodes], up[nodes])
    joint = np.zeros((n, 2, 2))
    for nodes in levels:
        rest = below[trees.parent[nodes]] + above[trees.parent[nodes]] - up[nodes]
        pair = edge[trees.kind[nodes]] + rest[:, :, None]
        above[nodes] = _sum_out(pair, 1)
        pair = pair + below[nodes][:, None, :]
        joint[nodes] = np.exp(pair - _sum_out(pair.reshape(-1, 4), 1)[:, None, None])
    belief = below + above
    return np.exp(belief[:, 1] - _sum_out(belief, 1)), joint


def unary_potentials(trees: Forest, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(trees.parent), 2))
    if len(out):
        out[:, 1] = np.add.reduceat(weights[trees.flat], trees.start)
    return out


def node_labels(page: Page) -> np.ndarray:
    """Labels of a labelled page: a node has that of its ``data-main`` attribute or else its parent's; 0 at the top."""
    out = np.zeros(len(page.parent), np.int64)
    for node, given in enumerate(page.attributes):
        out[node] = int(given["data-main"]) if "data-main" in given else out[page.parent[node]] if page.parent[node] >= 0 else 0
    return out


def train(labelled: list[str], rounds: int = 400, rate: float = 0.1, prior: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features, edge potentials) that make the labels most likely, with a Gaussian prior."""
    pages = [parse(p) for p in labelled]
    trees, truth = forest(pages), np.concatenate([node_labels(p) for p in pages])
    weights, edge = np.zeros(len(NAMES)), np.zeros((N_KINDS, 2, 2))
    inner = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros_like(edge)
    np.add.at(seen, (trees.kind[inner], truth[trees.parent[inner]], truth[inner]), 1)
    per_node = np.diff(np.append(trees.start, len(trees.flat)))
    theta = np.concatenate([weights, edge.ravel()])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, edge = theta[:len(NAMES)], theta[len(NAMES):].reshape(edge.shape)
        marginal, joint = sum_product(trees, unary_potentials(trees, weights), edge)
        by_feature = np.bincount(trees.flat, np.repeat(truth - marginal, per_node), len(NAMES))
        expected = np.zeros_like(edge)
        np.add.at(expected, trees.kind[inner], joint[inner])
        slope = np.concatenate([by_feature, (seen - expected).ravel()]) - prior * len(pages) * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2  # steps by their own running size
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:len(NAMES)], theta[len(NAMES):].reshape(edge.shape)


def extract_pages(texts: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page: kept pieces in page order, white space as one space."""
    pages = [parse(t) for t in texts]
    trees = forest(pages)
    marginal, _ = sum_product(trees, unary_potentials(trees, model[0]), model[1])
    out, base = [], 0
    for page in pages:
        kept = marginal[base:base + len(page.parent)] >= 0.5
        base += len(page.parent)
        out.append(" ".join("".join(piece if node >= 0 and kept[node] else " " if piece == " " else "" for node, piece, _ in page.pieces).split()))
    return out


def main_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    from ledgerlens.llm.label_pages import labelled_pages

    model = train(labelled if labelled is not None else labelled_pages())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, texts in rows(batches):
            text = extract_pages(texts, model)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
