"""Main text of web pages: gradient-boosted trees over DOM-node features with hierarchical decoding.

A page is cut into tags and text and built into a tree of its block-level elements (end tags may be missing, elements may
overlap, the page may break off anywhere). Every element gets features: its tag, tokens of its class, id and role
attributes and those of its ancestors (words on containers of the main text and words for a state do not count against it), depth, text and link density of itself and its subtree, share of the page's text,
and how it compares with its siblings. Boosted trees, trained on the driver on ``N_PAGES`` generated pages whose main text
is known (see ``html_pages``), give each element the log-odds of holding main text.

Decoding chooses keep or drop for all elements at once: an element is kept only under kept elements, and of all such
choices the one with the largest summed log-odds is taken, worked out from the leaves up. So no descendant contradicts an
ancestor. Text of kept elements is returned in page order: character references decoded, white space in a block made one
space, blocks joined by an empty line. Scripts, styles, templates, form controls and the head never give text.

Null and empty pages, and pages without text, give the empty string. Very long pages are read whole. Repeated rows get the
same text; where keeping and dropping weigh the same, an element is dropped; empty tables give no rows; only the columns named are read, and ``carry`` columns come back unchanged.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import short_batches, worker_state

N_PAGES = 1000

# Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style template noscript iframe svg math select button textarea object video audio canvas head title datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption label".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption label li dd dt legend summary figcaption".split()) | {"hr"}
# What an open element is ended by, and how far up that reaches.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
# Attribute words that name main text and the parts around it.
GOOD_WORDS = frozenset("article content post entry main story body text page blog news hentry prose".split())
BAD_WORDS = {
    "nav": frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs toc skip".split()),
    "ad": frozenset("ad ads advert advertisement adsense sponsor sponsored promo promotion banner commercial".split()),
    "notice": frozenset("cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription gdpr disclaimer message toast".split()),
    "side": frozenset("sidebar side aside widget related recommended recommendations popular trending tags teaser more share sharing social rail".split()),
    "comment": frozenset("comment comments reply replies respond disqus discussion feedback reviews responses commentlist".split()),
    "form": frozenset("form login signup search register contact".split()),
    "edge": frozenset("footer foot copyright legal bottom header head top masthead colophon credits imprint".split()),
}
# Words that make a class name say what state a page or container is in, not what it is.
STATE_WORDS = frozenset("has no with without is not off on open opened closed hidden hide visible show shown enabled disabled active inactive allowed collapsed expanded layout".split())
# HTML elements that end svg and math content when they start in it, and the elements in it that hold HTML.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_TAGS = ("p", "h1", "h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "div", "section", "article main", "nav", "aside", "header", "footer", "form fieldset label", "blockquote pre figure figcaption", "table tr td th tbody thead")
_TAG_NO = {t: i for i, group in enumerate(_TAGS) for t in group.split()}
_WORD = re.compile(r"[a-z]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


# ---- tree -------------------------------------------------------------------------------------------------------------
@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    #: The tokens of every class, id and role name, name by name.
    names: tuple[tuple[str, ...], ...] = ()
    chars: int = 0
    link_chars: int = 0
    links: int = 0
    kids: list[int] = field(default_factory=list)


class Tree:
    """Block-level elements in page order and the text segments between their boundaries."""

    def __init__(self, page: str):
        self.nodes = [Node("html", -1, 0)]
        self.segments: list[tuple[int, str]] = []
        #: (tag, number of the block-level element that is current inside it)
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.held: list[str] = []
        self.held_chars = 0
        self.dropped = 0
        #: How many elements of a tag are open.
        self.open: Counter = Counter()
        #: By depth of an open anchor on the stack, the characters held when it began.
        self.began: dict[int, int] = {}
        self._read(page)
        self._flush()

    def _read(self, page: str) -> None:
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if end:
                self._end(tag)
                continue
            foreign = self.open["svg"] + self.open["math"]
            if attrs.endswith("/") and (foreign or tag in ("svg", "math")):
                continue  # only in svg and math does a slash end an element
            self._start(tag, attrs)
            if tag in RAW and not foreign:
                close = re.compile(f"</{tag}", re.I).search(page, at)
                at = close.start() if close else len(page)
        if at < len(page):
            self._text(page[at:])

    def _text(self, text: str) -> None:
        if not self.dropped:
            self._hold(text)

    def _hold(self, text: str) -> None:
        self.held.append(text)
        self.held_chars += len(text)

    def _flush(self) -> None:
        if not self.held:
            return
        text = " ".join(html.unescape("".join(self.held)).split())
        self.held, self.held_chars = [], 0
        if text:
            n = self.stack[-1][1]
            node = self.nodes[n]
            node.chars += len(text)
            self.segments.append((n, text))

    def _push(self, tag: str, attrs: str) -> None:
        n = self.stack[-1][1]
        if tag in BLOCK:
            self._flush()
            names: tuple[tuple[str, ...], ...] = ()
            if attrs and not attrs.isspace():
                values = (value.strip("\"'") for name, value in _ATTR.findall(attrs) if name.lower() in ("class", "id", "role"))
                names = tuple(tuple(_WORD.findall(_CAMEL.sub(" ", name).lower())) for value in values for name in value.split())
            self.nodes.append(Node(tag, n, self.nodes[n].depth + 1, names))
            self.nodes[n].kids.append(len(self.nodes) - 1)
            n = len(self.nodes) - 1
        elif tag == "a":
            self.nodes[n].links += 1
        if tag in NO_TEXT:
            self.dropped += 1
        self.stack.append((tag, n))
        self.open[tag] += 1

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _ = self.stack[-1]
            if tag in BLOCK:
                self._flush()
            if tag in NO_TEXT:
                self.dropped -= 1
            if tag == "a":
                self.nodes[self.stack[-1][1]].link_chars += max(0, self.held_chars - self.began.pop(len(self.stack) - 1, 0))
            self.stack.pop()
            self.open[tag] -= 1

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BREAKS_OUT and (self.open["svg"] or self.open["math"]):
            top = next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] in ("svg", "math"))
            if not any(t in HOLDS_HTML for t, _ in self.stack[top + 1 :]):
                self._pop_to(top)
        if tag == "br":
            self._hold(" ")
            return
        if tag == "html" or tag == "body" and self.open[tag]:
            return
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag == "body" or tag in BLOCK and self.stack[-1][0] == "head":
            self._close({"head"}, set())
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag == "a":
            self.began[len(self.stack)] = self.held_chars
        self._push(tag, attrs)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Ends the outermost open element of ``tags`` above the nearest of ``stop``."""
        if not any(self.open[t] for t in tags):
            return
        cut = 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in stop:
                break
            if self.stack[i][0] in tags:
                cut = i
        if cut:
            self._pop_to(cut)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._hold(" ")
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[i][0]
            if open_tag == tag:
                self._pop_to(i)
                return
            if tag not in BLOCK and tag not in NO_TEXT and open_tag in BLOCK:
                return  # an inline end tag doesn't end a block


# ---- features ---------------------------------------------------------------------------------------------------------
_NO_FLAGS = [False] * len(BAD_WORDS)


def _named(node: Node) -> tuple[list[bool], bool, bool]:
    """What an element's names say: kinds of parts around the main text, main text (by a name of its own), some state.

    Names of the page as a whole say nothing, and names of a state (``has-comments``, ``sidebar-off``) nothing else.
    """
    if not node.names or node.tag in ("html", "body"):
        return _NO_FLAGS, False, False
    bad, good, state = set(), False, False
    for name in node.names:
        if not STATE_WORDS.isdisjoint(name):
            state = True
            continue
        found = [k for k, v in BAD_WORDS.items() if not v.isdisjoint(name)]
        bad.update(found)
        good |= not found and not GOOD_WORDS.isdisjoint(name)
    return [k in bad for k in BAD_WORDS], good, state


def node_features(tree: Tree) -> np.ndarray:
    """One row of features to a block-level element."""
    nodes = tree.nodes
    n = len(nodes)
    own = np.array([x.chars for x in nodes], float)
    link = np.minimum(np.array([x.link_chars for x in nodes], float), own)
    links = np.array([x.links for x in nodes], float)
    size, all_text, all_link, all_links = np.ones(n), own.copy(), link.copy(), links.copy()
    parent = np.array([x.parent for x in nodes])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        all_text[p] += all_text[i]
        all_link[p] += all_link[i]
        all_links[p] += all_links[i]
    total = max(1.0, all_text[0])
    tag = np.zeros((n, len(_TAGS) + 1))
    above_tag = np.zeros((n, len(_TAGS) + 1))
    bad = np.zeros((n, len(BAD_WORDS)))
    above_bad = np.zeros((n, len(BAD_WORDS)))
    good, above_good, mixed = np.zeros(n), np.zeros(n), np.zeros(n)
    named = [_named(x) for x in nodes]
    # elements with an article or main element below them that no name speaks against
    holds_main = np.zeros(n, bool)
    for i in range(n - 1, 0, -1):
        if holds_main[i] or nodes[i].tag in ("article", "main") and not any(named[i][0]):
            holds_main[parent[i]] = True
    place, same, before, after = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    up = np.maximum(parent, 0)
    for i, x in enumerate(nodes):
        tag[i, _TAG_NO.get(x.tag, len(_TAGS))] = 1
        flags, good[i], mixed[i] = named[i]
        if any(flags):
            # A word weighs nothing against a container of the main text: it neither marks the element nor goes down.
            if holds_main[i] or good[i] and all_text[i] > 0.5 * total:
                mixed[i] = 1
            else:
                bad[i] = flags
        if i:
            p = x.parent
            above_tag[i] = np.maximum(above_tag[p], tag[p])
            above_bad[i] = np.maximum(above_bad[p], bad[p])
            above_good[i] = max(above_good[p], good[p])
        k = x.kids
        if k:
            texts = all_text[k]
            place[k] = (np.arange(len(k)) + 0.5) / len(k)
            before[k[1:]] = texts[:-1]
            after[k[:-1]] = texts[1:]
            names = [nodes[c].tag for c in k]
            times = Counter(names)
            same[k] = [times[t] for t in names]
    depth = np.array([x.depth for x in nodes], float)
    kids = np.array([len(x.kids) for x in nodes], float)
    columns = [depth, np.minimum(kids, 20), np.minimum(np.log1p(own), 6), np.minimum(np.log1p(all_text), 8), np.minimum(np.log1p(size), 4), all_text / total, np.minimum(all_text / size, 500), all_link / np.maximum(1, all_text), all_links / size, own / np.maximum(1, all_text), np.minimum(np.log1p(before), 6), np.minimum(np.log1p(after), 6), place, np.minimum(same, 12), all_text / np.maximum(1, all_text[up]), all_text[up] / total, all_link[up] / np.maximum(1, all_text[up]), good, above_good, mixed]
    return np.column_stack([*columns, tag, above_tag, bad, above_bad])


# ---- trees ------------------------------------------------------------------------------------------------------------
@dataclass
class Boosted:
    """Complete binary trees of one depth: feature and threshold of every inner node, value of every leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24) -> Boosted:
    """Logistic gradient boosting with second-order gains over quantile bins; deterministic."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    width, n_features = bins + 1, x.shape[1]
    rate0 = float(np.clip(y.mean(), 0.01, 0.99))
    base = np.log(rate0 / (1 - rate0))
    score = np.full(len(y), base)
    features, thresholds, values = [], [], []
    offsets = np.arange(n_features) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(len(y), np.int64)
        for node in range(2**depth - 1):
            rows = np.flatnonzero(at == node)
            left = np.ones(len(rows), bool)
            if len(rows) >= 20:
                flat = (binned[rows] + offsets).ravel()
                gs = np.bincount(flat, np.repeat(g[rows], n_features), n_features * width).reshape(n_features, width).cumsum(axis=1)
                hs = np.bincount(flat, np.repeat(h[rows], n_features), n_features * width).reshape(n_features, width).cumsum(axis=1)
                gt, ht = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 4) | (ht - hs < 4)] = 0
                j, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, c] > 1e-6 and c < len(cuts[j]):
                    f[node], t[node] = j, cuts[j][c]
                    left = x[rows, j] <= t[node]
            at[rows] = 2 * node + 1 + ~left
        leaf = at - (2**depth - 1)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        score += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Boosted(np.array(features), np.array(thresholds), np.array(values), float(base))


@lru_cache(maxsize=1)
def trained() -> Boosted:
    """The trees of the ``N_PAGES`` generated pages, fitted once in a driver."""
    return train()


def train(pages: list[tuple[str, str]] | None = None) -> Boosted:
    """Learns from (html, marker) pages: an element holds main text if a segment under it holds the marker word."""
    from tessella.llm.html_pages import labelled_pages

    xs, ys = [], []
    for page, marker in pages or labelled_pages(N_PAGES):
        tree = Tree(page)
        y = np.zeros(len(tree.nodes))
        for n, text in tree.segments:
            if marker in text:
                while n >= 0 and not y[n]:
                    y[n] = 1
                    n = tree.nodes[n].parent
        xs.append(node_features(tree))
        ys.append(y)
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """Keep or drop for every element: nothing is kept under a dropped one, and the summed log-odds are largest."""
    keep, drop = odds.copy(), -odds
    parent = [x.parent for x in tree.nodes]
    for i in range(len(parent) - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = np.zeros(len(parent), bool)
    out[0] = True
    for i in range(1, len(parent)):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


def main_texts(pages: list[str], model: Boosted) -> list[str]:
    trees = [Tree(p) for p in pages]
    if not trees:
        return []
    rows = [node_features(t) for t in trees]
    odds = np.split(model.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
    return ["\n\n".join(text for n, text in t.segments if kept[n]) for t, kept in ((t, decode(t, o)) for t, o in zip(trees, odds))]


def extract(pages: DataFrame, model: Boosted | None = None, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns and ``text`` of every page."""
    model = model or trained()
    shared = pages.sparkSession.sparkContext.broadcast(model)
    short_batches(pages.sparkSession)
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{html_col}`").alias("page"))
    schema = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("html_extract")
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = main_texts([p or "" for p in part.column(len(carry)).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carry))), pa.array(texts, pa.string())], [*(f"c{i}" for i in range(len(carry))), "text"])

    return rows.mapInArrow(run, f"{schema}, text string").toDF(*carry, "text")
