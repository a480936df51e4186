"""Main text of pages by a graphical model on the document's tree.

Each element has a hidden state, content or not. Unary potentials come from a logistic regression over what the element
shows (tag, words of class, id and role, share of linked text, words, sentence ends); pairwise potentials join an element
with its parent, by whether the element is a block. Sum-product messages go upward and downward once, which is exact on a
tree, and give each element's marginal. Text belongs to its nearest element; it is kept if that marginal is over a half.
Scripts, styles, comments, forms' fields and the head are no text.

Both potentials are trained on labelled pages: a seeded generator writes pages of many layouts with a label for each
element. The number of training pages is a documented parameter; nothing is learned from the pages to be extracted.

Defined results: null or empty html gives an empty text; a page cut off anywhere is read as far as it goes (an unfinished
tag at its end is dropped); a quoted value whose quote never ends is read up to white space or the tag's end; pages of any
length and depth are read whole, in one task and in time that grows with their length; marginals of exactly a half are no
content; repeated rows are read each for itself; a null page_id or url stays null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import column, lean, slices
from .toxicity import logistic

# HTML's void elements, raw-text elements, those whose content is no text, block elements and those whose end an opening tag implies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
MUTE = frozenset("noscript template svg math object select button canvas video audio".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
PARAGRAPH_ENDS = BLOCK - {"br", "body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd", "caption", "legend", "summary"} | {"li", "dt", "dd"}
# An attribute: a name, and perhaps a value, quoted if its quote ends anywhere, else up to white space or the tag's end.
_VALUE = r"""\"[^\"]*+\"|'[^']*+'|[^\s>]*+"""
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+")
_ATTRIBUTES = rf"(?>[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?>{_VALUE}))?+)*+"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?=(?P<data>.*?\]\]>))(?P=data)|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)|<(?P<slash>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attributes>{_ATTRIBUTES})(?P<end>>|\Z)", re.S)
STATED = ("class", "id", "role", "itemprop")
NAMES = re.compile(r"[a-z]+")
STOP = re.compile(r"[.!?](?=\s|$)")
SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")
# Words of class, id and role that speak for either state.
GOOD = frozenset("article body content entry main post story text articlebody".split())
BAD = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget banneritem contentinfo complementary search".split())
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "a", "nav", "aside", "header", "footer", "form", "blockquote", "pre", "table", "td", "figure", "figcaption", "b", "span", "label", "dl", "details", "body"]


class Node:
    __slots__ = ("attrs", "children", "drawn", "index", "linked", "paragraph", "parent", "sentences", "tag", "words")

    def __init__(self, tag: str, parent: Node | None, index: int, attrs: str) -> None:
        self.tag, self.parent, self.index, self.attrs = tag, parent, index, attrs
        self.children: list[Node] = []
        self.words = self.linked = self.sentences = 0
        self.drawn = tag in ("svg", "math") or parent is not None and parent.drawn
        # The paragraph that a block would end here.
        self.paragraph: Node | None = self if tag == "p" else None if parent is None or tag in ("td", "th", "table") or tag in MUTE else parent.paragraph


def _silent(node: Node) -> bool:
    """An element of MUTE that its own end tag didn't end: what stands in it directly is no text, the elements in it are read."""
    while node.tag in ("option", "optgroup"):
        node = node.parent
    return node.tag in MUTE and node.attrs[-1:] != "/"


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in document order, the first a root, and the runs of text (index of the nearest element, text).

    Linear in the page: what is looked for among the open elements is known to be there, and is closed by being found.
    """
    nodes = [Node("#root", None, 0, "")]
    texts: list[tuple[int, str]] = []
    here, at, end = nodes[0], 0, len(page)
    open_ = Counter()  # the open elements by their tag
    before: dict[int, int] = {}  # for each open element of MUTE the runs before it

    def close(last: Node) -> Node:
        """Closes all elements down to this one; returns what is open then."""
        node = here
        while node is not last:
            open_[node.tag] -= 1
            node = node.parent
        open_[last.tag] -= 1
        return last.parent

    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            texts.append((here.index, page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or not m["end"]:
            continue  # a comment, a declaration, or cut off
        if m["slash"]:
            if open_[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = close(node)
                if tag in MUTE:  # its own end tag: nothing in it is text
                    here.children.pop()
                    del nodes[node.index :], texts[before[node.index] :]
                    continue
            elif tag in ("p", "br"):
                texts.append((here.index, "\0"))
            texts.append((here.index, "\0" if tag in BLOCK else ""))
            continue
        if tag in PARAGRAPH_ENDS and here.paragraph is not None:
            here = close(here.paragraph)
        if tag in CLOSES and any(open_[t] for t in CLOSES[tag]):
            node, cut = here, None
            while node.parent is not None and node.tag not in FENCES[tag] and node.tag not in MUTE:
                if node.tag in CLOSES[tag]:
                    cut = node
                node = node.parent
            if cut is not None:
                here = close(cut)
        if tag in BLOCK:
            texts.append((here.index, "\0"))
        if tag in VOID:
            continue
        attrs = m["attributes"]
        if attrs[-1:] == "/" and (tag in ("svg", "math") or here.drawn):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        node = Node(tag, here, len(nodes), attrs)
        here.children.append(node)
        nodes.append(node)
        open_[tag] += 1
        if tag in MUTE:
            before[node.index] = len(texts)
        here = node
    if at < end:
        texts.append((here.index, page[at:]))
    texts = [(i, entities.unescape(t) if "&" in t else t) for i, t in texts if t and (t == "\0" or not _silent(nodes[i]))]
    for i, t in texts:
        if t != "\0":
            nodes[i].words += len(t.split())
            nodes[i].sentences += len(STOP.findall(t))
    for node in reversed(nodes[1:]):  # children come after their parents
        if node.tag == "a":
            node.linked = node.words
        above = node.parent
        above.words += node.words
        above.linked += node.linked
        above.sentences += node.sentences
    return nodes, texts


def features(node: Node) -> list[float]:
    marks: set[str] = set()
    hidden = 0.0
    for name, value in ATTRIBUTE.findall(node.attrs) if node.attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = 1.0
        elif name in STATED:
            marks.update(NAMES.findall(value))
    share = node.linked / node.words if node.words else 0.0
    return [
        *(1.0 if node.tag == t else 0.0 for t in TAGS),
        1.0 if marks & GOOD else 0.0, 1.0 if marks & BAD else 0.0, hidden, share, 1.0 if share > 0.5 else 0.0,
        min(math.log1p(node.words), 7.0) / 7, 1.0 if node.sentences else 0.0, 1.0 if node.words == 0 else 0.0,
    ]


class Model:
    """Unary weights and, for blocks and others, the table of parent's and child's state."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Probability of content for each element: one upward and one downward pass in document order."""
        logits = np.clip(np.array([features(n) for n in nodes]) @ self.weights[:-1] + self.weights[-1], -20, 20).tolist()
        tables = self.pairs.tolist()
        n = len(nodes)
        own = [(1.0, math.exp(v)) for v in logits]
        own[0] = (1.0, 1e-3)  # the root itself is no content
        up = [(1.0, 1.0)] * n  # from an element to its parent
        below = [(1.0, 1.0)] * n  # product of what an element's children sent
        for i in range(n - 1, 0, -1):
            node = nodes[i]
            t = tables[node.tag in BLOCK]
            a, b = own[i][0] * below[i][0], own[i][1] * below[i][1]
            m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
            up[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            p = node.parent.index
            c0, c1 = below[p][0] * up[i][0], below[p][1] * up[i][1]
            total = c0 + c1
            below[p] = (c0 / total, c1 / total) if total else (0.5, 0.5)
        down = [(1.0, 1.0)] * n
        out = np.zeros(n)
        for i in range(n):
            node = nodes[i]
            if i:
                p = node.parent.index
                # All that the parent knows but for what this element told it.
                q0 = own[p][0] * down[p][0] * below[p][0] / up[i][0]
                q1 = own[p][1] * down[p][1] * below[p][1] / up[i][1]
                total = q0 + q1
                t = tables[node.tag in BLOCK]
                d0, d1 = (t[0][0] * q0 + t[1][0] * q1) / total, (t[0][1] * q0 + t[1][1] * q1) / total
                down[i] = (d0 / (d0 + d1), d1 / (d0 + d1))
            b0, b1 = own[i][0] * below[i][0] * down[i][0], own[i][1] * below[i][1] * down[i][1]
            out[i] = b1 / (b0 + b1) if b0 + b1 else 0.0
        return out


def extract(page: str | None, model: Model) -> str:
    """The main text: blocks in order, joined by one space."""
    if not page:
        return ""
    nodes, texts = parse(page)
    keep = model.marginals(nodes) > 0.5
    return SPACE.sub(" ", "".join(" " if t == "\0" else t for i, t in texts if t == "\0" or keep[i])).strip()


# Training pages -------------------------------------------------------------------------------------------------------


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of a random layout, and the label of each of its elements in document order (the first is html)."""
    out: list[str] = []
    labels: list[int] = []

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(n))

    def sentences(n: int) -> str:
        return " ".join(words(rng.randint(3, 18)).capitalize() + rng.choice("....!?") for _ in range(n))

    def put(tag: str, label: int, body, attrs: str = "") -> None:  # noqa: ANN001
        out.append(f"<{tag}{attrs}>")
        labels.append(label)
        body() if callable(body) else out.append(body)
        out.append(f"</{tag}>")

    def links(label: int = 0) -> None:
        put("ul", label, lambda: [put("li", label, lambda: put("a", label, words(rng.randint(1, 3)), ' href="/x"')) for _ in range(rng.randint(3, 8))])

    def marked(*names: str) -> str:
        return rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(["box", "col", "mod"])} {rng.choice(names)}"'])

    def paragraph() -> None:
        kind = rng.random()
        if kind < 0.1:
            put("ul", 1, lambda: [put("li", 1, sentences(1)) for _ in range(rng.randint(2, 5))])
        elif kind < 0.16:
            put("blockquote", 1, lambda: put("p", 1, sentences(2)))
        elif kind < 0.22:
            put("pre", 1, words(12))
        elif kind < 0.3:
            put(rng.choice(["h2", "h3"]), 1, words(rng.randint(2, 7)))
        elif kind < 0.36:
            put("table", 1, lambda: [put("tr", 1, lambda: [put("td", 1, words(2)) for _ in range(3)]) for _ in range(3)])
        elif kind < 0.4:
            put("figure", 1, lambda: put("figcaption", 1, sentences(1)))
        else:
            def inner() -> None:
                out.append(rng.choice([sentences(rng.randint(1, 6)), words(rng.randint(1, 60)), words(2)]))
                for _ in range(rng.choice([0, 0, 1, 2])):
                    put(rng.choice(["a", "b", "span"]), 1, words(rng.randint(1, 4)))
                    out.append(" " + sentences(1))

            put(rng.choice(["p", "p", "p", "div"]), 1, inner)

    def article() -> None:
        put("h1", 1, words(rng.randint(1, 12)))
        if rng.random() < 0.2:
            put("b", 1, lambda: [paragraph() for _ in range(rng.randint(1, 4))])
        for _ in range(rng.randint(1, 9)):
            paragraph()
            if rng.random() < 0.08:
                put(rng.choice(["div", "aside"]), 0, sentences(rng.randint(1, 2)), marked("ad", "promo", "related", "newsletter", "share"))

    def noise() -> None:
        kind = rng.random()
        if kind < 0.3:
            put("nav", 0, links)
        elif kind < 0.45:
            put("div", 0, sentences(rng.randint(1, 2)), marked("ad", "ads", "advert", "sponsored", "banner", "notice", "cookie"))
        elif kind < 0.55:
            put(rng.choice(["aside", "div"]), 0, lambda: (put("h3", 0, words(2)), links()), marked("sidebar", "related", "widget", "menu"))
        elif kind < 0.65:
            put("form", 0, lambda: (put("label", 0, words(2)), put("p", 0, sentences(1))), marked("search", "login", "subscribe", "form"))
        elif kind < 0.8:
            put(rng.choice(["section", "div"]), 0, lambda: [put(rng.choice(["div", "li", "p"]), 0, lambda: put("p", 0, sentences(rng.randint(1, 3))), marked("comment", "reply")) for _ in range(rng.randint(1, 4))], marked("comments", "disqus", "replies"))
        elif kind < 0.9:
            put("header", 0, lambda: (put("div", 0, words(2)), links()))
        else:
            put("footer", 0, lambda: (put("p", 0, sentences(1)), links()) if rng.random() < 0.5 else out.append(sentences(1)))

    def body() -> None:
        before, after = rng.randint(1, 3), rng.randint(1, 4)
        for _ in range(before):
            noise()
        holder = rng.random()
        if holder < 0.55:
            put("article", 1, article, rng.choice(["", marked("post", "story", "entry")]))
        elif holder < 0.75:
            put("main", 1, article)
        else:
            put(rng.choice(["div", "section"]), 1, article, marked("content", "main", "article", "post", "entry"))
        for _ in range(after):
            noise()

    put("html", 0, lambda: put("body", 0, body))
    return "".join(out), labels


@functools.cache
def train(pages: int = 300, seed: int = 7, trust: float = 0.5) -> Model:
    """Fit the potentials on labelled pages. trust: the unary share, as the elements of a subtree show much the same."""
    rng = random.Random(seed)
    x, y, counts = [], [], np.ones((2, 2, 2))
    for _ in range(pages):
        page, labels = labelled_page(rng)
        nodes, _ = parse(page)
        if len(nodes) != len(labels) + 1:
            continue  # the layout's nesting isn't what a reader of HTML makes of it
        states = [0, *labels]
        for node in nodes[1:]:
            x.append(features(node))
            y.append(states[node.index])
            counts[int(node.tag in BLOCK), states[node.parent.index], states[node.index]] += 1
    weights = logistic(np.array(x), np.array(y, float), ridge=1.0, steps=12)
    share = sum(y) / len(y)
    weights[-1] -= math.log(share / (1 - share))  # the pairs carry how common content is
    return Model(trust * weights, counts / counts.sum(axis=2, keepdims=True))


def main_text(pages: DataFrame, training_pages: int = 300) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    model = train(training_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            texts = [extract(h, model) for h in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
