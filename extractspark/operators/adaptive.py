"""Finding elements again after a redesign: stored signatures, weighted similarity, and items by their fields.

Signatures are few (one for each learned element) and travel with the code; pages are scored in the parsing pass, so that
no element leaves its partition.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.similarity import bound, signature_score
from ..functions.urls import domain_of
from ..sources import html
from ..sources.html import DOCUMENT, Element

# How much of each text a signature keeps, elements that may be items, headings, and groups of like tags.
LIMITS = {"text": 500, "direct_text": 200, "parent_text": 100, "children_tags": 10}
ITEM_TAGS = ("article", "div", "li", "tr", "section")
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
ALIKE = [{"span", "time", "date"}, {"p", "div", "section"}, set(HEADINGS), {"cite", "span", "em", "strong"}]
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
DATE = re.compile(rf"\b(?:{_MONTHS})\b|\b\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}\b|\b\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}\b", re.I)


def signature(e: Element, url: str = "") -> dict[str, Any]:
    """What an element is known by."""
    up = e.parent if e.parent is not None and e.parent.name != DOCUMENT else None
    above = up.parent if up is not None and up.parent.name != DOCUMENT else None
    chain = e.path()
    text, path = e.tight(), "/".join(x.name for x in chain)
    return {
        "tag_name": e.name, "attributes": dict(e.attrs), "text": text[: LIMITS["text"]], "direct_text": e.own_spaced()[: LIMITS["direct_text"]],
        "path": path, "depth": len(chain) - 1, "sibling_index": e.rank(),
        "parent_name": up.name if up else None, "parent_attribs": dict(up.attrs) if up else {}, "parent_text": up.own_spaced()[: LIMITS["parent_text"]] if up else "",
        "grandparent_name": above.name if above else None, "grandparent_attribs": dict(above.attrs) if above else {},
        "children_tags": [c.name for c in e.elements][: LIMITS["children_tags"]], "children_count": len(e.elements), "url": url,
        "hash": hashlib.sha256(f"{e.name}:{path}:{text[:100]}".encode()).hexdigest()[:16],
    }


class SignatureStore:
    """Signatures by domain and identifier; the last one saved counts."""

    def __init__(self) -> None:
        self.data: dict[str, dict[str, dict]] = {}

    def save(self, domain: str, identifier: str, properties: dict) -> bool:
        self.data.setdefault(domain, {})[identifier] = properties
        return True

    def retrieve(self, domain: str, identifier: str) -> dict | None:
        return self.data.get(domain, {}).get(identifier)

    def delete(self, domain: str, identifier: str) -> bool:
        self.data.get(domain, {}).pop(identifier, None)
        if not self.data.get(domain, True):
            del self.data[domain]
        return True

    def list_identifiers(self, domain: str) -> list[str]:
        return list(self.data.get(domain, {}))

    def clear_domain(self, domain: str) -> bool:
        self.data.pop(domain, None)
        return True

    def clear_all(self) -> None:
        self.data.clear()

    def export_all(self) -> dict:
        return {d: {i: dict(p) for i, p in x.items()} for d, x in self.data.items()}

    def import_all(self, data: dict | None) -> None:
        if data:
            self.data = {d: {i: dict(p) for i, p in x.items()} for d, x in data.items()}


def best_matches(root: Element, wanted: dict, least: float = 0.5, url: str = "", weights: dict | None = None, among: list[Element] | None = None) -> list[tuple[Element, float]]:
    """Elements (of the wanted tag, or among the given ones) at least that similar, the most similar first."""
    pool = [e for e in root.walk() if e.name == wanted.get("tag_name")] if among is None else among
    scored = []
    for e in pool:
        own = signature(e, url)
        # The full comparison takes time by the product of the texts' lengths; its bound doesn't.
        if signature_score(wanted, own, weights, bound) >= least:
            scored.append((e, signature_score(wanted, own, weights)))
    return sorted(((e, s) for e, s in scored if s >= least), key=lambda x: -x[1])


def similar_elements(root: Element, reference: Element, threshold: float = 0.6, url: str = "", weights: dict | None = None) -> list[tuple[Element, float]]:
    """Other elements of the reference's tag, at most two levels away from its depth, by similarity."""
    wanted, depth = signature(reference, url), len(reference.path())
    pool = [e for e in root.walk() if e.name == reference.name and e.digest() != reference.digest() and abs(len(e.path()) - depth) <= 2]
    return best_matches(root, wanted, threshold, url, weights, pool)


class ElementMatcher:
    """Weighted similarity with a threshold and weights of its own."""

    def __init__(self, min_similarity: float = 0.5, weights: dict[str, float] | None = None) -> None:
        self.min_similarity, self.weights = min_similarity, weights

    def score(self, a: Element | dict, b: Element | dict) -> float:
        """Of two elements or signatures."""
        x, y = (signature(e) if isinstance(e, Element) else e for e in (a, b))
        return signature_score(x, y, self.weights)

    def best(self, root: Element, wanted: dict, url: str = "") -> list[tuple[Element, float]]:
        return best_matches(root, wanted, self.min_similarity, url, self.weights)

    def similar(self, root: Element, reference: Element, url: str = "") -> list[tuple[Element, float]]:
        return similar_elements(root, reference, self.min_similarity, url, self.weights)


def field_similarity(stored: dict, tag: str, text: str, href: str) -> float:
    """How well a candidate fits a stored field: headings, dates, bylines, paragraphs, tags and length, by what applies."""
    if stored.get("wanted_attr") == "href":
        return 1.0 if href else 0.0
    known, known_tag = stored.get("text") or "", stored.get("tag_name") or ""
    got: list[tuple[float, float]] = []
    if known_tag in HEADINGS:
        got.append((0.4 if tag in HEADINGS else 0.1 if text and len(text) < 100 else 0.0, 0.4))
    if DATE.search(known):
        got.append((0.4 if text and DATE.search(text) else 0.0, 0.4))
    if known.lower().startswith("by "):
        got.append((0.5 if text and text.lower().startswith("by ") else 0.0, 0.5))
    if known_tag == "p" or len(known) > 50:
        got.append((0.3 if tag == "p" or text and len(text) > 30 else 0.0, 0.3))
    got.append((0.2 if known_tag == tag else 0.1 if known_tag and tag and any({known_tag, tag} <= g for g in ALIKE) else 0.0, 0.2))
    if known and text:
        near = min(len(text), len(known)) / max(len(text), len(known))
        got.append((0.1 * near if near > 0.3 else 0.0, 0.1))
    return sum(s for s, _ in got) / sum(w for _, w in got)


def item_containers(root: Element) -> list[Element]:
    """The most frequent pattern of tag, classes and children among likely items; else the parent with most short texts."""
    kinds: dict[tuple, list[Element]] = {}
    for e in root.walk():
        if e.name in ITEM_TAGS and len(e.tight()) >= 10:
            kinds.setdefault((e.name, tuple(sorted(e.classes())), tuple(sorted(c.name for c in e.elements))), []).append(e)
    counts = Counter({k: len(v) for k, v in kinds.items() if len(v) >= 2})
    if counts:
        return kinds[max(counts, key=counts.__getitem__)]
    below: dict[int, list[Element]] = {}
    for e in root.walk():
        if 10 < len(e.tight()) < 500:
            below.setdefault(id(e.parent), []).append(e)
    most = max(below.values(), key=len, default=[])
    return most if len(most) >= 2 else []


def items_by_fields(root: Element, fields: dict[int, list[dict]]) -> list[list[str]]:
    """For each container the best unused candidate of each field, field by field; equal items count once."""
    width = max(fields, default=-1) + 1
    out = []
    for container in item_containers(root):
        pool = [(e.name, e.own(), str(e.attrs.get("href", ""))) for e in container.walk() if e.own()]
        used: set[int] = set()
        item = []
        for a in range(width):
            best, value, at = 0.0, "", -1
            for i, (tag, text, href) in enumerate(pool):
                for stored in fields.get(a, []) if i not in used else ():
                    s = field_similarity(stored, tag, text, href)
                    if s > best and s >= 0.3:
                        best, at, value = s, i, href if stored.get("wanted_attr") == "href" else text
            used.add(at)
            item.append(value)
        if any(item):
            out.append(tuple(item))
    return [list(x) for x in dict.fromkeys(out)]


def fields_of(signatures: dict[str, dict]) -> dict[int, list[dict]]:
    """Signatures of grouped training by the place of their field."""
    out: dict[int, list[dict]] = {}
    for identifier, stored in signatures.items():
        if m := re.match(r"group_[^_]*_[^_]*_(\d+)", identifier):
            out.setdefault(int(m[1]), []).append(stored)
    return out


_FOUND = pa.schema([("page_id", pa.int64()), ("identifier", pa.string()), ("alias", pa.string()), ("node_id", pa.int32()), ("score", pa.float64()), ("value", pa.string())])


def items_of(store: SignatureStore) -> Callable[[str | None, Element], list[list[str]]]:
    """The items of a page by the fields stored for its domain, or for none."""
    data = store.export_all()

    def items(url: str | None, root: Element) -> list[list[str]]:
        fields = fields_of(data.get(domain_of(url)) or data.get("default", {}))
        return items_by_fields(root, fields) if fields else []

    return items


def fallback(store: SignatureStore, min_similarity: float = 0.5, weights: dict | None = None) -> Callable[[int | None, str | None, Element], Iterator[tuple]]:
    """Rows like those of rules (see replay) for pages where no rule finds anything: the best element of each signature."""
    data = store.export_all()

    def rows(page_id: int | None, url: str | None, root: Element) -> Iterator[tuple]:
        for identifier, stored in data.get(domain_of(url), {}).items():
            for e, _ in best_matches(root, stored, min_similarity, url or "", weights)[:1]:
                yield page_id, identifier, stored.get("alias") or "", 0, e.number, e.text().strip()

    return rows


def find(pages: DataFrame, store: SignatureStore, identifiers: list[str] | None = None, min_similarity: float = 0.5, weights: dict | None = None, every: bool = False, domain: str | None = None, unescape: bool | str = True) -> DataFrame:
    """page_id, identifier, alias, node_id, score, value: the best element for each stored signature of the page's domain.

    With a domain, its signatures are looked for on all pages. unescape: see html.parse.
    """
    data = store.export_all()

    def rows(page_id: int | None, url: str | None, page: str) -> Iterator[tuple]:
        known = data.get(domain or domain_of(url), {})
        wanted = {i: p for i, p in known.items() if identifiers is None or i in identifiers}
        root = html.parse(page, unescape) if wanted else None
        for identifier, stored in wanted.items():
            found = best_matches(root, stored, min_similarity, url or "", weights)
            for e, s in found if every else found[:1]:
                yield page_id, identifier, stored.get("alias") or "", e.number, s, e.text().strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return html.page_batches(batches, rows, _FOUND)

    return html.pages_of(pages).mapInArrow(run, "page_id bigint, identifier string, alias string, node_id int, score double, value string")


def find_similar(pages: DataFrame, tag: str, threshold: float = 0.6) -> DataFrame:
    """page_id, node_id, score, value: elements similar to each page's first element called tag."""
    schema = pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("score", pa.float64()), ("value", pa.string())])

    def rows(page_id: int | None, url: str | None, page: str) -> Iterator[tuple]:
        root = html.parse(page)
        first = next((e for e in root.walk() if e.name == tag), None)
        for e, s in similar_elements(root, first, threshold, url or "") if first is not None else ():
            yield page_id, e.number, s, e.text().strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return html.page_batches(batches, rows, schema)

    return html.pages_of(pages).mapInArrow(run, "page_id bigint, node_id int, score double, value string")


def grouped(pages: DataFrame, store: SignatureStore) -> DataFrame:
    """page_id, pos and item, by the fields stored for the page's domain, or for none."""
    schema = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("item", pa.list_(pa.string()))])
    items = items_of(store)

    def rows(page_id: int | None, url: str | None, page: str) -> Iterator[tuple]:
        for i, item in enumerate(items(url, html.parse(page))):
            yield page_id, i, item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return html.page_batches(batches, rows, schema)

    return html.pages_of(pages).mapInArrow(run, "page_id bigint, pos int, item array<string>")
