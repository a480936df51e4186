"""Rule-free detectors: lists, repeated siblings, cards, tables, structured data, pagination.

Each looks at one page only, so the table forms run in the parsing pass and emit rows; JSON-LD is DataFrame code over
``nodes``, as it ends in a variant.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from ..sources import html
from ..sources.html import Element
from .select import attribute

# Words that mark cards, their fields, and pagination; the standard meta names; link texts for next and previous.
CARDS = ["card", "item", "product", "article", "post", "entry", "listing", "result", "tile", "box", "block"]
FIELDS = {"title": "title|name|heading", "price": "price|cost|amount", "description": "desc|summary|excerpt|content"}
PAGERS = ["pagination", "pager", "paginator", "page-numbers", "pages"]
STANDARD = ["description", "keywords", "author", "viewport", "robots"]
NEXT = ["next", "следующая", "次", "下一页", "›", "»", "→", "more"]
PREV = ["prev", "previous", "предыдущая", "前", "上一页", "‹", "«", "←", "back"]


@functools.cache
def _pattern(word: str) -> re.Pattern:
    return re.compile(word, re.I)


def classed(e: Element, word: str) -> bool:
    """Whether a class, or all of them as one string, holds the word in any case."""
    classes = e.classes()
    return bool(classes) and _pattern(word).search(" ".join(classes)) is not None


def value(e: Element, name: str) -> str:
    v = e.attrs.get(name, "")
    return " ".join(v) if isinstance(v, list) else v


def structure(e: Element) -> str:
    return f"{e.name}:{sorted(e.classes())}:{sorted(c.name for c in e.elements)}"


def first(root: Element, test: Callable[[Element], bool]) -> Element | None:
    return next((e for e in root.walk() if test(e)), None)


def named(*names: str) -> Callable[[Element], bool]:
    return lambda e: e.name in names


# Lists and cards ------------------------------------------------------------------------------------------------------


def plain_lists(root: Element, least: int = 3) -> list[dict]:
    """Lists with enough direct items."""
    out = []
    for e in root.walk():
        if e.name in ("ul", "ol"):
            items = [c for c in e.elements if c.name == "li"]
            if len(items) >= least:
                out.append({"type": "html_list", "tag": e.name, "node_id": e.number, "count": len(items), "texts": [i.tight() for i in items]})
    return out


def lists(root: Element, least: int = 3) -> list[dict]:
    """Lists with enough direct items, then repeated siblings."""
    return plain_lists(root, least) + repeated(root, least)


def repeated(root: Element, least: int = 3) -> list[dict]:
    """For each parent, its first tag with enough children of one structure: those children."""
    out = []
    for up in (root, *root.walk()):
        kinds: dict[str, list[tuple[Element, str]]] = {}
        own = up.elements
        many = Counter(c.name for c in own)
        for c in own:
            if many[c.name] >= least:
                kinds.setdefault(c.name, []).append((c, structure(c)))
        for name, alike in kinds.items():
            kind, count = Counter(k for _, k in alike).most_common(1)[0]
            if count >= least:
                out.append((alike[0][0].number, {"type": "repeated_pattern", "tag": name, "node_id": up.number, "count": count, "texts": [c.tight() for c, k in alike if k == kind]}))
                break
    return [x for _, x in sorted(out, key=lambda o: o[0])]  # in the order of their first elements


def cards(root: Element, least: int = 3) -> list[dict]:
    """For each word that marks cards, the groups of one structure among the elements it marks."""
    marked: dict[str, list[Element]] = {word: [] for word in CARDS}
    for e in root.walk():
        if "class" in e.attrs:
            for word in CARDS:
                if classed(e, word):
                    marked[word].append(e)
    out, shapes = [], {}
    for word, those in marked.items():
        kinds: dict[str, list[Element]] = {}
        for e in those if len(those) >= least else ():
            if e.number not in shapes:
                shapes[e.number] = structure(e)
            kinds.setdefault(shapes[e.number], []).append(e)
        out += [{"type": "card", "indicator": word, "count": len(g), "node_ids": [e.number for e in g], "sample_fields": card_fields(g[0])} for g in kinds.values() if len(g) >= least]
    return out


def card_fields(card: Element) -> dict[str, str]:
    marked = lambda field: first(card, lambda e: classed(e, FIELDS[field]))
    title = first(card, named("h1", "h2", "h3", "h4", "h5", "h6")) or marked("title")
    price, about = marked("price"), marked("description") or first(card, named("p"))
    image, link = first(card, named("img")), first(card, lambda e: e.name == "a" and "href" in e.attrs)
    found = {
        "title": title and title.tight(), "price": price and price.tight(), "description": about and about.tight()[:200],
        "image": image and (value(image, "src") or value(image, "data-src")), "link": link and value(link, "href"),
    }
    return {k: v for k, v in found.items() if v is not None}


# Tables ---------------------------------------------------------------------------------------------------------------


def cells(row: Element) -> list[Element]:
    return [e for e in row.walk() if e.name in ("td", "th")]


def cell_text(e: Element) -> str:
    return re.sub(r"\s+", " ", e.tight())


def as_dicts(headers: list[str], rows: list[list[str]]) -> list[dict[str, str]]:
    """A later cell under an equal header replaces the earlier one."""
    return [{headers[i] if i < len(headers) else f"col_{i}": v for i, v in enumerate(r)} for r in rows]


def simple_tables(root: Element) -> list[dict]:
    """All rows of each table; the first names the columns if it holds a header cell, else they are col_0, col_1, ..."""
    out = []
    for t in root.walk():
        rows = [e for e in t.walk() if e.name == "tr"] if t.name == "table" else []
        if rows:
            head = cells(rows[0])
            titled = any(c.name == "th" for c in head)
            headers = [c.tight() if titled else f"col_{i}" for i, c in enumerate(head)]
            body = [[c.tight() for c in cells(r)] for r in rows[titled:]]
            data = as_dicts(headers, [r for r in body if r])
            out.append({"headers": headers, "data": data, "row_count": len(data)})
    return out


def tables(root: Element) -> list[dict]:
    """Each table's headers (its head, or a first row with header cells) and the rows of its first body."""
    out = []
    for t in root.walk():
        if t.name != "table":
            continue
        head, body = first(t, named("thead")), first(t, named("tbody"))
        headers = [cell_text(c) for c in cells(head)] if head else []
        rows = [e for e in (body or t).walk() if e.name == "tr"]
        if not body and not headers and rows and any(c.name == "th" for c in cells(rows[0])):
            headers, rows = [cell_text(c) for c in cells(rows[0])], rows[1:]
        data = [[cell_text(c) for c in cells(r)] for r in rows]
        data = [r for r in data if r]
        headers = headers or [f"column_{i + 1}" for i in range(max(map(len, data), default=0))]
        out.append({"table_index": len(out), "headers": headers, "rows": data, "as_dicts": as_dicts(headers, data)})
    return out


def table_csv(root: Element, index: int = 0) -> str:
    """One table as CSV with every field quoted; empty if there is no such table."""
    found = tables(root)
    quoted = lambda row: ",".join('"' + v.replace('"', '""') + '"' for v in row) + "\r\n"
    return "".join(map(quoted, [found[index]["headers"], *found[index]["rows"]])) if index < len(found) else ""


# Structured data ------------------------------------------------------------------------------------------------------


def json_ld_of(root: Element) -> list[Any]:
    out = []
    for e in root.walk():
        if e.name == "script" and value(e, "type") == "application/ld+json":
            try:
                out.append(json.loads(e.single() or ""))
            except ValueError:
                continue
    return out


def meta_of(root: Element) -> dict[str, dict[str, str]]:
    meta: dict[str, dict[str, str]] = {"standard": {}, "og": {}, "twitter": {}, "other": {}}
    for e in root.walk():
        name, content = value(e, "name") or value(e, "property"), value(e, "content")
        if e.name == "meta" and name and content:
            kind, _, rest = name.partition(":")
            bucket, key = (kind, rest) if kind in ("og", "twitter") and ":" in name else ("standard" if name in STANDARD else "other", name)
            meta[bucket][key] = content
    if title := first(root, named("title")):
        meta["standard"]["title"] = title.tight()
    return meta


def microdata_of(root: Element) -> list[dict]:
    sources = {"meta": "content", "img": "src", "audio": "src", "video": "src", "source": "src", "a": "href"}
    out = []
    for e in root.walk():
        if "itemscope" in e.attrs:
            held: dict[str, list] = {}
            for p in e.walk():
                if "itemprop" in p.attrs:
                    known = p.attrs.get(sources[p.name]) if p.name in sources else (value(p, "datetime") if p.name == "time" else "") or p.tight()
                    held.setdefault(value(p, "itemprop"), []).append(known)
            out.append({"type": e.attrs.get("itemtype"), "properties": {k: v[0] if len(v) == 1 else v for k, v in held.items()}})
    return out


# Pagination -----------------------------------------------------------------------------------------------------------


def resolved(href: str | None, base: str | None) -> str | None:
    if not href or href == "#":
        return None
    return urljoin(base, href) if base else href


def pager(root: Element) -> Element | None:
    for word in PAGERS:
        around = first(root, lambda e: classed(e, word)) or first(root, lambda e: value(e, "role") == "navigation" and re.search(word, value(e, "aria-label"), re.I) is not None)
        if around:
            return around
    return first(root, lambda e: e.name == "nav" and first(e, lambda a: a.name == "a" and re.search(r"page[=/-]?\d+", value(a, "href")) is not None) is not None)


def neighbour(around: Element, rel: str, words: list[str], base: str | None) -> str | None:
    """The link that says so by its relation, else by its text, else by its class."""
    links = [e for e in around.walk() if e.name == "a"]
    for e in links:
        if rel in value(e, "rel").split():
            return resolved(value(e, "href"), base)
    # For each word only the first link with that text counts.
    tests = [lambda e, w=w: e.single() is not None and re.search(f"^{re.escape(w)}$", e.single(), re.I) for w in words] + [lambda e: classed(e, rel)]
    for test in tests:
        found = next((e for e in links if test(e)), None)
        if found is not None and value(found, "href"):
            return resolved(value(found, "href"), base)
    return None


def pagination(root: Element, base: str | None = None) -> dict:
    around = pager(root)
    inside = around or root
    out = {"next": neighbour(inside, "next", NEXT, base), "prev": neighbour(inside, "prev", PREV, base), "pages": [], "current": None, "total_pages": None}
    if around:
        by_url: dict[str, int] = {}
        for e in around.walk():
            if e.name == "a" and "href" in e.attrs and re.fullmatch(r"\d+", e.tight()) and (url := resolved(value(e, "href"), base)):
                by_url.setdefault(url, int(e.tight()))
        out["pages"] = sorted(({"number": n, "url": u} for u, n in by_url.items()), key=lambda p: p["number"])
        for e in (first(around, lambda e: classed(e, "active|current|selected")), first(around, lambda e: "aria-current" in e.attrs)):
            if e is not None and out["current"] is None and re.fullmatch(r"\d+", e.tight()):
                out["current"] = int(e.tight())
        out["total_pages"] = max((p["number"] for p in out["pages"] if p["number"]), default=None)
    return out


def page_urls(root: Element, base: str | None = None, max_pages: int = 100) -> list[str]:
    return [p["url"] for p in pagination(root, base)["pages"][:max_pages]]


class PageDetector:
    """All detectors of one page, parsed once."""

    def __init__(self, page: str | Element, url: str | None = None, min_items: int = 3) -> None:
        self.root = html.parse(page) if isinstance(page, str) else page
        self.url, self.min_items = url, min_items

    def lists(self) -> list[dict]:
        return lists(self.root, self.min_items)

    def cards(self) -> list[dict]:
        return cards(self.root, self.min_items)

    def tables(self) -> list[dict]:
        return tables(self.root)

    def csv(self, index: int = 0) -> str:
        return table_csv(self.root, index)

    def structured(self) -> dict:
        return structured_of(self.root)

    def pagination(self) -> dict:
        return pagination(self.root, self.url)

    def page_urls(self, max_pages: int = 100) -> list[str]:
        return page_urls(self.root, self.url, max_pages)


# Over tables of pages -------------------------------------------------------------------------------------------------


def over_pages(pages: DataFrame, schema: str, rows: Callable[[Element, str | None], Iterator[tuple]], unescape: bool | str = True) -> DataFrame:
    """page_id and the rows (of the schema's columns) that a function makes of each page's tree and url."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    whole = f"page_id bigint, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return html.page_batches(batches, lambda i, u, h: ((i, *r) for r in rows(html.parse(h, unescape), u)), arrow)

    return html.pages_of(pages).mapInArrow(run, whole)


def detect_lists(pages: DataFrame, min_items: int = 3) -> DataFrame:
    return over_pages(pages, "pos int, type string, tag string, node_id int, count int, texts array<string>", lambda r, _: ((i, x["type"], x["tag"], x["node_id"], x["count"], x["texts"]) for i, x in enumerate(lists(r, min_items))))


def detect_cards(pages: DataFrame, min_items: int = 3) -> DataFrame:
    return over_pages(pages, "pos int, indicator string, count int, node_ids array<int>, sample_fields map<string,string>", lambda r, _: ((i, x["indicator"], x["count"], x["node_ids"], x["sample_fields"]) for i, x in enumerate(cards(r, min_items))))


def extract_tables(pages: DataFrame) -> DataFrame:
    """A row for each cell: table_index, row, col, header, value."""
    return over_pages(pages, "table_index int, row int, col int, header string, value string", lambda r, _: ((t["table_index"], i, j, t["headers"][j] if j < len(t["headers"]) else f"col_{j}", v) for t in tables(r) for i, row in enumerate(t["rows"]) for j, v in enumerate(row)))


def detect_tables(pages: DataFrame) -> DataFrame:
    """Simple tables: a row for each, with its rows as maps."""
    return over_pages(pages, "pos int, headers array<string>, row_count int, data array<map<string,string>>", lambda r, _: ((i, t["headers"], t["row_count"], t["data"]) for i, t in enumerate(simple_tables(r))))


def extract_table_csv(pages: DataFrame, table_index: int = 0) -> DataFrame:
    return over_pages(pages, "csv string", lambda r, _: iter([(table_csv(r, table_index),)]))


def extract_microdata(pages: DataFrame) -> DataFrame:
    """A row for each value of each property: item, type, property, pos, value."""
    def rows(root: Element, _: str | None) -> Iterator[tuple]:
        for i, item in enumerate(microdata_of(root)):
            for name, held in item["properties"].items():
                for k, v in enumerate(held if isinstance(held, list) else [held]):
                    yield i, item["type"], name, k, v

    return over_pages(pages, "item int, type string, property string, pos int, value string", rows)


def html_lists(pages: DataFrame, min_items: int = 3) -> DataFrame:
    """page_id, node_id, tag, count and texts of lists with enough direct items."""
    return over_pages(pages, "node_id int, tag string, count bigint, texts array<string>", lambda r, _: ((x["node_id"], x["tag"], x["count"], x["texts"]) for x in plain_lists(r, min_items)))


def meta_tags(pages: DataFrame) -> DataFrame:
    """page_id, bucket, name and content; the last of equal names counts, the first title is a standard one."""
    return over_pages(pages, "bucket string, name string, content string", lambda r, _: ((bucket, name, content) for bucket, held in meta_of(r).items() for name, content in held.items()))


PAGINATION = "`next` string, prev string, pages array<struct<number:int,url:string>>, current int, total_pages int"


def detect_pagination(pages: DataFrame) -> DataFrame:
    return over_pages(pages, PAGINATION, lambda r, u: iter([tuple(pagination(r, u).values())]))


def all_page_urls(pages: DataFrame, max_pages: int = 100) -> DataFrame:
    return over_pages(pages, "pos int, page_url string", lambda r, u: iter(enumerate(page_urls(r, u, max_pages))))


def page_text(pages: DataFrame) -> DataFrame:
    return over_pages(pages, "text string", lambda r, _: iter([(r.text(),)]))


def found_in_text(pages: DataFrame, pattern: str, flags: int = 0) -> DataFrame:
    """page_id, pos, groups: what the pattern finds in each page's text; the groups, or the whole match if there are none."""
    found = re.compile(pattern, flags)
    return over_pages(pages, "pos int, groups array<string>", lambda r, _: ((i, list(m.groups("")) or [m[0]]) for i, m in enumerate(found.finditer(r.text()))))


def named_in_text(pages: DataFrame, pattern: str, flags: int = 0) -> DataFrame:
    """page_id, pos, groups: the named groups of each match in each page's text, as a map."""
    found = re.compile(pattern, flags)
    return over_pages(pages, "pos int, groups map<string,string>", lambda r, _: ((i, list(m.groupdict().items())) for i, m in enumerate(found.finditer(r.text()))))


def patterns_of(root: Element, least: int = 3) -> dict:
    return {"lists": lists(root, least), "tables": simple_tables(root), "cards": cards(root, least)}


def structured_of(root: Element) -> dict:
    return {"json_ld": json_ld_of(root), "meta_tags": meta_of(root), "microdata": microdata_of(root)}


def auto_detect(pages: DataFrame, min_items: int = 3) -> DataFrame:
    """page_id and the patterns of each page as JSON."""
    return over_pages(pages, "patterns string", lambda r, _: iter([(json.dumps(patterns_of(r, min_items), ensure_ascii=False),)]))


def extract_structured(pages: DataFrame) -> DataFrame:
    """page_id and the structured data of each page as JSON."""
    return over_pages(pages, "structured_data string", lambda r, _: iter([(json.dumps(structured_of(r), ensure_ascii=False),)]))


def smart_extract(pages: DataFrame, min_items: int = 3, unescape: bool | str = True, ascii_words: bool = False) -> DataFrame:
    """One row a page: typed values, lists, tables, cards, structured data (as JSON) and pagination, from one parse.

    Typed values are looked for in composed text: a decomposed letter would end, or begin, a value at its bare first half.
    unescape: see html.parse; ascii_words: see typed.pattern.
    """
    def rows(root: Element, url: str | None) -> Iterator[tuple]:
        text = unicodedata.normalize("NFC", root.text())
        yield typed.ascii_only(text) if ascii_words else text, json.dumps(patterns_of(root, min_items), ensure_ascii=False), json.dumps(structured_of(root), ensure_ascii=False), tuple(pagination(root, url).values())

    made = over_pages(pages, f"text string, patterns string, structured_data string, pagination struct<{PAGINATION.replace('`', '').replace(' string', ':string').replace(' int', ':int').replace('pages array', 'pages:array')}>", rows, unescape)
    return made.select("page_id", typed.extract_all(F.col("text"), ascii_words=ascii_words).alias("data_types"), "patterns", "structured_data", "pagination")


# A DataFrame form over nodes -------------------------------------------------------------------------------------------


def json_ld(nodes: DataFrame) -> DataFrame:
    """page_id, node_id and data (a variant) of JSON-LD scripts that hold JSON."""
    scripts = nodes.where((F.col("name") == "script") & (attribute("type") == "application/ld+json"))
    return scripts.select("page_id", "node_id", F.try_parse_json("single_string").alias("data")).where("data is not null")
