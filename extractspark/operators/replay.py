"""Rules over tables of pages.

A rule's matches, the rank of its leaf among fitting siblings and the fallback for pages where no rule finds anything are
all questions about one page, so they are answered in the parsing pass: pages stay where they are read, and what leaves
the pass is values. Replay follows the rules' levels from the top, so it looks at the children along its paths only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import html
from .rules import Rule, replay_exact, replay_grouped, replay_similar, value_of

#: What pages without a value are given to: (page_id, url, tree) to rows like those of the rules.
Fallback = Callable[[int | None, str | None, html.Element], Iterator[tuple]]
ROW = "page_id bigint, stack_id string, alias string, seq int, node_id int, value string"
_ROW = pa.schema([("page_id", pa.int64()), ("stack_id", pa.string()), ("alias", pa.string()), ("seq", pa.int32()), ("node_id", pa.int32()), ("value", pa.string())])


def with_urls(rules: list[Rule]) -> list[tuple[Rule, str]]:
    """Each rule and the address its links start from where a page has none: that of the first rule that names one."""
    out, url = [], ""
    for r in rules:
        url = url or r.url
        out.append((r, url))
    return out


def similar(pages: DataFrame, rules: list[Rule], sibling_leaves: bool = False, keep_blank: bool = False, otherwise: Fallback | None = None, unescape: bool | str = True) -> DataFrame:
    """page_id, stack_id, alias, seq, node_id and value of what the rules find on each page."""
    return in_trees(pages, rules, False, 1.0, sibling_leaves, keep_blank, otherwise, unescape)


def in_trees(pages: DataFrame, rules: list[Rule], exactly: bool, attr_fuzz_ratio: float = 1.0, sibling_leaves: bool = False, keep_blank: bool = False, otherwise: Fallback | None = None, unescape: bool | str = True) -> DataFrame:
    """The rows of similar or exact replay, page by page; unescape: see html.parse."""
    known = with_urls(rules)

    def find(page_id: int | None, url: str | None, page: str) -> Iterator[tuple]:
        root, empty = html.parse(page, unescape), True
        for r, base in known:
            for e in replay_exact(r, root, attr_fuzz_ratio) if exactly else replay_similar(r, root, attr_fuzz_ratio, sibling_leaves):
                value = value_of(e, r, url or base)
                if value or keep_blank:
                    empty = False
                    yield page_id, r.stack_id, r.alias, r.seq, e.number, value
        if empty and otherwise is not None:
            yield from otherwise(page_id, url, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return html.page_batches(batches, find, _ROW)

    return html.pages_of(pages).mapInArrow(run, ROW)


def results(rows: DataFrame, group_by: str | None = None, unique: bool | None = None, keep_order: bool = False) -> DataFrame:
    """page_id, the group (stack_id or alias) if asked for, and the values in rule order, or in page order.

    Distinct unless told otherwise when flat; all of them unless told otherwise when grouped.
    """
    if group_by not in (None, "stack_id", "alias"):
        raise ValueError("group_by is None, 'stack_id' or 'alias'")
    keys = ["page_id"] if group_by is None else ["page_id", group_by]
    ordered = (keep_order and group_by is None) or group_by == "alias"
    place = F.struct("node_id", "seq") if ordered else F.struct("seq", "node_id")
    only = (group_by is None) if unique is None else unique
    found = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("value").alias("value")))), lambda x: x["value"])
    return rows.groupBy(*keys).agg((F.array_distinct(found) if only else found).alias("values"))


def grouped(pages: DataFrame, rules: list[Rule], attr_fuzz_ratio: float = 1.0, otherwise: Callable[[str | None, html.Element], list[list[str]]] | None = None) -> DataFrame:
    """page_id, pos and item (an array, one value for each field) in page order; otherwise: the items of pages without any."""
    known = with_urls(rules)
    base = known[-1][1] if known else ""
    schema = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("item", pa.list_(pa.string()))])

    def find(page_id: int | None, url: str | None, page: str) -> Iterator[tuple]:
        root = html.parse(page)
        items = replay_grouped(rules, root, url or base, attr_fuzz_ratio)
        for i, item in enumerate(items or (otherwise(url, root) if otherwise is not None else [])):
            yield page_id, i, item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return html.page_batches(batches, find, schema)

    return html.pages_of(pages).mapInArrow(run, "page_id bigint, pos int, item array<string>")
