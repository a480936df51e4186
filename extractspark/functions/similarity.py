"""Similarity of texts and of elements' signatures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..deploy import ship_active

# Weights of the parts of a signature, and the attributes that are compared once more.
WEIGHTS = {"tag_name": 0.15, "attributes": 0.20, "text": 0.15, "path": 0.10, "parent": 0.15, "grandparent": 0.10, "children": 0.10, "special_attrs": 0.05}
SPECIAL = ["class", "id", "href", "src", "data-id", "name"]


Like = Callable[[Any, Any], float]


def ratio(a: Any, b: Any) -> float:
    return SequenceMatcher(None, a, b).ratio()


def bound(a: Any, b: Any) -> float:
    """At least ratio(a, b): by the letters that both have, whatever their order."""
    total = len(a) + len(b)
    return 2.0 * (Counter(a) & Counter(b)).total() / total if total else 1.0


def reaches(a: str, b: str, limit: float) -> bool:
    """Whether ratio(a, b) is at least limit; the bounds by length and by letters come first."""
    total = len(a) + len(b)
    return not total or (2.0 * min(len(a), len(b)) / total >= limit and bound(a, b) >= limit and ratio(a, b) >= limit)


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def fuzzy_ratio(a: str | None, b: str | None) -> float:
    """0 if either is empty, 1 if equal but for case and blanks, else the sequence matcher's ratio."""
    if not a or not b:
        return 0.0
    a, b = plain(a), plain(b)
    return 1.0 if a == b else ratio(a, b)


def fuzzy_match(a: str | None, b: str | None, limit: float = 0.8) -> bool:
    """Equal, one in the other, or similar enough; never if either is empty."""
    if not a or not b:
        return False
    x, y = plain(a), plain(b)
    return x == y or x in y or y in x or reaches(x, y, limit)


class TextMatcher:
    """fuzzy_match with a limit of its own, for texts and for columns."""

    def __init__(self, limit: float = 0.8) -> None:
        self.limit = limit

    def matches(self, a: str | None, b: str | None) -> bool:
        return fuzzy_match(a, b, self.limit)

    def ratio(self, a: str | None, b: str | None) -> float:
        return fuzzy_ratio(a, b)

    def best(self, text: str, candidates: list[str]) -> tuple[str, float] | None:
        """The most similar candidate that reaches the limit, the first of equal ones, and its ratio."""
        scored = [(c, fuzzy_ratio(text, c)) for c in candidates]
        found = max(scored, key=lambda x: x[1], default=None)
        return found if found is not None and found[1] >= self.limit else None

    def like(self, a: Column, b: Column) -> Column:
        return text_like(a, b, self.limit)


def _either(a: Any, b: Any, one_missing: float) -> float | None:
    """The score if one of the two or both are missing."""
    if not a and not b:
        return 1.0
    return one_missing if not a or not b else None


def _value(v: Any) -> str:
    return " ".join(sorted(map(str, v))) if isinstance(v, (list, tuple)) and len(v) != 1 else str(v[0]) if isinstance(v, (list, tuple)) else str(v or "")


def text_score(a: str, b: str, like: Like = ratio) -> float:
    known = _either(a, b, 0.0)
    return like(plain(a), plain(b)) if known is None else known


def attribute_score(a: dict, b: dict, like: Like = ratio) -> float:
    known = _either(a, b, 0.3)
    if known is not None:
        return known
    keys, total = a.keys() | b.keys(), 0.0
    for k in keys:
        x, y = _value(a.get(k)), _value(b.get(k))
        total += 1.0 if x == y else like(x, y) if x and y else 0.0
    return total / len(keys)


def path_score(a: str, b: str, like: Like = ratio) -> float:
    known = _either(a, b, 0.0)
    if known is not None:
        return known
    x, y = a.split("/"), b.split("/")
    shorter, tail = min(len(x), len(y)), 0
    while tail < shorter and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    return 0.4 * like(x, y) + 0.6 * tail / shorter


def special_score(a: dict, b: dict, like: Like = ratio) -> float:
    pairs = [(x, y) for k in SPECIAL if (x := _value(a.get(k))) or _value(b.get(k)) for y in [_value(b.get(k))]]
    return sum(1.0 if x == y else like(x, y) if x and y else 0.0 for x, y in pairs) / len(pairs) if pairs else 1.0


def ancestor_score(a: dict, b: dict, which: str, like: Like = ratio) -> float:
    name, attribs, text = f"{which}_name", f"{which}_attribs", f"{which}_text"
    known = _either(a.get(name), b.get(name), 0.3)
    if known is not None:
        return known
    scores = [float(a[name] == b[name]), attribute_score(a.get(attribs) or {}, b.get(attribs) or {}, like)]
    if a.get(text) or b.get(text):
        scores.append(text_score(a.get(text) or "", b.get(text) or "", like))
    return sum(scores) / len(scores)


def signature_score(a: dict, b: dict, weights: dict[str, float] | None = None, like: Like = ratio) -> float:
    """Weighted mean of the parts' scores, rounded to four places; with ``bound`` for like, no less than it."""
    w = weights or WEIGHTS
    children = _either(a.get("children_tags"), b.get("children_tags"), 0.3)
    scores = {
        "tag_name": float(a.get("tag_name") == b.get("tag_name")),
        "attributes": attribute_score(a.get("attributes") or {}, b.get("attributes") or {}, like),
        "text": text_score(a.get("text") or "", b.get("text") or "", like),
        "path": path_score(a.get("path") or "", b.get("path") or "", like),
        "parent": ancestor_score(a, b, "parent", like),
        "grandparent": ancestor_score({**a, "grandparent_text": ""}, {**b, "grandparent_text": ""}, "grandparent", like),
        "children": like(list(a["children_tags"]), list(b["children_tags"])) if children is None else children,
        "special_attrs": special_score(a.get("attributes") or {}, b.get("attributes") or {}, like),
    }
    total = sum(w[k] for k in scores)
    return round(sum(s * w[k] for k, s in scores.items()) / total, 4) if total else 0.0


def text_ratio(a: Column, b: Column) -> Column:
    """fuzzy_ratio of two columns; equal and empty ones never leave the JVM."""
    ship_active()

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([fuzzy_ratio(s, t) for s, t in zip(x, y, strict=True)], dtype=float)

    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(score(a, b))


def text_like(a: Column, b: Column, limit: float = 0.8) -> Column:
    """fuzzy_match of two columns; what holds the other, or is too unlike in length, never leaves the JVM."""
    ship_active()
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    x, y = squeeze(a), squeeze(b)

    @F.pandas_udf("boolean")
    def near(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, t in pairs:
            yield pd.Series([u is not None and v is not None and reaches(u, v, limit) for u, v in zip(s, t, strict=True)], dtype=bool)

    filled = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    lengths = F.length(x) + F.length(y)
    close = 2 * F.least(F.length(x), F.length(y)) >= lengths * limit
    return F.when(~filled, F.lit(False)).when(F.contains(x, y) | F.contains(y, x), F.lit(True)).when(close, near(x, y)).otherwise(F.lit(False))
