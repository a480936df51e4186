"""Extraction across templates by the shape of content: fingerprints, scores, and the best group of alike positions.

The fingerprint of a table's texts is an aggregate (``fingerprint``), that of a few learned values is taken where they are
(``fingerprint_of``); both have the same figures. Scoring and the choice of a group concern one page, so they are made in
the parsing pass: no element leaves it but those that are chosen.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import html
from ..sources.html import Element

# The patterns of content types, currency signs, elements that hold no content, and the score's weights.
PRICE = r"[$€£¥₹]\s*[\d,]+\.?\d*|[\d,]+\.?\d*\s*[$€£¥₹]"
RATING = r"\d+\.?\d*\s*/\s*\d+"
URL = r"https?://"
CURRENCY = "[$€£¥₹]"
SKIPPED = ["html", "head", "body", "script", "style", "meta", "link", "br", "hr", "noscript", "iframe", "svg", "path"]
WEIGHTS = {"length": 0.15, "words": 0.15, "type": 0.30, "digits": 0.15, "currency": 0.15, "letters": 0.10}
#: What a fingerprint holds besides its key and alias.
FIGURES = ["sample_texts", "count", "avg_length", "min_length", "max_length", "std_length", "avg_word_count", "min_word_count", "max_word_count", "content_type", "has_currency", "avg_digit_ratio", "avg_alpha_ratio"]
_PRICE, _RATING, _URL, _CURRENCY = (re.compile(p) for p in (PRICE, RATING, URL, CURRENCY))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))


def share(text: Column, kind: str) -> Column:
    """Characters of a Unicode kind, as a share of all."""
    return F.regexp_count(text, F.lit(kind)) / F.greatest(F.length(text), F.lit(1))


def shape(text: Column) -> dict[str, Column]:
    return {
        "length": F.length(text), "words": words(text), "digits": share(text, r"\p{Nd}"), "letters": share(text, r"\p{L}"),
        "currency": text.rlike(CURRENCY), "price": text.rlike("(?U)" + PRICE), "rating": text.rlike("(?U)" + RATING), "url": text.rlike(URL),
    }


def content_type(price: Column, rating: Column, url: Column, digits: Column, length: Column) -> Column:
    """From shares of texts (or of one text) that look like each type, and the means of digits and length."""
    return (
        F.when(price > 0.5, "price").when(rating > 0.5, "rating").when(url > 0.5, "url").when(digits > 0.5, "number")
        .when(length > 100, "description").when(length < 15, "short_text").otherwise("text")
    )


def fingerprint(texts: DataFrame, value: str = "value", order: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row of figures for all texts, or for each value of keys."""
    keys = keys or []
    seen = texts.select(*keys, F.col(value).alias("text"), (F.col(order) if order else F.monotonically_increasing_id()).alias("at"))
    measured = seen.withColumns(shape(F.col("text")))
    mean = lambda c: F.avg(F.col(c).cast("double"))
    sample = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), 1, 10)
    made = measured.groupBy(*keys).agg(
        sample.alias("sample_texts"), F.count("*").alias("count"), mean("length").alias("avg_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.stddev_pop("length").alias("std_length"), mean("words").alias("avg_word_count"), F.min("words").alias("min_word_count"), F.max("words").alias("max_word_count"),
        content_type(mean("price"), mean("rating"), mean("url"), mean("digits"), mean("length")).alias("content_type"),
        F.bool_or("currency").alias("has_currency"), mean("digits").alias("avg_digit_ratio"), mean("letters").alias("avg_alpha_ratio"),
    )
    return made.where(F.col("count") > 0)


@dataclass(frozen=True)
class Shape:
    """The figures of one text."""

    length: int
    words: int
    digits: float
    letters: float
    currency: bool
    price: bool
    rating: bool
    url: bool

    @classmethod
    @functools.lru_cache(4096)
    def of(cls, text: str) -> Shape:
        n = len(text)
        share_of = lambda test: sum(map(test, text)) / max(n, 1)
        seen = [p.search(text) is not None for p in (_CURRENCY, _PRICE, _RATING, _URL)]
        return cls(n, len(text.split()), share_of(str.isdecimal), share_of(str.isalpha), *seen)

    def type(self) -> str:
        return _type(self.price, self.rating, self.url, self.digits, self.length)


def _type(price: float, rating: float, url: float, digits: float, length: float) -> str:
    """content_type of plain numbers."""
    for much, kind in ((price, "price"), (rating, "rating"), (url, "url"), (digits, "number")):
        if much > 0.5:
            return kind
    return "description" if length > 100 else "short_text" if length < 15 else "text"


def fingerprint_of(values: list[str], alias: str = "") -> list[dict]:
    """The fingerprint of learned values, with its key, as plain data; none for no values."""
    if not values:
        return []
    shapes = [Shape.of(v) for v in values]
    mean = lambda name: sum(getattr(x, name) for x in shapes) / len(shapes)
    lengths, counts, middle = [x.length for x in shapes], [x.words for x in shapes], mean("length")
    figures = [
        values[:10], len(values), middle, min(lengths), max(lengths), math.sqrt(sum((n - middle) ** 2 for n in lengths) / len(lengths)), mean("words"), min(counts), max(counts),
        _type(mean("price"), mean("rating"), mean("url"), mean("digits"), middle), any(x.currency for x in shapes), mean("digits"), mean("letters"),
    ]
    key = hashlib.sha256(str(sorted(values[:5])).encode()).hexdigest()[:8]
    return [{"fp_key": key, "alias": alias, **dict(zip(FIGURES, figures, strict=True))}]


def _near(n: int, low: int, high: int) -> float:
    """1 inside the bounds, else the quotient with the nearer one."""
    return 1.0 if low <= n <= high else n / max(low, 1) if n < low else high / max(n, 1)


def score(text: str, fp: dict) -> float:
    """How well a text fits a fingerprint, 0 to 1."""
    own, kind, wanted = Shape.of(text), Shape.of(text).type(), fp["content_type"]
    in_reach = fp["min_length"] * 0.5 <= own.length <= fp["max_length"] * 2.0
    short = ("text", "short_text")
    parts = {
        "length": _near(own.length, fp["min_length"], fp["max_length"]) if in_reach else 0.0,
        "words": _near(own.words, fp["min_word_count"], fp["max_word_count"]),
        "type": 1.0 if kind == wanted else 0.7 if kind in short and wanted in short else 0.9 if wanted == "price" and own.currency else 0.0,
        "digits": max(0.0, 1 - abs(own.digits - fp["avg_digit_ratio"]) * 3),
        "currency": 1.0 if own.currency == fp["has_currency"] else 0.0 if fp["has_currency"] else 0.3,
        "letters": max(0.0, 1 - abs(own.letters - fp["avg_alpha_ratio"]) * 2),
    }
    return sum(parts[k] * weight for k, weight in WEIGHTS.items())


def candidates(root: Element) -> Iterator[tuple[Element, str]]:
    """Elements that may hold a value, and their text: with text, few children, and not just a wrapper around one."""
    for e in root.walk():
        own = e.elements
        if e.name not in SKIPPED and len(own) <= 3 and (text := e.tight()) and not (len(own) == 1 and own[0].tight() == text):
            yield e, text


def best(root: Element, fingerprints: list[dict], least: float = 0.4) -> Iterator[tuple[dict, Element, str, float]]:
    """Each fingerprint's best group of positions, best first; without a group, as many single elements as were learned."""
    pool = list(candidates(root)) if fingerprints else []
    for fp in fingerprints:
        groups: dict[tuple, list[tuple[Element, str, float]]] = {}
        for e, text in pool:
            if (s := score(text, fp)) >= least:
                up = e.parent
                groups.setdefault((up.parent.name if up.parent is not None else "", up.name, " ".join(up.classes()), e.name), []).append((e, text, s))
        wanted = fp["count"]

        def rank(group: list[tuple[Element, str, float]], wanted: int = wanted) -> tuple[float, int]:
            mean = sum(s for *_, s in group) / len(group)
            return mean * 0.6 + min(len(group), wanted) / max(len(group), wanted) * 0.4, -group[0][0].number

        by_score = lambda x: (-x[2], x[0].number)
        fit = [g for g in groups.values() if len(g) >= 2 or wanted <= 1]
        found = max(fit, key=rank) if fit else sorted((x for g in groups.values() for x in g), key=by_score)[: max(wanted, 1)]
        yield from ((fp, *x) for x in sorted(found, key=by_score))


_FOUND = pa.schema([("page_id", pa.int64()), ("fp_key", pa.string()), ("alias", pa.string()), ("pos", pa.int32()), ("node_id", pa.int32()), ("value", pa.string()), ("score", pa.float64())])


def extract(pages: DataFrame, fingerprints: list[dict], min_content_score: float = 0.4) -> DataFrame:
    """page_id, fp_key, alias, pos, node_id, value and score: what ``best`` finds on each page."""

    def rows(page_id: int | None, url: str | None, page: str) -> Iterator[tuple]:
        nth: Counter = Counter()
        for fp, e, text, s in best(html.parse(page), fingerprints, min_content_score):
            yield page_id, fp["fp_key"], fp["alias"], nth[fp["fp_key"]], e.number, text, s
            nth[fp["fp_key"]] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return html.page_batches(batches, rows, _FOUND)

    return html.pages_of(pages).mapInArrow(run, "page_id bigint, fp_key string, alias string, pos int, node_id int, value string, score double")
