"""Cleaning and cutting text."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..deploy import ship_active

# The options of clean and what they are if not given.
CLEAN = {"normalize_whitespace": True, "remove_extra_newlines": True, "strip_html_tags": False, "decode_html_entities": True, "lowercase": False, "remove_punctuation": False}


@F.pandas_udf(StringType())
def _unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _decompose(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def unescape(text: Column) -> Column:
    """Character references decoded; only text with an ampersand leaves the JVM."""
    ship_active()
    return F.when(F.contains(text, F.lit("&")), _unescape(text)).otherwise(text)


def normalize(text: Column) -> Column:
    """Stripped, in compatibility decomposition; ASCII stays in the JVM."""
    ship_active()
    return F.when(text.rlike(r"[^\x00-\x7f]"), _decompose(strip(text))).otherwise(strip(text))


def clean(text: Column, **options: bool) -> Column:
    """Decode references, strip tags, collapse blanks and blank lines, lower, drop punctuation, strip: in this order."""
    if unknown := options.keys() - CLEAN.keys():
        raise ValueError(f"Unknown options: {sorted(unknown)}. Available: {list(CLEAN)}")
    on = CLEAN | options
    if on["decode_html_entities"]:
        text = unescape(text)
    if on["strip_html_tags"]:
        text = F.regexp_replace(text, "<[^>]+>", "")
    if on["normalize_whitespace"]:
        text = F.regexp_replace(text, r"[ \t]+", " ")
    if on["remove_extra_newlines"]:
        text = F.regexp_replace(text, r"(?U)\n\s*\n+", "\n\n")
    if on["lowercase"]:
        text = F.lower(text)
    if on["remove_punctuation"]:
        text = F.regexp_replace(text, r"(?U)[^\w\s]", "")
    return strip(text)


def sentences(text: Column) -> Column:
    """Parts after a full stop, exclamation or question mark and white space; stripped, without empty ones."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def truncate(text: Column, max_length: int = 200, suffix: str = "...") -> Column:
    """At most max_length characters: cut at the last space, if there is one after the first character, then the suffix."""
    keep = max_length - len(suffix)
    head = F.substring(text, 1, keep) if keep >= 0 else F.expr("''")
    at_space = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(text) <= max_length, text).otherwise(F.concat(F.when(at_space != "", at_space).otherwise(head), F.lit(suffix)))


@F.pandas_udf(StringType())
def _compose(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def compose(text: Column) -> Column:
    """In canonical composition, the form that most stores expect."""
    ship_active()
    return F.when(text.rlike(r"[^\x00-\x7f]"), _compose(text)).otherwise(text)
