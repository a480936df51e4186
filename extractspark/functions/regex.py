"""A caller's regular expressions over text columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..deploy import ship_active


def _java(pattern: str, flags: int) -> str:
    marks = "".join(m for bit, m in ((re.I, "i"), (re.M, "m"), (re.S, "s"), (re.X, "x")) if flags & bit)
    return f"(?U{marks})" + pattern.replace("(?P<", "(?<")


def extract(text: Column, pattern: str, flags: int = 0) -> Column:
    """All matches: the whole match, the one group, or a struct of the groups g1, g2, ..."""
    groups, java = re.compile(pattern).groups, F.lit(_java(pattern, flags))
    if groups < 2:
        return F.regexp_extract_all(text, java, F.lit(groups))
    return F.arrays_zip(*[F.regexp_extract_all(text, java, F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)])


extract_groups = extract


def extract_named(text: Column, pattern: str, flags: int = 0) -> Column:
    """A map from group name to value for each match; a group that takes no part is null, which the JVM can't tell."""
    ship_active()
    names = list(re.compile(pattern).groupindex)

    @F.pandas_udf("array<map<string,string>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = re.compile(pattern, flags)
        for part in texts:
            yield part.map(lambda t: None if t is None else [{n: m[n] for n in names} for m in known.finditer(t)])

    return find(text)


def replace(text: Column, pattern: str, replacement: str, flags: int = 0) -> Column:
    r"""Matches replaced; \1 and \g<name> name groups, $ is an ordinary character."""
    java = re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: "${" + m[1] + "}" if m[1] and not m[1].isdigit() else "$" + (m[1] or m[2]), replacement.replace("$", r"\$"))
    return F.regexp_replace(text, F.lit(_java(pattern, flags)), F.lit(java))
