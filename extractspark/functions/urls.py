"""Domains and links."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..deploy import ship_active


def domain_of(url: str | None) -> str:
    """Host of a URL, or its first path segment; without port and every "www."; "default" if there is none."""
    if not url:
        return "default"
    try:
        parts = urlparse(url)
    except ValueError:
        return "default"
    host = parts.netloc or parts.path.split("/")[0]
    return host.replace("www.", "").split(":")[0] or "default"


@F.pandas_udf(StringType())
def _domain(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in urls:
        yield part.map(domain_of)


@F.pandas_udf(StringType())
def _join(bases: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([None if link is None else urljoin(base or "", link) for base, link in zip(bases, links, strict=True)], dtype=object)


#: A plain address: a scheme, a host of ASCII letters and perhaps a port, and what follows without spaces.
PLAIN = r"^[A-Za-z][A-Za-z0-9+.-]*://([A-Za-z0-9._-]+)(?::[0-9]*)?(?:[/?#][\x21-\x7e]*)?$"


def extract_domain(url: Column) -> Column:
    """domain_of; plain addresses never leave the JVM."""
    ship_active()
    host = F.regexp_replace(F.regexp_extract(url, PLAIN, 1), r"www\.", "")
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("default")).when(url.rlike(PLAIN) & (host != ""), host).otherwise(_domain(F.coalesce(url, F.lit(""))))


def resolve(base: Column, link: Column) -> Column:
    """A link as an absolute URL; null for an empty one or "#"."""
    ship_active()
    real = F.when((link != "") & (link != "#"), link)
    return F.when(F.coalesce(base, F.lit("")) == "", real).otherwise(_join(base, real))
