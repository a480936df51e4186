"""The functions under SQL names, and pages as a table function: SELECT * FROM pages, LATERAL html_nodes(html)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..deploy import ship
from ..functions.similarity import fuzzy_match, fuzzy_ratio
from ..functions.urls import domain_of
from ..sources.html import parse


class HtmlNodes:
    def eval(self, page: str) -> Iterator[tuple]:
        for e in parse(page or "").walk():
            yield e.number, e.parent.number, e.name, len(e.path()) - 1, e.classes(), e.tight()


def register_functions(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("html_nodes", udtf(HtmlNodes, returnType="node_id int, parent_id int, name string, depth int, cls array<string>, text_strip string"))
    for name, function, kind in (
        ("fuzzy_ratio", fuzzy_ratio, "double"),
        ("fuzzy_match", fuzzy_match, "boolean"),
        ("url_domain", domain_of, "string"),
        ("url_join", lambda a, b: None if b is None else urljoin(a or "", b), "string"),
        ("html_unescape", lambda t: None if t is None else unescape(t), "string"),
        ("text_normalize", lambda t: None if t is None else unicodedata.normalize("NFKD", t.strip()), "string"),
    ):
        spark.udf.register(name, function, kind)
