"""The session: learn from examples, extract from single pages or from tables of pages, keep the model.

Every extraction takes ``html`` (and ``url``) for one page and returns plain lists and dicts, or ``pages``, a DataFrame
(page_id, url, html), and returns a DataFrame.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions import typed
from ..functions.urls import domain_of
from ..operators import adaptive, css, detect, flexible, replay, rules, select
from ..operators.adaptive import SignatureStore
from ..operators.rules import Rule, Target
from ..sources import fetch, html, models
from ..sources.html import Element
from . import registry


class Extractor:
    def __init__(self, spark: SparkSession | None = None, adaptive: bool = False, min_similarity: float = 0.5, rate_limit: float = 0, max_retries: int = 3, retry_backoff: float = 1.0, weights: dict[str, float] | None = None) -> None:
        self.spark = spark or SparkSession.active()
        self.adaptive, self.min_similarity, self.weights = adaptive, min_similarity, weights
        self.rate_limit, self.max_retries, self.retry_backoff = rate_limit, max_retries, retry_backoff
        self.rules: list[Rule] = []
        self.group_rules: list[dict] = []
        self.fingerprints: list[dict] = []
        self.store = SignatureStore()
        self.http = fetch.Session(retries=max_retries, backoff=retry_backoff, pause=rate_limit)

    def __enter__(self) -> Extractor:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Close the connections of pages that were asked for one by one."""
        self.http.close()

    # Pages

    def page(self, page: str | None, url: str | None = None) -> str:
        """The page itself, or what its address gives."""
        if page:
            return page
        if not url:
            raise ValueError("html or url is needed")
        found, _, error = self.http.get(url)
        if error:
            kind, _, what = error.partition(": ")
            raise {"ValueError": ValueError, "ConnectionError": ConnectionError, "TimeoutError": TimeoutError}.get(kind, RuntimeError)(what)
        return found or ""

    def fetch(self, urls: DataFrame, **options: Any) -> DataFrame:
        return fetch.fetch(urls, rate_limit=self.rate_limit, retries=self.max_retries, backoff=self.retry_backoff, **options)

    def one(self, page: str | None, url: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(0, url, self.page(page, url))], "page_id bigint, url string, html string")

    # Learning

    def build(self, html: str | None = None, wanted_list: list[Target] | None = None, wanted_dict: dict[str, Any] | None = None, url: str | None = None, update: bool = False, text_fuzz_ratio: float = 1.0) -> list[str]:
        """Learn rules for the example values; returns what they find on the page."""
        wanted = {"": list(wanted_list)} if wanted_list else {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in (wanted_dict or {}).items() if v}
        if not any(wanted.values()):
            raise ValueError("give at least one example value")
        learned, values, found = rules.learn(self.page(html, url), wanted, url or "", text_fuzz_ratio)
        self._keep(learned, update, url)
        if values:
            self.fingerprints = (self.fingerprints if update else []) + flexible.fingerprint_of(values)
        if self.adaptive:
            seen: set[str] = set()
            for e, r in found:
                if r.stack_id not in seen:
                    seen.add(r.stack_id)
                    self.store.save(domain_of(url), r.stack_id, {**adaptive.signature(e, url or ""), "alias": r.alias})
        return values

    def _keep(self, learned: list[Rule], update: bool, url: str | None) -> None:
        if not update and self.adaptive:
            self.store.clear_domain(domain_of(url))
        self.rules = rules.distinct([*(self.rules if update else []), *learned])

    def build_grouped(self, html: str | None = None, wanted_list: list[list[Target]] | None = None, url: str | None = None, update: bool = False, text_fuzz_ratio: float = 1.0) -> list[list[str]]:
        """Learn a rule for each field of the example items; returns the items on the page."""
        if not wanted_list:
            raise ValueError("give at least one example value")
        if not all(isinstance(x, (list, tuple)) for x in wanted_list):
            raise ValueError("wanted_list must be a list of lists")
        page = self.page(html, url)
        learned, groups, elements = rules.learn_grouped(page, wanted_list, url or "", text_fuzz_ratio)
        if not update and self.adaptive:
            self.store.clear_domain(domain_of(url))
        self.rules = [*(self.rules if update else []), *learned]
        for i, r in enumerate(self.rules):
            r.seq = i
        self.group_rules = groups
        for g, a, e in elements if self.adaptive else ():
            self.store.save(domain_of(url), f"group_{g}_attr_{a}", {**adaptive.signature(e, url or ""), "group_id": g, "attr_index": a})
        return self.get_result_grouped(html=page, url=url)

    def adaptive_build(self, html: str | None = None, wanted_list: list[Target] | None = None, wanted_dict: dict[str, Any] | None = None, url: str | None = None, text_fuzz_ratio: float = 1.0, auto_save: bool = True) -> list[str]:
        """build, and for each rule the signature of the first element that shows its first value."""
        page = self.page(html, url)
        values = self.build(page, wanted_list, wanted_dict, url, False, text_fuzz_ratio)
        root = _parse(page)
        for r in self.rules if auto_save else ():
            found = [v for e in rules.replay_similar(r, root) if (v := rules.value_of(e, r, url or ""))]
            e = next((e for e in root.walk() if found and e.text().strip() == found[0]), None)
            if e is not None:
                self.store.save(domain_of(url), r.alias or r.stack_id, {**adaptive.signature(e, url or ""), "alias": r.alias})
        return values

    def adaptive_save(self, element: Element, identifier: str, url: str = "") -> bool:
        return self.store.save(domain_of(url), identifier, adaptive.signature(element, url))

    # Replaying

    def _result(self, page: str | None, url: str | None, pages: DataFrame | None, exactly: bool, grouped: bool, group_by_alias: bool, unique: bool | None, attr_fuzz_ratio: float, keep_blank: bool, keep_order: bool = False, sibling_leaves: bool = False) -> Any:
        table = pages if pages is not None else self.one(page, url)
        by = "alias" if group_by_alias else "stack_id" if grouped else None
        otherwise = adaptive.fallback(self.store, self.min_similarity, self.weights) if self.adaptive else None
        rows = replay.in_trees(table, self.rules, exactly, attr_fuzz_ratio, sibling_leaves, keep_blank, otherwise)
        out = replay.results(rows, by, unique, keep_order)
        return out if pages is not None else _plain(out, by)

    def get_result_similar(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, grouped: bool = False, group_by_alias: bool = False, unique: bool | None = None, attr_fuzz_ratio: float = 1.0, keep_blank: bool = False, keep_order: bool = False, contain_sibling_leaves: bool = False) -> Any:
        return self._result(html, url, pages, False, grouped, group_by_alias, unique, attr_fuzz_ratio, keep_blank, keep_order, contain_sibling_leaves)

    def get_result_exact(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, grouped: bool = False, group_by_alias: bool = False, unique: bool | None = None, attr_fuzz_ratio: float = 1.0, keep_blank: bool = False) -> Any:
        return self._result(html, url, pages, True, grouped, group_by_alias, unique, attr_fuzz_ratio, keep_blank)

    def get_result(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, **options: Any) -> tuple[Any, Any]:
        """What similar and what exact replay find."""
        page = self.page(html, url) if pages is None else None
        return self.get_result_similar(page, url, pages, **options), self.get_result_exact(page, url, pages, **options)

    def get_result_grouped(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, attr_fuzz_ratio: float = 1.0, output_format: str = "list") -> Any:
        table = pages if pages is not None else self.one(html, url)
        found = replay.grouped(table, self.rules, attr_fuzz_ratio, adaptive.items_of(self.store) if self.adaptive else None)
        if pages is not None:
            return found
        return [(tuple if output_format == "tuple" else list)(r["item"]) for r in found.orderBy("pos").collect()]

    def get_result_flexible(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, grouped: bool = False, group_by_alias: bool = False, unique: bool | None = None, min_content_score: float = 0.4) -> Any:
        if not self.fingerprints:
            return self.get_result_similar(html, url, pages)
        table = pages if pages is not None else self.one(html, url)
        rows = flexible.extract(table, self.fingerprints, min_content_score)
        rows = rows.select("page_id", F.col("fp_key").alias("stack_id"), "alias", F.lit(0).alias("seq"), F.col("pos").alias("node_id"), "value")
        by = "alias" if group_by_alias else "stack_id" if grouped else None
        out = replay.results(rows, by, True if unique is None else unique)
        return out if pages is not None else _plain(out, by)

    def get_result_adaptive(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, identifiers: list[str] | None = None, min_similarity: float | None = None, group_by_identifier: bool = False) -> Any:
        table = pages if pages is not None else self.one(html, url)
        found = adaptive.find(table, self.store, identifiers, self.min_similarity if min_similarity is None else min_similarity, self.weights)
        if pages is not None:
            return found
        rows = found.collect()
        return {r["identifier"]: [r["value"]] for r in rows} if group_by_identifier else [r["value"] for r in rows]

    def adaptive_find(self, identifier: str, html: str | None = None, url: str | None = None, selector: str | None = None, min_similarity: float | None = None) -> tuple[Element | None, float, list[tuple[Element, float]]]:
        """The best element for a stored signature, its score, and all that reach the threshold."""
        page = self.page(html, url)
        stored = self.store.retrieve(domain_of(url), identifier)
        if stored is None:
            return None, 0.0, []
        root = _parse(page)
        among = css.select(root, selector) if selector else None
        every = adaptive.best_matches(root, stored, self.min_similarity if min_similarity is None else min_similarity, url or "", self.weights, among)
        return (*every[0], every) if every else (None, 0.0, [])

    def find_similar_elements(self, reference: Element, html: str | None = None, url: str | None = None, similarity_threshold: float = 0.6) -> list[tuple[Element, float]]:
        return adaptive.similar_elements(_parse(self.page(html, url)), reference, similarity_threshold, url or "", self.weights)

    # Rules

    def remove_rules(self, stack_ids: list[str]) -> None:
        self.rules = [r for r in self.rules if r.stack_id not in set(stack_ids)]

    def keep_rules(self, stack_ids: list[str]) -> None:
        self.rules = [r for r in self.rules if r.stack_id in set(stack_ids)]

    def set_rule_aliases(self, aliases: dict[str, str]) -> None:
        known = {r.stack_id for r in self.rules}
        if missing := aliases.keys() - known:
            raise KeyError(sorted(missing)[0])
        for r in self.rules:
            r.alias = aliases.get(r.stack_id, r.alias)

    def generate_python_code(self) -> None:
        warnings.warn("no code is generated: save the model and load it instead", DeprecationWarning, stacklevel=2)

    def save(self, file_path: str, format: str = "auto", include_adaptive: bool = True) -> None:
        models.save(models.Model(self.rules, self.group_rules, self.store.export_all(), self.fingerprints), file_path, format, include_adaptive, self.spark)

    def load(self, file_path: str, format: str = "auto", include_adaptive: bool = True) -> None:
        model = models.load(file_path, format, include_adaptive, self.spark)
        self.rules, self.group_rules, self.fingerprints = model.rules, model.group_rules, model.fingerprints
        self.store.import_all(model.signatures)

    # Without rules

    def _local(self, page: str | None, url: str | None, pages: DataFrame | None, over: Callable[[DataFrame], DataFrame], single: Callable[[Element], Any]) -> Any:
        return over(pages) if pages is not None else single(_parse(self.page(page, url)))

    def extract_data_types(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, data_types: list[str] | None = None) -> Any:
        table = detect.page_text(pages if pages is not None else self.one(html, url))
        found = table.select("page_id", typed.extract_all(F.col("text"), data_types).alias("data_types"))
        return found if pages is not None else found.first()["data_types"]

    def extract_type(self, kind: str, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        """The matches of one type; over a table, page_id and values."""
        typed.pattern(kind)
        if pages is not None:
            return detect.page_text(pages).select("page_id", typed.extract_type(F.col("text"), kind).alias("values"))
        return self.extract_data_types(html, url, data_types=[kind]).get(kind, [])

    def extract_emails(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        return self.extract_type("email", html, url, pages)

    def extract_phones(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        return self.extract_type("phone", html, url, pages)

    def extract_prices(self, html: str | None = None, url: str | None = None, parse: bool = False) -> list:
        return detect.page_text(self.one(html, url)).select(typed.extract_prices(F.col("text"), parse).alias("p")).first()["p"]

    def detect_lists(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, min_items: int = 3) -> Any:
        return self._local(html, url, pages, lambda p: detect.detect_lists(p, min_items), lambda r: detect.lists(r, min_items))

    def detect_cards(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, min_items: int = 3) -> Any:
        return self._local(html, url, pages, lambda p: detect.detect_cards(p, min_items), lambda r: detect.cards(r, min_items))

    def auto_detect_patterns(self, html: str | None = None, url: str | None = None, min_occurrences: int = 3, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, lambda p: detect.auto_detect(p, min_occurrences), lambda r: detect.patterns_of(r, min_occurrences))

    def extract_tables(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, as_dicts: bool = True) -> Any:
        drop = lambda t: t if as_dicts else {k: v for k, v in t.items() if k != "as_dicts"}
        return self._local(html, url, pages, detect.extract_tables, lambda r: [drop(t) for t in detect.tables(r)])

    def extract_table_to_csv(self, html: str | None = None, url: str | None = None, table_index: int = 0) -> str:
        return detect.table_csv(_parse(self.page(html, url)), table_index)

    def extract_structured_data(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, detect.extract_structured, detect.structured_of)

    def extract_json_ld(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, lambda p: detect.json_ld(_nodes(p, ["script"])), detect.json_ld_of)

    def extract_meta_tags(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, detect.meta_tags, detect.meta_of)

    def extract_microdata(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, detect.extract_microdata, detect.microdata_of)

    def detect_pagination(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, detect.detect_pagination, lambda r: detect.pagination(r, url))

    def get_all_page_urls(self, html: str | None = None, url: str | None = None, max_pages: int = 100, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, lambda p: detect.all_page_urls(p, max_pages), lambda r: detect.page_urls(r, url, max_pages))

    def extract_with_regex(self, pattern: str, html: str | None = None, url: str | None = None, flags: int = 0, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, lambda p: detect.found_in_text(p, pattern, flags), lambda r: re.findall(pattern, r.text(), flags))

    def extract_with_named_groups(self, pattern: str, html: str | None = None, url: str | None = None, flags: int = 0, pages: DataFrame | None = None) -> Any:
        return self._local(html, url, pages, lambda p: detect.named_in_text(p, pattern, flags), lambda r: [m.groupdict() for m in re.finditer(pattern, r.text(), flags)])

    def select(self, selector: str, html: str | None = None, url: str | None = None, pages: DataFrame | None = None, limit: int = 0) -> Any:
        """Elements by CSS; over a table, their columns."""
        return self._local(html, url, pages, lambda p: select.select_pages(p, selector, limit=limit), lambda r: css.select(r, selector, limit))

    def clean_text(self, text: str, **options: bool) -> str:
        return self.spark.createDataFrame([(text,)], "t string").select(text_functions.clean(F.col("t"), **options).alias("t")).first()["t"]

    def smart_extract(self, html: str | None = None, url: str | None = None, pages: DataFrame | None = None) -> Any:
        if pages is not None:
            return detect.smart_extract(pages)
        page = self.page(html, url)
        return {"data_types": self.extract_data_types(page, url), "patterns": self.auto_detect_patterns(page), "structured_data": self.extract_structured_data(page), "pagination": self.detect_pagination(page, url)}


def _parse(page: str) -> Element:
    return html.parse(page)


def _nodes(pages: DataFrame, names: list[str]) -> DataFrame:
    return html.nodes(pages, names=names)


def _plain(out: DataFrame, by: str | None) -> Any:
    rows = out.collect()
    return {r[by]: list(r["values"]) for r in rows} if by else list(rows[0]["values"]) if rows else []


register_functions = registry.register_functions
