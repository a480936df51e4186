"""Selecting elements: by name, attributes, text and CSS, and along the axes of the tree.

Everything here is a filter or a join on the columns of ``nodes``; joins carry page_id, so they are hash joins with the
interval as a further condition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import html
from . import css


def attribute(name: str) -> Column:
    """An attribute as one string; null if it isn't there."""
    return F.array_join(F.col("attrs")[name], " ")


def has_attribute(name: str) -> Column:
    return F.map_contains_key("attrs", F.lit(name))


def attribute_is(name: str, wanted: str | bool | re.Pattern | list[str]) -> Column:
    """True: present; a string: one of the values or all of them; empty: absent or empty; a pattern: found in one."""
    values, whole = F.col("attrs")[name], attribute(name)
    if wanted is True:
        return has_attribute(name)
    if isinstance(wanted, re.Pattern):
        java = ("(?i)" if wanted.flags & re.I else "") + wanted.pattern
        return F.coalesce(F.exists(values, lambda v: v.rlike(java)) | whole.rlike(java), F.lit(False))
    if not wanted:
        return F.coalesce(whole, F.lit("")) == ""
    wanted = [wanted] if isinstance(wanted, str) else wanted
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted))) | whole.isin(*wanted), F.lit(False))


def find_all(nodes: DataFrame, name: str | list[str] | re.Pattern | None = None, attrs: dict | None = None, string: str | re.Pattern | None = None, limit: int | None = None) -> DataFrame:
    """Elements by name, attributes and single string; with a limit, the first of each page."""
    where = F.lit(True)
    if isinstance(name, re.Pattern):
        where &= F.col("name").rlike(name.pattern)
    elif name is not None:
        where &= F.col("name").isin([name] if isinstance(name, str) else name)
    for key, wanted in (attrs or {}).items():
        where &= attribute_is(key, wanted)
    if isinstance(string, re.Pattern):
        where &= F.col("single_string").rlike(("(?i)" if string.flags & re.I else "") + string.pattern)
    elif string is not None:
        where &= F.col("single_string") == string
    found = nodes.where(where)
    if limit is None:
        return found
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


#: Axis: what a related element (other) is to an element (here).
AXES = {
    "children": lambda here, other: other["parent_id"] == here["node_id"],
    "descendants": lambda here, other: (other["node_id"] > here["node_id"]) & (other["node_id"] <= here["last_desc"]),
    "parent": lambda here, other: other["node_id"] == here["parent_id"],
    "ancestors": lambda here, other: (other["node_id"] < here["node_id"]) & (other["last_desc"] >= here["node_id"]),
    "next_siblings": lambda here, other: (other["parent_id"] == here["parent_id"]) & (other["node_id"] > here["node_id"]),
    "previous_siblings": lambda here, other: (other["parent_id"] == here["parent_id"]) & (other["node_id"] < here["node_id"]),
    "following": lambda here, other: other["node_id"] > here["node_id"],
    "preceding": lambda here, other: other["node_id"] < here["node_id"],
}


def related(here: DataFrame, others: DataFrame, axis: str) -> DataFrame:
    """The columns of the related elements, and from_id: the element they are related to."""
    if axis not in AXES:
        raise ValueError(f"Unknown axis: {axis}. Available: {list(AXES)}")
    a = here.select("page_id", F.col("node_id").alias("from_id"), "parent_id", "last_desc", "node_id").alias("a")
    b = others.alias("b")
    column = lambda side: {c: F.col(f"{side}.{c}") for c in ("node_id", "parent_id", "last_desc")}
    return a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & AXES[axis](column("a"), column("b"))).select("from_id", "b.*")


def _simple(compound: css.Compound) -> Column:
    where = F.lit(True) if compound.name == "*" else F.col("name") == compound.name
    for kind, *rest in compound.tests:
        if kind == "class":
            where &= F.array_contains("cls", rest[0])
        elif kind == "id":
            where &= F.coalesce(attribute("id") == rest[0], F.lit(False))
        elif kind == "attribute":
            key, how, value, any_case = rest
            whole = F.lower(attribute(key)) if any_case else attribute(key)
            value = value.lower() if any_case else value
            tests = {"": has_attribute(key), "=": whole == value, "!=": F.coalesce(whole != value, F.lit(True)), "^=": whole.startswith(value), "$=": whole.endswith(value), "*=": whole.contains(value), "~=": F.array_contains(F.split(whole, r"\s+"), value), "|=": whole.rlike(f"^{re.escape(value)}(-|$)")}
            where &= F.coalesce(tests[how], F.lit(False)) & F.lit(how not in ("^=", "$=", "*=", "~=") or value != "")
        else:
            raise ValueError(f":{kind} looks around in the tree: use select_pages")
    return where


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """Elements by CSS, relationally: names, .class, #id, [attribute], the combinators blank > + ~ and commas."""
    found = None
    for chain in css.parse(selector):
        here = None
        for how, compound in chain:
            if here is None:
                here = nodes.where(_simple(compound))
                continue
            step = related(here, nodes, {">": "children", " ": "descendants"}.get(how, "next_siblings"))
            if how == "+":
                step = step.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "from_id").orderBy("node_id"))).where("nth = 1").drop("nth")
            here = step.where(_simple(compound)).drop("from_id").dropDuplicates(["page_id", "node_id"])
        found = here if found is None else found.unionByName(here).dropDuplicates(["page_id", "node_id"])
    return found


def select_pages(pages: DataFrame, selector: str, columns: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Elements by CSS with all that ``css`` knows, found in the parsing pass: no join. limit: the first of each page."""
    css.parse(selector)  # a wrong selector fails here, not in a task
    return html.nodes(pages, columns=columns, chosen=lambda root: css.select(root, selector, limit))
