"""Extraction rules: learned from example values on one page, replayed over a page's tree.

A rule is the chain of levels from the top element to the target: tag, class, style, and the target's place among the
children that fit each level. Training works on one page, so it runs where it is called; replaying works on any number of
pages and runs on the executors (see replay).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any
from urllib.parse import urljoin

from ..functions.similarity import ratio
from ..sources.html import Element, normalize, parse

Target = str | re.Pattern


@dataclass(frozen=True)
class Level:
    tag: str
    cls: tuple[str, ...]
    style: str
    place: int


@dataclass
class Rule:
    levels: list[Level]
    wanted_attr: str | None = None
    is_full_url: bool = False
    is_non_rec_text: bool = False
    url: str = ""
    alias: str = ""
    group_index: int | None = None
    attr_index: int | None = None
    hash: str = ""
    stack_id: str = ""
    seq: int = field(default=0, compare=False)

    def __post_init__(self) -> None:
        self.levels = [x if isinstance(x, Level) else Level(x["tag"], tuple(x["cls"]), x["style"], x["place"]) for x in self.levels]
        if not self.hash:
            own = [[asdict(x) for x in self.levels], self.wanted_attr, self.is_full_url, self.is_non_rec_text, self.url]
            self.hash = hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()
            self.stack_id = f"rule_{self.hash[:8]}"

    @property
    def path(self) -> str:
        return "/".join(x.tag for x in self.levels)


def same(wanted: Target, found: str, limit: float = 1.0) -> bool:
    """A pattern must match all of it; below a limit of 1 similar text will do."""
    if isinstance(wanted, re.Pattern):
        return wanted.fullmatch(found) is not None
    return wanted == found if limit >= 1 else ratio(wanted, found) >= limit


def fits(e: Element, level: Level, limit: float = 1.0) -> bool:
    """Same tag; classes share one or are equal as a whole; same style; a level without either asks for none."""
    if e.name != level.tag:
        return False
    alike = (lambda a, b: a == b) if limit >= 1 else (lambda a, b: ratio(a, b) >= limit)
    have, style = e.classes(), e.style()
    whole = " ".join(have)
    if (not whole) if not level.cls else any(alike(w, h) for w in level.cls for h in (*have, whole)):
        return style == "" if level.style == "" else alike(level.style, style)
    return False


def level_of(e: Element) -> Level:
    here = Level(e.name, tuple(e.classes()), e.style(), 0)
    rivals = [c for c in e.parent.elements if fits(c, here)]
    # Equal twins can't be told apart: the first counts.
    place = next((i for i, c in enumerate(rivals) if c is e or c.digest() == e.digest()), 0)
    return Level(here.tag, here.cls, here.style, place)


@dataclass(frozen=True)
class Match:
    element: Element
    wanted_attr: str | None = None
    is_full_url: bool = False
    is_non_rec_text: bool = False


def match(e: Element, wanted: Target, url: str = "", limit: float = 1.0) -> Match | None:
    """How an element shows the target: as its text, its own text, an attribute, or a link's full address."""
    text = e.text().strip()
    if same(wanted, text, limit):
        # Of elements that hold nothing else, the outermost is meant.
        return None if e.parent.parent is not None and e.parent.text().strip() == text else Match(e)
    if same(wanted, e.own(), limit):
        return Match(e, is_non_rec_text=True)
    for key, value in e.attrs.items():
        if isinstance(value, str):
            if same(wanted, value.strip(), limit):
                return Match(e, key)
            if key in ("href", "src") and same(wanted, urljoin(url, value.strip()), limit):
                return Match(e, key, is_full_url=True)
    return None


def matches(root: Element, wanted: Target, url: str = "", limit: float = 1.0) -> list[Match]:
    """All elements that show the target, the last in the page first."""
    wanted = normalize(wanted) if isinstance(wanted, str) else wanted
    return [m for e in reversed(list(root.walk())) if (m := match(e, wanted, url, limit)) is not None]


def rule_for(m: Match, url: str = "", **more: Any) -> Rule:
    levels = [level_of(e) for e in m.element.path()]
    return Rule(levels, m.wanted_attr, m.is_full_url, m.is_non_rec_text, url if m.is_full_url else "", **more)


def distinct(rules: Iterable[Rule]) -> list[Rule]:
    """One rule for each hash, the first; numbered in order."""
    kept = list({r.hash: r for r in reversed(list(rules))}.values())[::-1]
    for i, r in enumerate(kept):
        r.seq = i
    return kept


def value_of(e: Element, rule: Rule, url: str) -> str | None:
    if rule.wanted_attr is None:
        return e.own() if rule.is_non_rec_text else e.text().strip()
    value = e.attrs.get(rule.wanted_attr)
    if value is None:
        return None
    value = " ".join(value) if isinstance(value, list) else value
    return urljoin(url, value) if rule.is_full_url else value


def replay_similar(rule: Rule, root: Element, limit: float = 1.0, sibling_leaves: bool = False) -> list[Element]:
    """Every element at the end of a fitting chain; of fitting siblings at the last level the one at the rule's place."""
    here = [root]
    for depth, level in enumerate(rule.levels):
        found = []
        for parent in here:
            fitting = [c for c in parent.elements if fits(c, level, limit)]
            if fitting and depth == len(rule.levels) - 1 and not sibling_leaves:
                fitting = [fitting[min(len(fitting) - 1, level.place)]]
            found += fitting
        here = found
    return here


def replay_exact(rule: Rule, root: Element, limit: float = 1.0) -> list[Element]:
    """The one element that the rule's places lead to, from the page's first element."""
    here = root.elements[0] if root.elements else None
    for level in rule.levels[1:]:
        fitting = [c for c in here.elements if fits(c, level, limit)] if here is not None else []
        if not fitting:
            return []
        here = fitting[min(len(fitting) - 1, level.place)]
    return [here] if here is not None else []


def learn(page: str, wanted: dict[str, list[Target]], url: str = "", limit: float = 1.0) -> tuple[list[Rule], list[str], list[tuple[Element, Rule]]]:
    """Rules for all elements that show the targets, the distinct values they give on the page, and the elements."""
    root = parse(page)
    found = [(m.element, rule_for(m, url, alias=alias)) for alias, targets in wanted.items() for t in targets for m in matches(root, t, url, limit)]
    values = [v for _, r in found for e in replay_similar(r, root) if (v := value_of(e, r, url))]
    return distinct(r for _, r in found), list(dict.fromkeys(values)), found


def common_container(elements: list[Element]) -> Element | None:
    """The deepest element around all; of one element, its parent."""
    if not elements:
        return None
    if len(elements) == 1:
        return elements[0].parent
    chains = [set(map(id, _above(e))) for e in elements[1:]]
    return next((a for a in _above(elements[0]) if all(id(a) in c for c in chains)), None)


def _above(e: Element) -> Iterator[Element]:
    while e.parent is not None:
        e = e.parent
        yield e


def learn_grouped(page: str, items: list[list[Target]], url: str = "", limit: float = 1.0) -> tuple[list[Rule], list[dict], list[tuple[int, int, Element]]]:
    """A rule for each field of each example item, the items' containers, and the fields' elements."""
    root = parse(page)
    rules, groups, elements = [], [], []
    for g, item in enumerate(items):
        mine: list[tuple[Element, Rule]] = []
        for a, wanted in enumerate(item):
            if found := matches(root, wanted, url, limit):
                mine.append((found[0].element, rule_for(found[0], url, alias=f"group_{g}_attr_{a}", group_index=g, attr_index=a)))
                elements.append((g, a, found[0].element))
        if mine:
            around = common_container([e for e, _ in mine])
            rules += [r for _, r in mine]
            groups.append({"group_id": f"group_{g}", "container_tag": around.name, "container_class": around.classes(), "attr_count": len(item), "stack_ids": [r.stack_id for _, r in mine]})
    for i, r in enumerate(rules):
        r.seq = i
    return rules, groups, elements


def item_container(e: Element, named: dict[int, Counter]) -> Element:
    """The nearest of three ancestors that has a sibling of its name; else the parent.

    named keeps the names of each parent's children, so that they are counted once a page, not once an item.
    """
    here = e
    for _ in range(3):
        up = here.parent
        if up is None:
            break
        if up.parent is not None:
            if up.parent.number not in named:
                named[up.parent.number] = Counter(c.name for c in up.parent.elements)
            if named[up.parent.number][up.name] >= 2:
                return up
        here = up
    return e.parent if e.parent is not None else e


def replay_grouped(rules: list[Rule], root: Element, url: str = "", limit: float = 1.0) -> list[list[str]]:
    """Items with a value for each field, in page order; a missing field is empty; equal items count once."""
    fields = [r for r in rules if r.group_index is not None]
    if not fields:
        return [[v] for r in rules for e in replay_similar(r, root, limit) if (v := value_of(e, r, url))]
    first = {r.attr_index: r for r in reversed(fields)}
    width = max(first) + 1
    held: dict[int, list[str]] = {}
    named: dict[int, Counter] = {}
    for a, rule in first.items():
        for e in replay_similar(rule, root, limit, sibling_leaves=True):
            if value := value_of(e, rule, url):
                item = held.setdefault(item_container(e, named).number, [""] * width)
                item[a] = item[a] or value
    return [list(x) for x in dict.fromkeys(tuple(held[k]) for k in sorted(held)) if any(x)]
