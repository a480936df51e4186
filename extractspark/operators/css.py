"""CSS selectors over a page's tree, matched in the parsing pass.

Names, *, #id, .class, attributes (= ~= |= ^= $= *= != and the flag i), the combinators blank > + ~, lists by commas, and
the pseudo-classes of place, :not, :is, :where, :has, :empty, :root and :contains.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from ..sources.html import DOCUMENT, Element, Text

_IDENT = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_BETWEEN = re.compile(r"\s*([>+~,])\s*|\s+")
_PART = re.compile(
    rf"(?P<name>\*|{_IDENT})|#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})"
    r"|\[\s*(?P<key>[\w:.-]+)\s*(?:(?P<how>[~|^$*!]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\s\]\"']+)\s*(?P<case>[iIsS])?\s*)?\]"
    r"|::?(?P<pseudo>[\w-]+)(?P<open>\()?"
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*", re.I)
PLACES = {"first-child": (False, False, (0, 1)), "last-child": (True, False, (0, 1)), "first-of-type": (False, True, (0, 1)), "last-of-type": (True, True, (0, 1))}
COUNTED = {"nth-child": (False, False), "nth-last-child": (True, False), "nth-of-type": (False, True), "nth-last-of-type": (True, True)}


@dataclass(frozen=True)
class Compound:
    """What one element must show: a name, and tests (kind, then what it takes)."""

    name: str
    tests: tuple[tuple, ...]


#: Combinators and compounds from left to right; the first combinator is empty but in a relative selector.
Chain = list[tuple[str, Compound]]


def _wrong(text: str) -> ValueError:
    return ValueError(f"Not a supported selector: {text!r}")


def _bare(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _argument(text: str, at: int) -> int:
    """Where the bracket that opens before at closes."""
    depth, quote = 1, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
    raise _wrong(text)


def _nth(text: str) -> tuple[int, int]:
    m = _NTH.fullmatch(text)
    if m is None:
        raise _wrong(text)
    if m["word"]:
        return 2, 1 if m["word"].lower() == "odd" else 0
    if m["only"]:
        return 0, int(m["only"])
    a = {"": 1, "+": 1, "-": -1}.get(m["a"])
    return int(m["a"]) if a is None else a, int(f"{m['sign']}{m['b']}") if m["b"] else 0


def _compound(text: str, at: int) -> tuple[Compound, int]:
    name, tests, start = "*", [], at
    while at < len(text) and (m := _PART.match(text, at)) and (m["name"] is None or at == start):
        at = m.end()
        if m["name"]:
            name = _bare(m["name"])
        elif m["id"]:
            tests.append(("id", _bare(m["id"])))
        elif m["cls"]:
            tests.append(("class", _bare(m["cls"])))
        elif m["key"]:
            value = m["value"]
            tests.append(("attribute", m["key"].lower(), m["how"] or "", value[1:-1] if value and value[0] in "\"'" else value or "", (m["case"] or "").lower() == "i"))
        else:
            word, inner = m["pseudo"].lower(), ""
            if m["open"]:
                stop = _argument(text, at)
                inner, at = text[at:stop].strip(), stop + 1
            if word in PLACES:
                tests.append(("place", *PLACES[word]))
            elif word in ("only-child", "only-of-type"):
                tests += [("place", back, word == "only-of-type", (0, 1)) for back in (False, True)]
            elif word in COUNTED and inner:
                tests.append(("place", *COUNTED[word], _nth(inner)))
            elif word in ("not", "is", "where", "matches") and inner:
                tests.append(("not" if word == "not" else "is", tuple(map(tuple, parse(inner)))))
            elif word == "has" and inner:
                tests.append(("has", tuple(map(tuple, parse(inner, relative=True)))))
            elif word in ("contains", "-soup-contains") and inner:
                tests.append(("contains", inner[1:-1] if inner[0] in "\"'" else inner))
            elif word in ("empty", "root") and not inner:
                tests.append((word,))
            else:
                raise _wrong(text)
    if at == start:
        raise _wrong(text)
    return Compound(name.lower(), tuple(tests)), at


def parse(text: str, relative: bool = False) -> list[Chain]:
    """The chains of a selector list."""
    source, chains, chain, how, at = text.strip(), [], [], "", 0
    if not source:
        raise ValueError("an empty selector")
    while at < len(source):
        if m := _BETWEEN.match(source, at):
            at, mark = m.end(), m[1]
            if mark == ",":
                if not chain or how:
                    raise _wrong(text)
                chains.append(chain)
                chain = []
            elif mark:
                if how or not chain and not relative:
                    raise _wrong(text)
                how = mark
            elif chain and not how:
                how = " "
            continue
        compound, at = _compound(source, at)
        if chain and not how:
            raise _wrong(text)
        chain.append((how or (" " if relative and not chain else ""), compound))
        how = ""
    if not chain or how.strip():
        raise _wrong(text)
    return [*chains, chain]


class Selector:
    """A parsed selector and what is known of the tree it is matched with."""

    def __init__(self, text: str) -> None:
        self.chains = parse(text)
        self.places: dict[int, dict[int, tuple[int, int, int, int]]] = {}
        self.known: dict[tuple, bool] = {}

    def matches(self, e: Element) -> bool:
        return any(self._chain(e, chain, len(chain) - 1, None) for chain in self.chains)

    def _place(self, e: Element) -> tuple[int, int, int, int]:
        """Place among all siblings and among those of its name, from the start and from the end, from 1."""
        around = self.places.get(id(e.parent))
        if around is None:
            own = e.parent.elements
            names: dict[str, list[Element]] = {}
            for c in own:
                names.setdefault(c.name, []).append(c)
            typed = {id(c): (i, len(same) + 1 - i) for same in names.values() for i, c in enumerate(same, 1)}
            around = self.places[id(e.parent)] = {id(c): (i, len(own) + 1 - i, *typed[id(c)]) for i, c in enumerate(own, 1)}
        return around[id(e)]

    def _before(self, e: Element) -> Iterable[Element]:
        """The siblings before e, the nearest first."""
        return reversed(e.parent.elements[: self._place(e)[0] - 1])

    def _related(self, e: Element, how: str) -> Iterable[Element]:
        """What stands to the left of a combinator, if e stands to its right."""
        if how in (" ", ">"):
            above = []
            up = e.parent
            while up is not None and up.name != DOCUMENT:
                above.append(up)
                if how == ">":
                    break
                up = up.parent
            return above
        before = self._before(e)
        return before if how == "~" else [x for x, _ in zip(before, range(1), strict=False)]

    def _chain(self, e: Element, chain: Chain | tuple, i: int, scope: Element | None) -> bool:
        key = (id(e), id(chain), i, id(scope))
        if key not in self.known:
            how, compound = chain[i]
            if not self.fits(e, compound):
                self.known[key] = False
            elif i == 0:
                self.known[key] = scope is None or any(x is scope for x in self._related(e, how))
            else:
                self.known[key] = any(self._chain(x, chain, i - 1, scope) for x in self._related(e, how))
        return self.known[key]

    def fits(self, e: Element, compound: Compound) -> bool:
        return compound.name in ("*", e.name) and all(getattr(self, "_place_test" if kind == "place" else f"_{kind}")(e, *rest) for kind, *rest in compound.tests)

    def _id(self, e: Element, wanted: str) -> bool:
        return e.get("id") == wanted

    def _class(self, e: Element, wanted: str) -> bool:
        return wanted in e.classes()

    def _attribute(self, e: Element, key: str, how: str, wanted: str, any_case: bool) -> bool:
        if key not in e.attrs:
            return how == "!="
        if not how:
            return True
        have = " ".join(e.get_list(key))
        if any_case:
            have, wanted = have.lower(), wanted.lower()
        if how in ("=", "!="):
            return (have == wanted) == (how == "=")
        if how == "~=":
            return bool(wanted) and wanted in have.split()
        if how == "|=":
            return have == wanted or have.startswith(f"{wanted}-")
        return bool(wanted) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[how](wanted)

    def _place_is(self, at: int, a: int, b: int) -> bool:
        return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0

    def _place_test(self, e: Element, back: bool, of_type: bool, nth: tuple[int, int]) -> bool:
        return self._place_is(self._place(e)[2 * of_type + back], *nth)

    def _not(self, e: Element, chains: tuple) -> bool:
        return not self._is(e, chains)

    def _is(self, e: Element, chains: tuple) -> bool:
        return any(self._chain(e, chain, len(chain) - 1, None) for chain in chains)

    def _has(self, e: Element, chains: tuple) -> bool:
        for chain in chains:
            pool = e.walk() if chain[0][0] in (" ", ">") else (x for s in e.parent.elements[self._place(e)[0] :] for x in (s, *s.walk()))
            if any(self._chain(x, chain, len(chain) - 1, e) for x in pool):
                return True
        return False

    def _contains(self, e: Element, wanted: str) -> bool:
        return wanted in e.text()

    def _empty(self, e: Element) -> bool:
        return not any(isinstance(c, Element) or isinstance(c, Text) and c.kind in ("text", "cdata") and c.strip() for c in e.children)

    def _root(self, e: Element) -> bool:
        return e.parent.name == DOCUMENT


def select(root: Element, selector: str, limit: int = 0) -> list[Element]:
    """The elements below root that a selector matches, in document order; at most limit of them, if there is one."""
    known, found = Selector(selector), []
    for e in root.walk():
        if known.matches(e):
            found.append(e)
            if limit and len(found) == limit:
                break
    return found


def select_one(root: Element, selector: str) -> Element | None:
    return next(iter(select(root, selector, 1)), None)


def matches(e: Element, selector: str) -> bool:
    return Selector(selector).matches(e)


def closest(e: Element, selector: str) -> Element | None:
    """The element itself or its nearest ancestor that matches."""
    known = Selector(selector)
    here: Element | None = e
    while here is not None and here.name != DOCUMENT:
        if known.matches(here):
            return here
        here = here.parent
    return None


def filtered(e: Element, selector: str) -> list[Element]:
    """The children that match."""
    known = Selector(selector)
    return [c for c in e.elements if known.matches(c)]
