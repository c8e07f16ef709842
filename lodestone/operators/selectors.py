"""CSS selectors as an automaton over the stack of open elements: one step for each start tag, no tree.

Supported: tag, ``*``, ``.class``, ``#id``, ``[name]`` with ``= ~= |= ^= $= *=`` (and ``i`` for any case), compounds of
these, the combinators descendant, ``>``, ``+`` and ``~``, and lists by comma.  Anything else (pseudo-classes,
namespaces, escapes) is a ``ValueError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

Attributes = dict[str, str | None]

_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_SIMPLE = re.compile(
    rf"""(?P<tag>{_NAME}|\*)
    |\.(?P<cls>{_NAME})
    |\#(?P<id>[\w\u0080-\U0010ffff-]+)
    |\[\s*(?P<attr>[A-Za-z_:][\w:.-]*)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w\u0080-\U0010ffff-]+))\s*(?P<any>\s[iI])?\s*)?\]""",
    re.VERBOSE,
)
_COMBINATOR = re.compile(r"\s*([>+~,])\s*|\s+")

#: What a test of an attribute's value against the wanted one is, by its sign.
_TESTS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda value, want: value == want,
    "~=": lambda value, want: bool(want) and want in value.split(),
    "|=": lambda value, want: value == want or value.startswith(want + "-"),
    "^=": lambda value, want: bool(want) and value.startswith(want),
    "$=": lambda value, want: bool(want) and value.endswith(want),
    "*=": lambda value, want: bool(want) and want in value,
}


@dataclass
class Compound:
    """What one element must be: its tag, id, classes and attributes."""

    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str | None, str, bool]] = field(default_factory=list)

    def fits(self, tag: str, attributes: Attributes, classes: Iterable[str]) -> bool:
        if self.tag is not None and self.tag != tag:
            return False
        if any(attributes.get("id") != x for x in self.ids) or any(x not in classes for x in self.classes):
            return False
        for name, op, want, any_case in self.attributes:
            if name not in attributes:
                return False
            value = attributes[name] or ""
            if op and not _TESTS[op](*((value.lower(), want.lower()) if any_case else (value, want))):
                return False
        return True


def parse(selectors: str) -> list[list[tuple[str, Compound]]]:
    """Selectors of a list: each is its compounds from left to right, with the combinator before each (`` `` for the first)."""
    out: list[list[tuple[str, Compound]]] = [[]]
    text, at, before = selectors.strip(), 0, " "
    while True:
        compound, start = Compound(), at
        while m := _SIMPLE.match(text, at):
            if m["tag"]:
                if at != start:
                    raise ValueError(f"a tag within a compound: {selectors!r}")
                compound.tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["cls"]:
                compound.classes.append(m["cls"])
            elif m["id"]:
                compound.ids.append(m["id"])
            else:
                want = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
                compound.attributes.append((m["attr"].lower(), m["op"], want, bool(m["any"])))
            at = m.end()
        if at == start:
            raise ValueError(f"no selector at {at}: {selectors!r}")
        out[-1].append((before, compound))
        if at == len(text):
            return out
        if not (m := _COMBINATOR.match(text, at)):
            raise ValueError(f"unsupported at {at}: {selectors!r}")
        at, before = m.end(), m[1] or " "
        if before == ",":
            out.append([])
            before = " "


class Automaton:
    """Selectors compiled to bits, one for each compound.

    A compound's bit is set for an element if the selector up to that compound ends there.  Which bits
    may follow depends on four sets only: those of the parent, of all ancestors, of the sibling before
    and of all siblings before.  Compounds are looked up by id, class or tag, so a step costs what may fit.
    """

    def __init__(self, selectors: Iterable[str]):
        self.compounds: list[Compound] = []
        self.first = self.child = self.descendant = self.adjacent = self.later = self.final = 0
        for chain in (c for s in selectors for c in parse(s)):
            for k, (before, compound) in enumerate(chain):
                bit = 1 << len(self.compounds)
                self.compounds.append(compound)
                if k == 0:
                    self.first |= bit
                else:
                    name = {" ": "descendant", ">": "child", "+": "adjacent", "~": "later"}[before]
                    setattr(self, name, getattr(self, name) | bit)
            self.final |= 1 << (len(self.compounds) - 1)
        self.by_key: dict[tuple[str, str], list[int]] = {}
        for k, c in enumerate(self.compounds):
            key = ("#", c.ids[0]) if c.ids else (".", c.classes[0]) if c.classes else ("", c.tag or "*")
            self.by_key.setdefault(key, []).append(k)

    def fitting(self, tag: str, attributes: Attributes) -> int:
        classes = (attributes.get("class") or "").split()
        keys = {("", tag), ("", "*"), ("#", attributes.get("id") or ""), *((".", c) for c in classes)}
        return sum(1 << k for key in keys for k in self.by_key.get(key, ()) if self.compounds[k].fits(tag, attributes, classes))


class Selection:
    """Which elements of one page an automaton selects, told as the parser opens and closes them."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        #: For each open element (the page first): its bits, its ancestors' and its own, its last child's, all its children's.
        self.open: list[list[int]] = [[0, 0, 0, 0]]

    def start(self, tag: str, attributes: Attributes, *, void: bool = False) -> bool:
        """Whether the element is selected; it stays open unless it is void."""
        a = self.automaton
        fits = a.fitting(tag, attributes)
        parent = self.open[-1]
        own, above, last, earlier = parent
        bits = fits & (a.first | (own << 1 & a.child) | (above << 1 & a.descendant) | (last << 1 & a.adjacent) | (earlier << 1 & a.later))
        parent[2], parent[3] = bits, earlier | bits
        if not void:
            self.open.append([bits, above | bits, 0, 0])
        return bool(bits & a.final)

    def end(self) -> None:
        """The innermost open element ends."""
        if len(self.open) > 1:
            self.open.pop()
