"""CSS selectors over a tree: types, classes, ids, attributes, combinators, structural pseudo-classes and lists."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

from .tree import Node, ancestors

_NAME = r"(?:[\w\-\u00a0-\uffff]|\\.)+"
_TOKEN = re.compile(
    rf"""(?P<comb>\s*[>+~,]\s*|\s+)|(?P<type>\*|{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})
    |\[\s*(?P<attr>[\w:\-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*(?P<ci>[iI])?\s*)?\]
    |::?(?P<pseudo>[\w\-]+)(?P<open>\()?""",
    re.VERBOSE,
)
Test = Callable[[Node], bool]


class SelectorError(ValueError):
    """A selector that can't be read."""


class Compound:
    """Conditions on one element, and how it stands to the compound before it."""

    def __init__(self) -> None:
        self.tag: str | None = None
        self.tests: list[Test] = []
        self.link: str = ""
        self.empty = True

    def holds(self, n: Node) -> bool:
        return bool(n.tag) and (self.tag is None or n.tag == self.tag) and all(t(n) for t in self.tests)


@lru_cache(maxsize=512)
def parse(selector: str) -> list[list[Compound]]:
    """The alternatives of a selector, each its compounds from left to right."""
    s, at = selector.strip(), 0
    if not s:
        raise SelectorError("empty selector")
    out: list[list[Compound]] = [[Compound()]]
    while at < len(s):
        m = _TOKEN.match(s, at)
        if m is None:
            raise SelectorError(f"can't read {s[at:]!r} in {selector!r}")
        now = out[-1][-1]
        at = m.end()
        if m.group("comb") is not None:
            c = m.group("comb").strip() or " "
            if now.empty:
                raise SelectorError(f"{c!r} follows nothing in {selector!r}")
            if c == ",":
                out.append([Compound()])
            else:
                out[-1].append(Compound())
                out[-1][-1].link = c
            continue
        now.empty = False
        if m.group("type"):
            if m.group("type") != "*":
                now.tag = _plain(m.group("type")).lower()
        elif m.group("cls"):
            now.tests.append(_has_class(_plain(m.group("cls"))))
        elif m.group("id"):
            now.tests.append(lambda n, v=_plain(m.group("id")): n.attrs.get("id") == v)
        elif m.group("attr"):
            now.tests.append(_attribute(m.group("attr").lower(), m.group("op"), m.group("val"), bool(m.group("ci"))))
        else:
            argument = None
            if m.group("open"):
                depth, start = 1, at
                while at < len(s) and depth:
                    depth += {"(": 1, ")": -1}.get(s[at], 0)
                    at += 1
                if depth:
                    raise SelectorError(f"unclosed parenthesis in {selector!r}")
                argument = s[start : at - 1].strip()
            now.tests.append(_pseudo(m.group("pseudo").lower(), argument))
    if any(c.empty for alternative in out for c in alternative):
        raise SelectorError(f"{selector!r} ends too early")
    return out


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _has_class(name: str) -> Test:
    return lambda n: name in n.attrs.get("class", "").split()


def _attribute(name: str, op: str | None, value: str | None, fold: bool) -> Test:
    if op is None:
        return lambda n: name in n.attrs
    v = value[1:-1] if value[0] in "\"'" else value
    v = v.lower() if fold else v
    tests: dict[str, Callable[[str], bool]] = {
        "=": lambda x: x == v,
        "!=": lambda x: x != v,
        "~=": lambda x: v in x.split(),
        "|=": lambda x: x == v or x.startswith(v + "-"),
        "^=": lambda x: bool(v) and x.startswith(v),
        "$=": lambda x: bool(v) and x.endswith(v),
        "*=": lambda x: bool(v) and v in x,
    }
    test = tests[op]
    if op == "!=":
        return lambda n: name not in n.attrs or test(n.attrs[name])
    return lambda n: name in n.attrs and test(n.attrs[name].lower() if fold else n.attrs[name])


def _siblings(n: Node, same: bool) -> list[Node]:
    return [k for k in n.parent.elements() if not same or k.tag == n.tag] if n.parent is not None else [n]


def _nth(argument: str) -> Callable[[int], bool]:
    a = {"odd": "2n+1", "even": "2n"}.get(argument.lower(), argument.lower()).replace(" ", "")
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", a)
    if not a or m is None:
        raise SelectorError(f"can't read position {argument!r}")
    step = 0 if m.group(1) is None else int(m.group(1) + "1" if m.group(1) in ("", "+", "-") else m.group(1))
    first = int(m.group(2) or 0)
    return lambda i: i == first if not step else (i - first) % step == 0 and (i - first) // step >= 0


def _pseudo(name: str, argument: str | None) -> Test:
    if name in ("first-child", "last-child", "first-of-type", "last-of-type"):
        same, i = name.endswith("type"), 0 if name.startswith("first") else -1
        return lambda n: _siblings(n, same)[i] is n
    if name in ("only-child", "only-of-type"):
        return lambda n: len(_siblings(n, name.endswith("type"))) == 1
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type") and argument:
        fits, same, back = _nth(argument), name.endswith("type"), "last" in name

        def at(n: Node) -> bool:
            own = _siblings(n, same)
            i = next(i for i, k in enumerate(own) if k is n)
            return fits(len(own) - i if back else i + 1)

        return at
    if name == "not" and argument:
        inner = parse(argument)
        return lambda n: not any(_matches(n, alternative) for alternative in inner)
    if name in ("is", "where") and argument:
        inner = parse(argument)
        return lambda n: any(_matches(n, alternative) for alternative in inner)
    if name == "contains" and argument:
        v = argument.strip("\"'")
        return lambda n: v in n.text()
    if name == "empty":
        return lambda n: not n.kids
    if name == "root":
        return lambda n: n.parent is not None and not n.parent.tag
    raise SelectorError(f"unknown pseudo-class {name!r}")


def _matches(n: Node, compounds: list[Compound]) -> bool:
    if not compounds[-1].holds(n):
        return False
    if len(compounds) == 1:
        return True
    link, rest = compounds[-1].link, compounds[:-1]
    if link == " ":
        return any(_matches(a, rest) for a in ancestors(n))
    if link == ">":
        return n.parent is not None and bool(n.parent.tag) and _matches(n.parent, rest)
    before = n.parent.elements() if n.parent is not None else []
    i = next((i for i, k in enumerate(before) if k is n), 0)
    return any(_matches(k, rest) for k in (before[max(0, i - 1) : i] if link == "+" else before[:i]))


def select(context: Node, selector: str) -> list[Node]:
    """The elements of the context's subtree, itself among them, that match, in document order."""
    alternatives = parse(selector)
    found: set[int] = set()
    nodes = context.tree.nodes
    for compounds in alternatives:
        tag = compounds[-1].tag
        if tag is None:
            places = range(context.at, context.end)
        else:
            own = context.tree.by_tag(tag)
            places = own[bisect_left(own, context.at) : bisect_left(own, context.end)]
        found.update(i for i in places if _matches(nodes[i], compounds))
    return [nodes[i] for i in sorted(found)]
