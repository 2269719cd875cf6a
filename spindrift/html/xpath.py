"""A subset of XPath 1.0 over a tree: location paths with predicates, unions, and the common functions.

Results are elements, or strings for attributes, text and computed values."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

from .tree import Node

_TOKEN = re.compile(r"\s*(?:(\"[^\"]*\"|'[^']*')|(\d+(?:\.\d+)?)|(::|//|\.\.|!=|<=|>=|[/.@\[\]()|,=<>*+\-])|([A-Za-z_][\w\-]*))")
AXES = {"child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self", "attribute", "following-sibling", "preceding-sibling"}


class XPathError(ValueError):
    """An expression that can't be read."""


class Text(str):
    """A text node's or an attribute's value, with the element it belongs to."""

    __slots__ = ("owner",)


def _text(value: str, owner: Node) -> Text:
    t = Text(value)
    t.owner = owner
    return t


class _Parser:
    def __init__(self, source: str) -> None:
        self.source, self.tokens, at = source, [], 0
        while at < len(source.rstrip()):
            m = _TOKEN.match(source, at)
            if m is None:
                raise XPathError(f"can't read {source[at:]!r}")
            kind = next(k for k, v in zip(("str", "num", "op", "name"), m.groups()) if v is not None)
            self.tokens.append((kind, m.group(m.lastindex)))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)]

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value:
            raise XPathError(f"expected {value!r} in {self.source!r}")
        self.i += 1
        return t

    def binary(self, level: int = 0):
        levels = [("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("|",)]
        if level == len(levels):
            return self.primary()
        left = self.binary(level + 1)
        while self.peek()[1] in levels[level] and self.peek()[0] in ("op", "name"):
            op = self.take()[1]
            left = ("op", op, left, self.binary(level + 1))
        return left

    def primary(self):
        kind, value = self.peek()
        if kind == "str":
            self.take()
            return ("lit", value[1:-1])
        if kind == "num":
            self.take()
            return ("lit", float(value))
        if value == "-":
            self.take()
            return ("neg", self.primary())
        if value == "(":
            self.take()
            inner = self.binary()
            self.take(")")
            predicates = self.predicates()
            base = ("group", inner, predicates) if predicates else inner
            return ("path", base, self.steps(), False) if self.peek()[1] in ("/", "//") else base
        if kind == "name" and self.peek(1)[1] == "(" and value not in ("text", "node", "comment"):
            self.take()
            self.take("(")
            args = []
            while self.peek()[1] != ")":
                args.append(self.binary())
                if self.peek()[1] == ",":
                    self.take()
            self.take(")")
            if value not in FUNCTIONS:
                raise XPathError(f"unknown function {value!r}")
            return ("call", value, args)
        absolute = value in ("/", "//")
        return ("path", None, self.steps(first=not absolute), absolute)

    def steps(self, first: bool = False) -> list[tuple]:
        out = []
        if first:
            out.append(self.step())
        while self.peek()[1] in ("/", "//"):
            if self.take()[1] == "//":
                out.append(("descendant-or-self", "node()", []))
            if self.peek()[0] == "end":
                break
            out.append(self.step())
        if not out and not first:
            raise XPathError(f"{self.source!r} ends too early")
        return out

    def step(self) -> tuple:
        kind, value = self.take()
        if value == ".":
            return ("self", "node()", self.predicates())
        if value == "..":
            return ("parent", "node()", self.predicates())
        axis = "child"
        if value == "@":
            axis, (kind, value) = "attribute", self.take()
        elif self.peek()[1] == "::":
            if value not in AXES:
                raise XPathError(f"unknown axis {value!r}")
            axis = value
            self.take()
            kind, value = self.take()
        if value in ("text", "node", "comment") and self.peek()[1] == "(":
            self.take("(")
            self.take(")")
            value += "()"
        elif kind != "name" and value != "*":
            raise XPathError(f"can't read a step at {value!r} in {self.source!r}")
        return (axis, value if value.endswith("()") else value.lower(), self.predicates())

    def predicates(self) -> list:
        out = []
        while self.peek()[1] == "[":
            self.take()
            out.append(self.binary())
            self.take("]")
        return out


@lru_cache(maxsize=512)
def parse(source: str):
    p = _Parser(source)
    tree = p.binary()
    if p.peek()[0] != "end":
        raise XPathError(f"{source!r} goes on after its end")
    return tree


def _axis(n: Any, axis: str, test: str) -> list:
    if isinstance(n, Text):
        return [n] if axis == "self" and test == "node()" else [n.owner] if axis == "parent" else []
    if axis == "attribute":
        return [_text(v, n) for k, v in n.attrs.items() if test in ("*", "node()", k)]
    if test == "text()":
        if axis == "child":
            return [_text(k, n) for k in n.kids if type(k) is str]
        if axis in ("descendant", "descendant-or-self"):
            return [_text(k, x) for x in n.subtree() for k in x.kids if type(k) is str]
        return []
    if axis == "child":
        found = [k for k in n.kids if type(k) is Node]
        if test == "node()":
            return [_text(k, n) if type(k) is str else k for k in n.kids]
    elif axis in ("descendant", "descendant-or-self"):
        found = n.subtree()[axis == "descendant" :]
    elif axis == "self":
        found = [n]
    elif axis == "parent":
        found = [n.parent] if n.parent is not None else []
    elif axis in ("ancestor", "ancestor-or-self"):
        found, at = [], n if axis == "ancestor-or-self" else n.parent
        while at is not None:
            found.append(at)
            at = at.parent
    else:
        own = n.parent.elements() if n.parent is not None else [n]
        i = next(i for i, k in enumerate(own) if k is n)
        found = own[i + 1 :] if axis == "following-sibling" else own[:i][::-1]
    if test == "node()":
        return found
    return [x for x in found if x.tag and (test == "*" or x.tag == test)]


def _place(x: Any) -> Any:
    return id(x)


def _walk(start: list, steps: list[tuple]) -> list:
    now, i = start, 0
    while i < len(steps):
        axis, test, predicates = steps[i]
        # "//name" without positions is one look at the descendants.
        if axis == "descendant-or-self" and test == "node()" and not predicates and i + 1 < len(steps) and steps[i + 1][0] == "child" and not any(_positional(p) for p in steps[i + 1][2]):
            axis, test, predicates = "descendant", steps[i + 1][1], steps[i + 1][2]
            i += 1
        out, seen = [], set()
        for n in now:
            found = _axis(n, axis, test)
            for p in predicates:
                size = len(found)
                found = [x for k, x in enumerate(found, 1) if _true(_eval(p, x, k, size), k)]
            for x in found:
                if isinstance(x, Text) or x.at not in seen:
                    if not isinstance(x, Text):
                        seen.add(x.at)
                    out.append(x)
        if len(now) > 1 and all(type(x) is Node for x in out):
            out.sort(key=lambda x: x.at)
        now = out
        i += 1
    return now


def _positional(p: tuple) -> bool:
    if p[0] == "lit":
        return isinstance(p[1], float)
    if p[0] == "call":
        return p[1] in ("position", "last") or any(_positional(a) for a in p[2])
    if p[0] == "op":
        return p[1] in "+-" or _inside(p[2]) or _inside(p[3])
    return p[0] == "neg"


def _inside(p: tuple) -> bool:
    return p[0] != "lit" and _positional(p)


def _true(v: Any, position: int | None = None) -> bool:
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v == position if position is not None else v != 0
    return bool(v)


def string(v: Any) -> str:
    if isinstance(v, list):
        return string(v[0]) if v else ""
    if isinstance(v, Node):
        return v.text()
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else str(v)
    return str(v)


def number(v: Any) -> float:
    try:
        return float(v) if isinstance(v, (bool, float)) else float(string(v))
    except ValueError:
        return float("nan")


FUNCTIONS = {
    "contains": lambda c, a, b: string(b) in string(a),
    "starts-with": lambda c, a, b: string(a).startswith(string(b)),
    "not": lambda c, a: not _true(a),
    "normalize-space": lambda c, a=None: " ".join(string(c[0] if a is None else a).split()),
    "string": lambda c, a=None: string(c[0] if a is None else a),
    "number": lambda c, a=None: number(c[0] if a is None else a),
    "string-length": lambda c, a=None: float(len(string(c[0] if a is None else a))),
    "concat": lambda c, *a: "".join(map(string, a)),
    "translate": lambda c, s, a, b: string(s).translate({ord(x): (string(b)[i] if i < len(string(b)) else None) for i, x in reversed(list(enumerate(string(a))))}),
    "substring-before": lambda c, a, b: string(a).partition(string(b))[0] if string(b) in string(a) else "",
    "substring-after": lambda c, a, b: string(a).partition(string(b))[2],
    "substring": lambda c, s, a, n=None: string(s)[max(0, int(number(a)) - 1) : None if n is None else max(0, int(number(a)) - 1 + int(number(n)))],
    "count": lambda c, a: float(len(a)),
    "position": lambda c: float(c[1]),
    "last": lambda c: float(c[2]),
    "name": lambda c, a=None: (c[0] if a is None else a[0]).tag,
    "local-name": lambda c, a=None: (c[0] if a is None else a[0]).tag.rpartition(":")[2],
    "true": lambda c: True,
    "false": lambda c: False,
}


def _compare(op: str, a: Any, b: Any) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        left = a if isinstance(a, list) else [a]
        right = b if isinstance(b, list) else [b]
        return any(_compare(op, string(x) if isinstance(x, Node) else x, string(y) if isinstance(y, Node) else y) for x in left for y in right)
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            same = _true(a) == _true(b)
        elif isinstance(a, float) or isinstance(b, float):
            same = number(a) == number(b)
        else:
            same = string(a) == string(b)
        return same == (op == "=")
    x, y = number(a), number(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _eval(e: tuple, n: Any, position: int, size: int) -> Any:
    kind = e[0]
    if kind == "lit":
        return e[1]
    if kind == "neg":
        return -number(_eval(e[1], n, position, size))
    if kind == "path":
        if e[3]:
            start = [(n.owner if isinstance(n, Text) else n).tree.root]
        elif e[1] is not None:
            start = _eval(e[1], n, position, size)
        else:
            start = [n]
        return _walk(start, e[2])
    if kind == "group":
        found = _eval(e[1], n, position, size)
        for p in e[2]:
            total = len(found)
            found = [x for k, x in enumerate(found, 1) if _true(_eval(p, x, k, total), k)]
        return found
    if kind == "call":
        return FUNCTIONS[e[1]]((n, position, size), *[_eval(a, n, position, size) for a in e[2]])
    op = e[1]
    left = _eval(e[2], n, position, size)
    if op == "or":
        return _true(left) or _true(_eval(e[3], n, position, size))
    if op == "and":
        return _true(left) and _true(_eval(e[3], n, position, size))
    right = _eval(e[3], n, position, size)
    if op == "|":
        both = {(x.at if type(x) is Node else (x.owner.at, i)): x for i, x in enumerate([*left, *right])}
        return sorted(both.values(), key=lambda x: x.at if type(x) is Node else x.owner.at)
    if op in ("+", "-"):
        return number(left) + number(right) if op == "+" else number(left) - number(right)
    return _compare(op, left, right)


def select(context: Node, source: str) -> list[Node | str]:
    """What the expression finds: elements, or strings. A path that starts at "/" starts at the document's root."""
    found = _eval(parse(source), context, 1, 1)
    if isinstance(found, list):
        return [x if type(x) is Node else str(x) for x in found]
    return [string(found)]
