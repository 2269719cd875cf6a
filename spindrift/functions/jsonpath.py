"""JSONPath over parsed JSON: names, indexes, slices, wildcards, unions and descent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

_STEP = re.compile(
    r"""(?P<deep>\.\.)?(?:\.?(?P<name>[^\W\d][\w\-]*|\*)|\.?\[\s*(?P<inner>(?:"[^"]*"|'[^']*'|[^\]])+?)\s*\]|\.?(?P<quoted>"[^"]*"|'[^']*'))""",
    re.VERBOSE,
)


class JsonPathError(ValueError):
    """A path that can't be read."""


@lru_cache(maxsize=512)
def parse(path: str) -> tuple[tuple[bool, tuple], ...]:
    """(whether at any depth, what to take): names, numbers, slices or "*"."""
    s = path.strip()
    at = 1 if s.startswith("$") else 0
    out = []
    while at < len(s):
        m = _STEP.match(s, at)
        if m is None or m.end() == at:
            raise JsonPathError(f"can't read {s[at:]!r} in {path!r}")
        at = m.end()
        if m.group("name"):
            take: tuple = (m.group("name"),)
        elif m.group("quoted"):
            take = (("name", m.group("quoted")[1:-1]),)
        else:
            take = tuple(_member(x.strip()) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,]+", m.group("inner")))
        out.append((bool(m.group("deep")), take))
    if not out and s != "$":
        raise JsonPathError("empty path")
    return tuple(out)


def _member(x: str) -> Any:
    if x == "*":
        return "*"
    if x[0] in "\"'":
        return ("name", x[1:-1])
    if re.fullmatch(r"-?\d+", x):
        return int(x)
    if re.fullmatch(r"-?\d*:-?\d*(?::-?\d+)?", x):
        return slice(*[int(p) if p else None for p in x.split(":")])
    if re.fullmatch(r"[\w\-]+", x):
        return ("name", x)
    raise JsonPathError(f"can't read [{x}]")


def _take(value: Any, member: Any) -> Iterator[Any]:
    if member == "*":
        yield from value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    elif isinstance(member, slice):
        if isinstance(value, list):
            yield from value[member]
    elif isinstance(member, int):
        if isinstance(value, list) and -len(value) <= member < len(value):
            yield value[member]
    else:
        name = member[1] if isinstance(member, tuple) else member
        if isinstance(value, dict) and name in value:
            yield value[name]


def _everything(value: Any) -> Iterator[Any]:
    todo = [value]
    while todo:
        v = todo.pop()
        yield v
        todo.extend(reversed(list(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())))


def find(value: Any, path: str) -> list[Any]:
    """All values at the path, in document order."""
    now = [value]
    for deep, members in parse(path):
        sources = [x for v in now for x in _everything(v)] if deep else now
        now = [x for v in sources for m in members for x in _take(v, m)]
    return now


def simple(path: str) -> str | None:
    """The path for Spark's own JSON functions where it has only names and plain indexes, else None."""
    out = "$"
    for deep, members in parse(path):
        m = members[0]
        if deep or len(members) > 1 or m == "*" or isinstance(m, slice) or isinstance(m, int) and m < 0:
            return None
        out += f"[{m}]" if isinstance(m, int) else f"['{m[1] if isinstance(m, tuple) else m}']"
    return out
