"""Value transformers: each as a Spark expression for columns, and as a plain function for values inside a page pass.

Both forms give the same results but for what their docstrings name."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("strip", "to_float", "to_int", "regex", "replace")
Step = tuple[str, tuple[str, ...]]


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind, Unicode's too."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def to_float(c: Column, thousands: str = "", decimal: str = "") -> Column:
    """The number that is left when everything but digits, points and minus signs is dropped; 0 where that is none.

    With two separators the first is dropped and the second becomes the point. Null stays null at the head of a chain."""
    s = c.cast("string")
    if thousands:
        s = F.replace(s, F.lit(thousands), F.lit(""))
    if decimal and decimal != ".":
        s = F.replace(s, F.lit(decimal), F.lit("."))
    return F.coalesce(F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def to_int(c: Column) -> Column:
    """The first run of digits, without its sign; 0 where there is none. Beyond 64 bits it is 0 as well."""
    return F.coalesce(F.regexp_substr(c.cast("string"), F.lit(r"[0-9]+")).try_cast("bigint"), F.lit(0).cast("bigint"))


def regex(c: Column, pattern: str) -> Column:
    """The first group of the first match, or the whole match where the pattern has no group; null without a match."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0)), 0)


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def chain(c: Column, steps: Sequence[str | tuple[str, Sequence[str]]]) -> Column:
    """The steps from left to right. A null at the head stays null; a null that regex makes becomes 0 in to_float, and
    stays null in every other step."""
    out, numeric = c, False
    for name, args in normal(steps):
        if name == "strip":
            out = out if numeric else strip(out)
        elif name == "to_float":
            out, numeric = out.cast("double") if numeric else to_float(out, *args[:2]) if len(args) > 1 else to_float(out), True
        elif name == "to_int":
            found = out
            out, numeric = found.cast("bigint") if numeric else F.when(found.isNotNull(), to_int(found)), True
        elif name == "regex" and args and not numeric:
            out = regex(out, args[0])
        elif name == "replace" and len(args) > 1 and not numeric:
            out = replace(out, args[0], args[1])
    return F.when(c.isNotNull(), out)


def normal(steps: Sequence[str | tuple[str, Sequence[str]]]) -> list[Step]:
    return [(s, ()) if isinstance(s, str) else (s[0], tuple(map(str, s[1]))) for s in steps]


@lru_cache(maxsize=512)
def compiled(source: str) -> re.Pattern:
    """A pattern, compiled once a worker."""
    return re.compile(source)


_NOT_NUMBER, _DIGITS = re.compile(r"[^\d.\-]"), re.compile(r"\d+")


def apply_chain(value: Any, steps: Sequence[Step]) -> Any:
    """The chain on one value. A step that fails leaves the value as it is; a null value isn't touched."""
    if value is None:
        return None
    for name, args in steps:
        try:
            if name == "strip":
                value = value.strip() if isinstance(value, str) else value
            elif name == "to_float":
                value = _float(value, args)
            elif name == "to_int":
                if isinstance(value, str):
                    found = _DIGITS.search(value)
                    value = int(found.group()) if found else 0
                elif value is not None:
                    value = int(value)
            elif name == "regex" and args and value is not None:
                found = compiled(args[0]).search(str(value))
                value = (found.group(1) if found.re.groups else found.group()) if found else None
            elif name == "replace" and len(args) > 1 and isinstance(value, str):
                old, new = args[:2]
                value = value.replace(old, new)
        except (ValueError, TypeError, OverflowError):
            continue
    return value


def _float(value: Any, args: Sequence[str]) -> float:
    if isinstance(value, str):
        if len(args) > 1:
            value = value.replace(args[0], "").replace(args[1], ".")
        value = _NOT_NUMBER.sub("", value)
    try:
        return float(value)
    except (ValueError, TypeError):
        return 0.0


def result_type(steps: Sequence[Step], otherwise: str = "string") -> str:
    """The Spark type of a chain's results."""
    for name, _ in reversed(steps):
        if name in ("to_float", "to_int"):
            return {"to_float": "double", "to_int": "bigint"}[name]
        if name in ("regex",):
            return "string"
    return otherwise
