"""Redaction, hashing, slugs, JSON and flattening, as Spark expressions."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "[REDACTED]"
_STORED = ["access_token", "api_key", "apikey", "client_secret", "password", "refresh_token"]
_HEADERS = ["cookie", "authorization", *[f"x-{x}" for x in ("access-token", "api-key", "auth-token")], "proxy-authorization"]
SECRET_NAMES = {*_STORED, *_HEADERS, "token"}
SECRET_PARTS = ["token", "secret", "password", "credential", "authorization", "api-key"]

#: In order: header lines, stored names with values, query parameters, user info of URLs. What goes is what follows the first group.
_RULES = [
    (rf"(?i)((?:{'|'.join(sorted(_HEADERS, key=len, reverse=True))})\s*[=:]\s*(?:(?:basic|bearer)\s+)?)[^,;\s]+", "$1" + MARK),
    (rf"""(?i)(['"]?(?:{'|'.join(_STORED)})['"]?\s*[=:]\s*['"]?)[^,;\s'"]+""", "$1" + MARK),
    (rf"(?i)([&?](?:{'|'.join([*_STORED, 'token'])})=)[^\s&]+", "$1" + MARK),
    (r"(://)[^\s/@]+@", "$1" + MARK + "@"),
]


def redact_text(c: Column) -> Column:
    """Credentials in a text replaced by a mark. Java and Python read these patterns alike."""
    for pattern, new in _RULES:
        c = F.regexp_replace(c, pattern, new)
    return c


def redact_string(text: str) -> str:
    """redact_text for one string on the driver."""
    for pattern, new in _RULES:
        text = re.sub(pattern, new.replace("$1", r"\1"), text) if text else text
    return text


def is_secret_name(name: str) -> bool:
    low = name.lower()
    return low in SECRET_NAMES or any(p in low for p in SECRET_PARTS)


def redact_config(value: Any, name: str = "") -> Any:
    """A configuration with its secrets marked, by name at any depth, and every value under headers."""
    if name and is_secret_name(name):
        return MARK
    if isinstance(value, dict):
        return {k: MARK if name.lower() == "headers" else redact_config(v, str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_config(v) for v in value]
    return redact_string(value) if isinstance(value, str) else value


def sensitive_header(name: Column) -> Column:
    low = F.replace(F.lower(name), F.lit("_"), F.lit("-"))
    out = low.isin(*_HEADERS)
    for p in SECRET_PARTS:
        out = out | low.contains(p)
    return out


def headers_for(headers: Column, same_origin: Column) -> Column:
    """The headers that may go to a URL: those with credentials only to the origin they belong to."""
    return F.map_filter(headers, lambda k, v: same_origin | ~sensitive_header(k))


def cookie_header(cookies: Column) -> Column:
    """A map of cookies as one header value."""
    return F.array_join(F.transform(F.map_entries(cookies), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def slug(c: Column, otherwise: str = "run") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", otherwise).otherwise(s)


def join_list(c: Column, between: str = " | ") -> Column:
    """A list as one cell; null members read None, as in Python."""
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), between)


def record_key(df: DataFrame, columns: list[str]) -> Column:
    """A digest of columns by value, whatever their order."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def config_digest(raw: Any) -> str:
    import hashlib

    text = json.dumps(raw, default=str, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def flatten(df: DataFrame, between: str = "_") -> DataFrame:
    """Struct columns spread out as a_b, to any depth; of two columns of one name the later stays. Lists aren't touched."""
    found: dict[str, Column] = {}

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, at)
            else:
                name = between.join(at)
                found.pop(name, None)
                found[name] = F.col(".".join(f"`{x}`" for x in at)).alias(name)

    walk(df.schema, [])
    return df.select(*found.values())
