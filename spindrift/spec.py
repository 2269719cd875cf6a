"""Extraction specifications: read, checked as a whole, and turned into typed trees.

Checking never stops at the first fault: parse returns every issue it finds, errors and warnings."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .functions import jsonpath
from .functions.transforms import NAMES as TRANSFORMERS
from .functions.transforms import Step, result_type
from .functions.urls import UrlPolicy
from .html import css, xpath

KINDS = ("css", "xpath", "json", "regex")
DEDUP_MODES = ("none", "url", "fields", "exact_hash")
#: Types that a JSON field may declare.
TYPES = ("string", "bigint", "double", "boolean")


@dataclass(frozen=True)
class Issue:
    path: str
    message: str
    severity: str = field(default="error")


@dataclass(frozen=True)
class Selector:
    kind: str
    value: str


@dataclass(frozen=True)
class Field:
    name: str
    selectors: tuple[Selector, ...] = ()
    is_list: bool = False
    attribute: str | None = None
    transformers: tuple[Step, ...] = ()
    children: tuple[Field, ...] = ()
    follow_url: bool = False
    nested_fields: tuple[Field, ...] = ()
    type: str = "string"

    def spark_type(self, json_page: bool, child: bool = False) -> str:
        """The column's type: links to follow are lists of URLs until they are nested."""
        if self.follow_url:
            return "array<string>"
        if self.children:
            one = "struct<" + ",".join(f"`{c.name}`:{c.spark_type(json_page, True)}" for c in self.children) + ">"
        elif any(s.kind == "regex" and re.compile(s.value).groups > 1 for s in self.selectors) and (json_page or not child):
            one = "array<string>"
        else:
            one = result_type(self.transformers, self.type)
            if not json_page and not child and self.selectors and all(s.kind == "regex" for s in self.selectors):
                one = "string"  # regex values of a whole page aren't transformed
        return f"array<{one}>" if self.is_list else one


@dataclass(frozen=True)
class Pagination:
    """How a page leads to the next: by a link, or by a cursor that goes into a query parameter."""

    selector: Selector
    query_param: str = "after"
    max_pages: int = 5


@dataclass(frozen=True)
class Spec:
    name: str
    fields: tuple[Field, ...]
    base_url: str | None = None
    mode: str = "pagination"
    start_urls: tuple[str, ...] = ()
    sitemap_urls: tuple[str, ...] = ()
    response_type: str = "html"
    pagination: Pagination | None = None
    max_nested_urls: int = 5
    max_depth: int = 2
    append_json_suffix: bool = False
    fail_parent_on_nested_error: bool = True
    respect_robots_txt: bool = False
    robots_failure_policy: str = "allow"
    record_field: str | None = None
    dedup_mode: str = "exact_hash"
    dedup_fields: tuple[str, ...] = ()
    min_records: int = 0
    required_fields: tuple[str, ...] = ()
    policy: UrlPolicy = field(default_factory=UrlPolicy)
    settings: dict[str, Any] = field(default_factory=dict, compare=False, hash=False)

    def pruned(self, names: Sequence[str]) -> Spec:
        """The spec with some of its fields only: nothing prunes columns across the page pass but this."""
        from dataclasses import replace

        return replace(self, fields=tuple(f for f in self.fields if f.name in names))


#: Settings of transport and of run control: checked, kept, of no meaning to pages that are already fetched. Name: (kind, least, most).
SETTINGS: dict[str, tuple[type | tuple[type, ...], float | None, float | None]] = {
    "concurrency": (int, 1, None), "rate_limit": (int, 1, None), "request_timeout": (int, 1, 3600), "min_delay": ((int, float), None, None), "max_delay": ((int, float), None, None),
    "per_domain_rate_limit": (int, 1, 100_000), "robots_ttl_seconds": ((int, float), 0, 86_400), "robots_max_origins": (int, 1, 100_000), "max_failed_entries": (int, 1, 100_000),
    "sitemap_max_urls": (int, 1, 1_000_000), "sitemap_max_depth": (int, 0, 20), "sitemap_max_documents": (int, 1, 1_000_000), "sitemap_max_queue": (int, 1, 1_000_000),
    "sitemap_max_bytes": (int, 1024, 100_000_000), "proxy_failure_threshold": (int, 1, 100), "proxy_cooldown_seconds": ((int, float), 0, 86_400),
    "use_playwright": (bool, None, None), "debug_mode": (bool, None, None), "use_checkpointing": (bool, None, None), "wait_for_selector": (str, None, None), "cookies_file": (str, None, None),
    "proxies": (list, None, None), "headers": (dict, None, None), "interactions": (list, None, None), "authentication": (dict, None, None), "retry": (dict, None, None), "browser": (dict, None, None),
    "debug_snapshots": (dict, None, None), "request_body": (object, None, None),
}
#: Settings of a few fixed values.
CHOICES = {
    "mode": ("list", "pagination"),
    "response_type": ("html", "json"),
    "request_method": ("GET", "POST"),
    "request_body_type": ("json", "form"),
    "interaction_failure_policy": ("warn", "fail"),
    "robots_failure_policy": ("allow", "deny"),
}
NESTED_BOUNDS = {
    "retry": {"max_attempts": (1, 20), "base_delay_seconds": (0, 300), "max_delay_seconds": (0, 3600), "retry_after_cap_seconds": (0, 86_400)},
    "browser": {"context_max_requests": (1, 10_000)},
    "debug_snapshots": {"max_files": (0, None), "max_bytes_per_file": (0, None), "max_total_bytes": (0, None)},
}
INTERACTIONS = ("click", "wait", "scroll", "fill", "press", "hover", "key")
_KNOWN = {"name", "base_url", "start_urls", "sitemap_urls", "fields", "pagination", "max_nested_urls", "max_depth", "append_json_suffix", "fail_parent_on_nested_error", "respect_robots_txt", "record_field", "dedup", "validation", "url_policy", *SETTINGS, *CHOICES}


class _Reader:
    def __init__(self) -> None:
        self.issues: list[Issue] = []

    def fault(self, path: str, message: str, severity: str = "error") -> None:
        self.issues.append(Issue(path, message, severity))

    def number(self, raw: dict, name: str, default: Any, least: float | None = None, most: float | None = None, at: str = "", kind: Any = (int, float)) -> Any:
        v = raw.get(name, default)
        path = f"{at}{name}"
        if v is None and default is None:
            return None
        if isinstance(v, bool) or not isinstance(v, kind):
            self.fault(path, "must be a number")
        elif least is not None and v < least or most is not None and v > most:
            self.fault(path, f"must lie within {least} and {most}" if most is not None else f"must be at least {least}")
        else:
            return v
        return default

    def selector(self, raw: Any, path: str) -> Selector | None:
        if isinstance(raw, str):
            raw = {"type": "css", "value": raw}
        if not isinstance(raw, dict) or not isinstance(raw.get("value"), str):
            self.fault(path, "must be a string or an object with type and value")
            return None
        kind, value = raw.get("type", "css"), raw["value"]
        if kind not in KINDS:
            self.fault(path, f"unknown selector type {kind!r}")
            return None
        try:
            {"css": css.parse, "xpath": xpath.parse, "json": jsonpath.parse, "regex": re.compile}[kind](value)
        except (ValueError, re.error) as e:
            self.fault(path, f"can't read this {kind} selector: {e}")
            return None
        return Selector(kind, value)

    def transformer(self, raw: Any, path: str) -> Step | None:
        if isinstance(raw, str):
            raw = {"name": raw}
        if not isinstance(raw, dict) or raw.get("name") not in TRANSFORMERS:
            self.fault(path, f"unknown transformer {raw.get('name') if isinstance(raw, dict) else raw!r}")
            return None
        args = raw.get("args") or []
        if not isinstance(args, list):
            self.fault(path, "args must be a list")
            return None
        if raw["name"] == "regex" and args:
            try:
                re.compile(str(args[0]))
            except re.error as e:
                self.fault(path, f"can't read this pattern: {e}")
        return raw["name"], tuple(map(str, args))

    def field(self, raw: Any, path: str) -> Field | None:
        if not isinstance(raw, dict) or not isinstance(raw.get("name"), str) or not raw["name"]:
            self.fault(path, "a field needs a name")
            return None
        first, more = raw.get("selector"), raw.get("selectors") or []
        found = [*(first if isinstance(first, list) else [first] if first is not None else []), *(more if isinstance(more, list) else [more])]
        selectors = [self.selector(s, f"{path}.selectors[{i}]") for i, s in enumerate(found)]
        steps = [self.transformer(t, f"{path}.transformers[{i}]") for i, t in enumerate(raw.get("transformers") or [])]
        attribute = raw.get("attribute")
        kind = raw.get("type", "string")
        if kind not in TYPES:
            self.fault(f"{path}.type", f"unknown type {kind!r}")
            kind = "string"
        out = Field(
            raw["name"],
            tuple(s for s in selectors if s),
            bool(raw.get("is_list")),
            attribute.strip().lower() or None if isinstance(attribute, str) else None,
            tuple(t for t in steps if t),
            self.fields(raw.get("children"), f"{path}.children"),
            bool(raw.get("follow_url")),
            self.fields(raw.get("nested_fields"), f"{path}.nested_fields"),
            kind,
        )
        if out.follow_url and not raw.get("nested_fields"):
            self.fault(f"{path}.nested_fields", f"field {out.name!r} follows URLs but has no nested_fields")
        return out

    def fields(self, raw: Any, path: str) -> tuple[Field, ...]:
        if raw is None:
            return ()
        if not isinstance(raw, list):
            self.fault(path, "must be a list of fields")
            return ()
        out = [f for i, r in enumerate(raw) if (f := self.field(r, f"{path}[{i}]"))]
        twice = sorted({f.name for f in out if sum(g.name == f.name for g in out) > 1})
        for name in twice:
            self.fault(path, f"two fields are named {name!r}")
        return tuple(out)

    def urls(self, raw: dict, name: str) -> tuple[str, ...]:
        found = raw.get(name) or []
        if not isinstance(found, list):
            self.fault(name, "must be a list of URLs")
            return ()
        for i, u in enumerate(found):
            if not isinstance(u, str) or not re.match(r"https?://[^/\s]", u):
                self.fault(f"{name}[{i}]", "must be an http or https URL")
        return tuple(u for u in found if isinstance(u, str))

    def policy(self, raw: Any) -> UrlPolicy:
        if not isinstance(raw, dict):
            if raw is not None:
                self.fault("url_policy", "must be an object")
            return UrlPolicy()
        domains = []
        for i, d in enumerate(raw.get("allowed_domains") or []):
            body = str(d).strip().lower().rstrip(".")
            bare = body.removeprefix("*.")
            if not bare or re.search(r"[/?#:*]", bare):
                self.fault(f"url_policy.allowed_domains[{i}]", f"invalid domain {d!r}")
            else:
                domains.append(body)
        schemes = [str(s).lower() for s in raw.get("allowed_schemes", ["http", "https"])]
        if not schemes or set(schemes) - {"http", "https"}:
            self.fault("url_policy.allowed_schemes", "may hold http and https only")
        if raw.get("dns_failure_policy", "deny") not in ("allow", "deny"):
            self.fault("url_policy.dns_failure_policy", "must be allow or deny")
        self.number(raw, "max_redirects", 5, 0, 20, "url_policy.", int)
        return UrlPolicy(tuple(domains), bool(raw.get("allow_subdomains")), bool(raw.get("allow_external_urls")), tuple(dict.fromkeys(schemes)), bool(raw.get("block_private_networks", True)))

    def spec(self, raw: dict, folder: Path | None) -> Spec:
        for k in raw:
            if k not in _KNOWN:
                self.fault("config", f"unknown key {k}", "warning")
        if not isinstance(raw.get("name"), str):
            self.fault("name", "is required")
        if "fields" not in raw:
            self.fault("fields", "is required")
        for k, allowed in CHOICES.items():
            if k in raw and raw[k] not in allowed:
                self.fault(k, f"must be one of {', '.join(allowed)}")
        for k, (kind, least, most) in SETTINGS.items():
            v = raw.get(k)
            if v is None:
                continue
            if least is not None or kind == (int, float):
                self.number(raw, k, None, least, most, kind=kind)
            elif not isinstance(v, kind):
                self.fault(k, f"must be of type {kind.__name__}")
        for k, bounds in NESTED_BOUNDS.items():
            for n, (least, most) in bounds.items():
                if isinstance(raw.get(k), dict) and n in raw[k]:
                    self.number(raw[k], n, None, least, most, f"{k}.")
        low, high = raw.get("min_delay", 1), raw.get("max_delay", 3)
        if isinstance(low, (int, float)) and isinstance(high, (int, float)) and low > high:
            self.fault("min_delay", "must not be above max_delay")
        for i, step in enumerate(raw.get("interactions") or []):
            kind = step.get("type") if isinstance(step, dict) else None
            if kind not in INTERACTIONS:
                self.fault(f"interactions[{i}]", f"unknown interaction {kind!r}")
            elif kind in ("click", "fill", "press", "hover") and not step.get("selector"):
                self.fault(f"interactions[{i}]", f"{kind} needs a selector")
            elif kind == "key" and not step.get("value"):
                self.fault(f"interactions[{i}]", "key needs a value")
        found = self.fields(raw.get("fields"), "fields")
        names = {f.name for f in found}
        base, start, maps = raw.get("base_url"), self.urls(raw, "start_urls"), self.urls(raw, "sitemap_urls")
        mode = raw.get("mode", "pagination")
        if base is not None and (not isinstance(base, str) or not re.match(r"https?://[^/\s]", base)):
            self.fault("base_url", "must be an http or https URL")
        if mode == "pagination" and not base:
            self.fault("base_url", "is required in pagination mode")
        if mode == "list" and not start and not maps:
            self.fault("start_urls", "start_urls or sitemap_urls is required in list mode")
        if raw.get("use_playwright") and raw.get("request_method", "GET") != "GET":
            self.fault("request_method", "a browser can only GET")
        if raw.get("record_field") and raw["record_field"] not in names:
            self.fault("record_field", f"no field is named {raw['record_field']!r}")
        dedup = raw.get("dedup") or {}
        dedup_mode, dedup_fields = dedup.get("mode", "exact_hash"), tuple(dedup.get("fields") or ())
        if dedup_mode not in DEDUP_MODES:
            self.fault("dedup.mode", f"must be one of {', '.join(DEDUP_MODES)}")
        if dedup_mode == "fields":
            if not dedup_fields:
                self.fault("dedup.fields", "mode fields needs at least one field")
            for n in dedup_fields:
                if n not in names:
                    self.fault("dedup.fields", f"no field is named {n!r}")
        check = raw.get("validation") or {}
        auth = raw.get("authentication")
        if isinstance(auth, dict):
            needed = {"bearer": ["client_secret"], "oauth_password": ["username", "password", "client_id", "client_secret", "token_url"]}.get(auth.get("type", "oauth_password"))
            if needed is None:
                self.fault("authentication.type", "must be bearer or oauth_password")
            for n in needed or []:
                if not auth.get(n):
                    self.fault(f"authentication.{n}", "is required")
        cookies = raw.get("cookies_file")
        if isinstance(cookies, str) and folder is not None and not (folder / cookies).exists():
            self.fault("cookies_file", f"there is no file {folder / cookies}")
        pages = None
        if isinstance(raw.get("pagination"), dict):
            p = raw["pagination"]
            if s := self.selector(p.get("selector"), "pagination.selector"):
                pages = Pagination(s, str(p.get("query_param", "after")), self.number(p, "max_pages", 5, 1, None, "pagination.", int))
        return Spec(
            name=str(raw.get("name", "")),
            fields=found,
            base_url=base,
            mode=mode,
            start_urls=start,
            sitemap_urls=maps,
            response_type=raw.get("response_type", "html"),
            pagination=pages,
            max_nested_urls=self.number(raw, "max_nested_urls", 5, 1, 100, kind=int),
            max_depth=self.number(raw, "max_depth", 2, 0, 100, kind=int),
            append_json_suffix=bool(raw.get("append_json_suffix")),
            fail_parent_on_nested_error=bool(raw.get("fail_parent_on_nested_error", True)),
            respect_robots_txt=bool(raw.get("respect_robots_txt")),
            robots_failure_policy=raw.get("robots_failure_policy", "allow"),
            record_field=raw.get("record_field"),
            dedup_mode=dedup_mode,
            dedup_fields=dedup_fields,
            min_records=self.number(check, "min_records_per_page", 0, 0, None, "validation.", int),
            required_fields=tuple(check.get("required_fields") or ()),
            policy=self.policy(raw.get("url_policy")),
            settings={k: raw[k] for k in raw if k in SETTINGS or k in CHOICES},
        )


def parse_spec(raw: Any, folder: Path | None = None) -> tuple[Spec | None, list[Issue]]:
    """(the spec, or None where an error was found; all issues)."""
    reader = _Reader()
    if not isinstance(raw, dict):
        return None, [Issue("config", "the root must be an object")]
    out = reader.spec(raw, folder)
    return (None if any(i.severity == "error" for i in reader.issues) else out), reader.issues


def expand_environment(text: str) -> str:
    """${NAME} and $NAME replaced by environment variables; one that isn't set is a KeyError."""
    return re.sub(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))", lambda m: os.environ[m.group(1) or m.group(2)], text)


def load_spec(path: str | Path) -> tuple[Spec | None, list[Issue]]:
    try:
        raw = json.loads(expand_environment(Path(path).read_bytes().decode()))
    except FileNotFoundError:
        return None, [Issue("config", f"there is no file {path}")]
    except json.JSONDecodeError as e:
        return None, [Issue("json", f"invalid JSON: {e.msg}")]
    except KeyError as e:
        return None, [Issue("config", f"environment variable {e.args[0]} isn't set")]
    return parse_spec(raw, Path(path).parent)


def spec(**raw: Any) -> Spec:
    """A spec written in Python; raises ValueError with all issues where it has errors. Without a source, list mode is fine."""
    raw = {"name": "inline", "start_urls": ["http://localhost/"], "mode": "list", **raw}
    out, issues = parse_spec(raw)
    if out is None:
        raise ValueError("; ".join(f"{i.path}: {i.message}" for i in issues if i.severity == "error"))
    return out


def take(name: str, *selectors: str | dict[str, str]) -> dict[str, Any]:
    """A field as specs have it: its name, and selectors in order of preference."""
    return {"name": name, "selectors": list(selectors)}


def issues_frame(spark, issues: list[Issue]):
    return spark.createDataFrame([(i.path, i.message, i.severity) for i in issues], "path string, message string, severity string")


