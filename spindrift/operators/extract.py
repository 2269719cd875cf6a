"""From pages to records: a spec's field tree, evaluated once a page, in one Arrow pass.

Catalyst neither prunes columns nor pushes filters through such a pass, so extract takes only the key columns it is asked
for, the body and the requested fields below it. Fields that Spark's own functions can express (plain JSON paths, page-wide
regular expressions) never get to Python: they are columns computed beside the scan."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import jsonpath
from ..functions.transforms import apply_chain, chain, compiled
from ..html import css, xpath
from ..html.tree import Node, Tree
from ..spec import Field, Spec

#: Bytes of an Arrow batch: pages are large, and a worker holds a batch and its records at once.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def _selected(context: Node, kind: str, value: str) -> list[Node | str]:
    if kind == "css":
        return css.select(context, value)
    if kind == "xpath":
        return xpath.select(context, value)
    return []


def _value(found: Node | str, attribute: str | None) -> str:
    if isinstance(found, str):
        return found
    return found.attrs.get(attribute, "") if attribute else found.text()


def _joined(match: re.Match[str]) -> str:
    return "".join(g or "" for g in match.groups()) if match.re.groups else match.group()


def _html_values(tree: Tree, context: Node, raw: str, f: Field, top: bool) -> list[Any]:
    for s in f.selectors:
        if s.kind == "regex":
            if top:
                out = list(dict.fromkeys(m.groups("") if m.re.groups > 1 else m.group(1) if m.re.groups else m.group() for m in compiled(s.value).finditer(raw)))
                if out:
                    return [None if x is None else list(x) if isinstance(x, tuple) else x for x in out]
                continue
            out = [apply_chain(_joined(m), f.transformers) for m in compiled(s.value).finditer(context.markup())]
        else:
            found = _selected(context, s.kind, s.value)
            if f.children:
                if found := [x for x in found if isinstance(x, Node)]:
                    return [{c.name: _html_field(tree, x, raw, c, False) for c in f.children} for x in found]
                continue
            out = [apply_chain(_value(x, f.attribute), f.transformers) for x in found]
        out = [x for x in out if x is not None]
        if out:
            return out
    return []


def _html_field(tree: Tree, context: Node, raw: str, f: Field, top: bool) -> Any:
    found = _html_values(tree, context, raw, f, top)
    if f.follow_url:
        return [str(x) for x in (found if f.is_list else found[:1])]
    return found if f.is_list else found[0] if found else None


def _plain(value: Any, kind: str) -> Any:
    """A JSON value as the type that its field declares; null where it isn't of it."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    try:
        if kind == "boolean":
            return value if isinstance(value, bool) else None
        return int(value) if kind == "bigint" else float(value)
    except (ValueError, TypeError, OverflowError):
        return None


def _json_field(context: Any, raw: str, f: Field, top: bool) -> Any:
    found: list[Any] = []
    for s in f.selectors:
        if s.kind == "regex":
            body = raw if top else json.dumps(context, ensure_ascii=False)
            found = list(dict.fromkeys(m.groups("") if m.re.groups > 1 else m.group(1) if m.re.groups else m.group() for m in compiled(s.value).finditer(body)))
            found = [list(x) if isinstance(x, tuple) else x for x in found]
        elif s.kind == "json":
            found = jsonpath.find(context, s.value)
        if found:
            break
    if f.children:
        out = [{c.name: _json_field(x, raw, c, False) for c in f.children} for x in (found if f.is_list else found[:1])]
        return out if f.is_list else out[0] if out else None
    if f.follow_url:
        return [str(x) for x in (found if f.is_list else found[:1]) if x is not None]
    kind = f.type if f.spark_type(True).startswith(("string", "bigint", "double", "boolean", "array")) else "string"
    numeric = any(n in ("to_float", "to_int") for n, _ in f.transformers)
    out = []
    for x in found if f.is_list else found[:1]:
        if isinstance(x, list) and any(s.kind == "regex" for s in f.selectors):
            out.append(x)
            continue
        v = apply_chain(x if isinstance(x, (str, int, float)) or x is None else _plain(x, "string"), f.transformers)
        out.append(v if numeric else _plain(v, kind))
    return out if f.is_list else out[0] if out else None


def records_of(body: str | None, fields: Sequence[Field], json_page: bool) -> tuple[dict[str, Any] | None, str | None, str | None]:
    """(record, category of the error, its message) of one page. A page never raises: its row carries the error."""
    if body is None or not body.strip():
        return None, "parse_error", "the body is empty"
    try:
        if json_page:
            data = json.loads(body)
            return {f.name: _json_field(data, body, f, True) for f in fields}, None, None
        tree = Tree(body)
        return {f.name: _html_field(tree, tree.root, body, f, True) for f in fields}, None, None
    except json.JSONDecodeError as e:
        return None, "parse_error", f"invalid JSON: {e.msg}"[:200]
    except Exception as e:
        return None, "internal_error", f"{type(e).__name__}: {e}"[:200]


def _java_like(pattern: str) -> bool:
    """Whether Java reads the pattern as Python does: no named groups, no classes that differ beyond ASCII."""
    return not re.search(r"\(\?P|\\[wWdDsSbBZAz]|\(\?\(|\(\?[aiLmsux]", pattern)


def native_column(f: Field, body: Column, parsed: Column | None) -> Column | None:
    """The field by Spark's functions alone, or None where they can't express it."""
    if len(f.selectors) != 1 or f.children or f.follow_url:
        return None
    s = f.selectors[0]
    if s.kind == "regex" and parsed is None and f.is_list and _java_like(s.value) and compiled(s.value).groups < 2:
        return F.coalesce(F.array_distinct(F.regexp_extract_all(body, F.lit(s.value), F.lit(compiled(s.value).groups))), F.array().cast("array<string>"))
    if s.kind == "json" and parsed is not None and not f.is_list and (path := jsonpath.simple(s.value)):
        if f.transformers and f.type != "string" or any(n == "regex" and not _java_like(a[0]) for n, a in f.transformers):
            return None
        out = F.try_variant_get(parsed, path, "string" if f.transformers else f.type)
        return chain(out, f.transformers) if f.transformers else out
    return None


def extract(pages: DataFrame, spec: Spec, keys: Sequence[str] = ("url",), body: str = "html", fields: Sequence[str] | None = None) -> DataFrame:
    """keys, a column for each field, error_category and error_message, for each page.

    A page that can't be read has null fields and an error; a page on which a field finds nothing has null there, or an
    empty list. fields names those to extract, all of them otherwise."""
    spec = spec if fields is None else spec.pruned(fields)
    json_page = spec.response_type == "json"
    text = F.col(f"`{body}`").cast("string")
    parsed = F.try_parse_json(text) if json_page else None
    native = {f.name: c for f in spec.fields if (c := native_column(f, text, parsed)) is not None}
    slow = [f for f in spec.fields if f.name not in native]
    order = [*keys, *[f.name for f in spec.fields], "error_category", "error_message"]
    blank = text.isNull() | (F.trim(text) == "")
    if not slow:
        error = F.when(blank, "the body is empty")
        if json_page:
            error = error.when(parsed.isNull(), "invalid JSON")
        out = pages.select(*[F.col(f"`{k}`") for k in keys], *[F.when(error.isNull(), c).alias(n) for n, c in native.items()], error.alias("error_message"))
        return out.withColumn("error_category", F.when(F.col("error_message").isNotNull(), "parse_error")).select(*[f"`{c}`" for c in order])
    before = pages.select(*[F.col(f"`{k}`") for k in keys], *[c.alias(f"__native_{n}") for n, c in native.items()], text.alias("__body"))
    kept = before.schema.fields[:-1]
    made = StructType.fromDDL(", ".join([*[f"`{f.name}` {f.spark_type(json_page)}" for f in slow], "error_category string, error_message string"]))
    schema = StructType([*kept, *made.fields])
    types = to_arrow_schema(made).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [records_of(b.as_py(), slow, json_page) for b in batch.column(batch.num_columns - 1)]
            columns = [[None if r is None else r[f.name] for r, _, _ in done] for f in slow]
            columns += [[c for _, c, _ in done], [m for _, _, m in done]]
            arrays = [_array(v, t, done) for v, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], schema.names)

    conf = pages.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    out = before.mapInArrow(run, schema)
    for n in native:
        out = out.withColumn(n, F.when(F.col("error_category").isNull(), F.col(f"`__native_{n}`")))
    return out.select(*[f"`{c}`" for c in order])


def _array(values: list[Any], kind: pa.DataType, done: list) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
        return pa.array([_fit(v, kind) for v in values], kind)


def _fit(value: Any, kind: pa.DataType) -> Any:
    """The value where the column can hold it, null where it can't: a number beyond 64 bits, half a surrogate pair."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    if isinstance(value, list):
        return [_fit(v, kind.value_type) for v in value]
    if isinstance(value, dict):
        return {f.name: _fit(value.get(f.name), f.type) for f in kind}
    try:
        return pa.scalar(value, kind).as_py()
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
        return None


def preview(record: DataFrame, spec: Spec) -> DataFrame:
    """(field, matches, samples, warning) of one page's extracted row: how many values each field has, three of them."""
    parts = []
    for f in spec.fields:
        c = F.col(f"`{f.name}`")
        many = f.is_list or f.follow_url
        n = F.coalesce(F.size(c), F.lit(0)) if many else c.isNotNull().cast("int")
        texts = F.transform(F.slice(c, 1, 3), lambda x: x.cast("string") if not f.children else F.to_json(x)) if many else F.array(F.to_json(c) if f.children else c.cast("string"))
        parts.append(F.struct(F.lit(f.name).alias("field"), n.alias("matches"), F.when(n > 0, texts).otherwise(F.array().cast("array<string>")).alias("samples"), F.when(n == 0, "nothing matched").alias("warning")))
    return record.limit(1).select(F.explode(F.array(*parts)).alias("x")).select("x.*")
