"""Results to files: JSON lines with their nulls, one JSON array, flat CSV, failures, manifest and report."""

from __future__ import annotations

import json
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import config_digest, flatten, join_list, redact_config, redact_text


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """A line a row, nulls written out, by all tasks at once; Spark's commit protocol makes the whole visible or nothing."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """(batch, items): rows in batches of a size, by their order column, a whole number from 0."""
    return df.groupBy((F.floor(F.col(order) / size)).cast("long").alias("batch")).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*[f"`{c}`" for c in df.columns]).alias("item")))).alias("x")).select("batch", F.transform("x", lambda r: r["item"]).alias("items"))


def write_json_array(df: DataFrame, path: str, indent: int = 2) -> int:
    """One file with one JSON array, streamed through the driver a partition at a time. For results that one reader takes
    whole; write_jsonl is for the rest. Nothing is left at path after an error."""
    out, n = Path(path), 0
    part = out.with_suffix(out.suffix + ".tmp")
    part.parent.mkdir(parents=True, exist_ok=True)
    try:
        with part.open(encoding="utf-8", mode="w") as f:
            f.write("[")
            for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
                text = json.dumps(json.loads(row.j), ensure_ascii=False, indent=indent)
                f.write(("," if n else "") + "\n" + "\n".join(" " * indent + x for x in text.split("\n")))
                n += 1
            f.write("\n]\n" if n else "]\n")
        part.replace(out)
    finally:
        part.unlink(missing_ok=True)
    return n


def csv_columns(names: list[str], field_order: list[str] = []) -> list[str]:
    """The header: configured names that exist, in their order, then the others sorted."""
    first = [c for c in dict.fromkeys(field_order) if c in names]
    return [*first, *sorted(set(names) - set(first))]


def flat_rows(df: DataFrame, field_order: list[str] = []) -> DataFrame:
    """Structs spread out, lists as one cell, everything else as text; columns in the header's order."""
    flat = flatten(df)
    cells: dict[str, Any] = {}
    for f in flat.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            c = join_list(F.transform(c, lambda x: F.to_json(x)) if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)) else c)
        elif isinstance(f.dataType, T.MapType):
            c = F.to_json(c)
        cells[f.name] = c.cast("string").alias(f.name)
    return flat.select(*[cells[c] for c in csv_columns(list(cells), field_order)])


def write_csv(df: DataFrame, path: str, field_order: list[str] = []) -> None:
    flat = flat_rows(df, field_order)
    if not flat.columns:
        raise ValueError("there are no columns to write")
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_failures(failures: DataFrame, path: str) -> None:
    """url, category, message and timestamp a line, without credentials, the message at most 200 characters."""
    df = failures.select(redact_text(F.col("url")).alias("url"), "category", F.substring(redact_text(F.col("message")), 1, 200).alias("message"), "timestamp")
    write_jsonl(df, path)


def write_manifest(path: str | Path, raw: dict, resume: bool = False, **more: Any) -> dict:
    """The manifest of a run: a digest of its configuration, and the configuration without secrets. A resumed run must
    have the digest of the one it goes on from."""
    p, digest = Path(path), config_digest(raw)
    before = json.loads(p.read_text()) if p.exists() else {}
    if resume and before and before.get("config_digest") != digest:
        raise ValueError("the configuration isn't that of the run to resume")
    out = {**before, "config_digest": digest, "config": redact_config(raw), **more}
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_suffix(".tmp")
    part.write_text(json.dumps(out, indent=2, default=str, ensure_ascii=False))
    part.replace(p)
    return out


def sizes(paths: list[str | Path]) -> dict[str, int]:
    """Bytes of each file or folder, 0 where there is none."""
    return {str(p): sum(x.stat().st_size for x in ([q] if q.is_file() else q.rglob("*")) if x.is_file()) if (q := Path(p)).exists() else 0 for p in paths}


def remove(path: str | Path) -> None:
    shutil.rmtree(path, ignore_errors=True)
