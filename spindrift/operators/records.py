"""What is kept of extracted records: record counts, validation, duplicates, and keys of earlier runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import record_key


def record_count(df: DataFrame, fields: Sequence[str], record_field: str | None = None) -> Column:
    """How many records a page has: the length of record_field, or 1 or 0 where it isn't a list; else the length of the
    longest list; 1 where there is none."""
    size = lambda c: F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0))
    is_list = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    if record_field:
        return size(record_field) if record_field in is_list else F.col(f"`{record_field}`").isNotNull().cast("int")
    lists = [size(c) for c in fields if c in is_list]
    return F.lit(1) if not lists else lists[0] if len(lists) == 1 else F.greatest(*lists)


def validation_error(df: DataFrame, fields: Sequence[str], required: Sequence[str] = (), min_records: int = 0, record_field: str | None = None) -> Column:
    """Why a record doesn't pass, null where it does. Empty strings and lists count as present."""
    out = F.lit(None).cast("string")
    if min_records > 0:
        out = F.when(record_count(df, fields, record_field) < min_records, f"fewer than {min_records} records")
    for name in required:
        out = F.coalesce(out, F.when(F.col(f"`{name}`").isNull(), f"{name} is missing"))
    return out


def validate(df: DataFrame, fields: Sequence[str], required: Sequence[str] = (), min_records: int = 0, record_field: str | None = None, hard: bool = True) -> DataFrame:
    """The rows that pass, or, if not hard, all rows with a column warning."""
    if not required and min_records <= 0:
        return df if hard else df.withColumn("warning", F.lit(None).cast("string"))
    error = validation_error(df, fields, required, min_records, record_field)
    return df.where(error.isNull()) if hard else df.withColumn("warning", error)


def dedup_key(df: DataFrame, mode: str, fields: Sequence[str], by: Sequence[str] = (), url: str | None = None) -> Column | None:
    """The value by which a record counts as one seen before; None in mode none."""
    if mode == "none":
        return None
    if mode == "fields":
        return record_key(df, list(by))
    content = record_key(df, list(fields))
    return F.coalesce(F.col(f"`{url}`"), content) if mode == "url" and url else content


def deduplicate(df: DataFrame, mode: str, fields: Sequence[str], order: Sequence[str], by: Sequence[str] = (), url: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The first record of each key, by the order columns; those whose key is in seen (a column key) go as well.

    One shuffle by the key, which a window and the join with seen share. No filter bounds what is remembered: it is exact."""
    key = dedup_key(df, mode, fields, by, url)
    if key is None:
        return df
    name = "__dedup_key"
    keyed = df.withColumn(name, key)
    if seen is not None:
        keyed = keyed.join(seen.select(F.col("key").alias(name)), name, "left_anti")
    w = Window.partitionBy(name).orderBy(*[F.col(f"`{c}`") for c in order])
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", name)


def dedup_keys(df: DataFrame, mode: str, fields: Sequence[str], by: Sequence[str] = (), url: str | None = None) -> DataFrame:
    """(key) of each distinct record, for a later run."""
    key = dedup_key(df, mode, fields, by, url)
    return df.select((F.lit(None).cast("string") if key is None else key).alias("key")).where("key is not null").distinct()


def duplicates(df: DataFrame, mode: str, fields: Sequence[str], by: Sequence[str] = (), url: str | None = None) -> DataFrame:
    """(records, kept, duplicates) as one row."""
    key = dedup_key(df, mode, fields, by, url)
    kept = F.count("*") if key is None else F.count_distinct(key)
    return df.agg(F.count("*").alias("records"), kept.alias("kept")).withColumn("duplicates", F.col("records") - F.col("kept"))


def newest(df: DataFrame, n: int, order: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """The last n rows by the order columns, of all or of each group; hits don't refresh a row's place."""
    if not per:
        return df.orderBy(*[F.col(f"`{c}`").desc() for c in order]).limit(n)
    w = Window.partitionBy(*per).orderBy(*[F.col(f"`{c}`").desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def within_bytes(df: DataFrame, most: int, size: str, order: Sequence[str], per: Sequence[str]) -> DataFrame:
    """Of each group the newest rows whose sizes together are at most so many bytes."""
    w = Window.partitionBy(*per).orderBy(*[F.col(f"`{c}`").desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(size).over(w)).where(F.col("__sum") <= most).drop("__sum")


def ordered_distinct(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
