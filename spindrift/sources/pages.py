"""Where pages come from: tables of fetched pages, batch lines of earlier runs, and a protocol for other sources."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PageSource(Protocol):
    """Anything that gives pages as rows of url and body, and whatever else it knows of them."""

    def load(self, spark: SparkSession) -> DataFrame: ...


class TableSource:
    """Pages in files of a format that Spark reads."""

    def __init__(self, path: str, format: str = "parquet", **options: str) -> None:
        self.path, self.format, self.options = path, format, options

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).options(**self.options).load(self.path)


def page_rows(df: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Rows in the shape of a fetch: with status 200, no attempts, headers or errors where the source doesn't know them."""
    have = {c.lower() for c in df.columns}
    col = lambda n, default, kind: (F.col(n) if n in have else F.lit(default)).cast(kind).alias(n)
    return df.select(
        F.col(url).alias("requested_url"),
        (F.col("final_url") if "final_url" in have else F.col(url)).alias("final_url"),
        F.col(body).cast("string").alias("content"),
        col("status_code", 200, "int"),
        (F.col("headers") if "headers" in have else F.lit(None)).cast("map<string,string>").alias("headers"),
        col("elapsed_ms", None, "double"),
        col("attempts", 1, "int"),
    )


def read_batches(spark: SparkSession, path: str, item: T.StructType | str) -> DataFrame:
    """The items of lines {"items": [...]}, one row each, in a column of their type. A malformed line is an error."""
    kind = item if isinstance(item, str) else item.simpleString()
    lines = spark.read.schema(f"items array<{kind}>").option("mode", "FAILFAST").json(path)
    return lines.select(F.explode("items").alias("item")).select("item.*")


def unnest(df: DataFrame, column: str = "items") -> DataFrame:
    return df.select(F.explode(F.col(f"`{column}`")).alias("item")).select("item.*")
