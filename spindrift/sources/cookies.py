"""Cookie files, and which of their cookies go to a URL."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host, origin


def load_cookies(spark: SparkSession, path: str | Path) -> DataFrame:
    """(name, value, url, domain) of a file that holds an object of names and values, or a list of objects."""
    raw = json.loads(Path(path).read_bytes())
    if isinstance(raw, dict):
        rows = [(str(k), str(v), None, None) for k, v in raw.items()]
    else:
        rows = [(str(c["name"]), str(c["value"]), c.get("url"), c.get("domain")) for c in raw if isinstance(c, dict) and "name" in c and "value" in c]
    return spark.createDataFrame(rows, "name string, value string, url string, domain string")


def in_scope(cookies: DataFrame, scope_url: str) -> DataFrame:
    """The cookies for a URL: those of its origin, those of its very host, and those that name neither."""
    at = F.lit(scope_url)
    same = F.coalesce(origin(F.col("url")) == origin(at), F.lit(False))
    own = F.coalesce(F.regexp_replace(F.lower("domain"), "^\\.", "") == host(at), F.lit(False))
    return cookies.where(F.when(F.col("url").isNotNull(), same).when(F.col("domain").isNotNull(), own).otherwise(True))
