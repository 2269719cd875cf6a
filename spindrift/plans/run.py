"""A whole run of a spec over a table of pages: policy, robots, extraction, following, validation, duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import materialise
from ..functions.urls import crawl_key
from ..operators.extract import extract
from ..operators.nested import follow, page_index
from ..operators.records import deduplicate, record_count, validation_error
from ..sources.robots import filter_by_robots
from ..spec import Spec


@dataclass
class Outcome:
    """records that are kept; failures (url, category, message, and the order column); good, all that passed validation."""

    records: DataFrame
    failures: DataFrame
    good: DataFrame


def run_spec(spec: Spec, pages: DataFrame, url: str = "url", body: str = "html", robots: DataFrame | None = None, done: DataFrame | None = None, seen: DataFrame | None = None, order: str | None = None, linked: DataFrame | None = None, once: bool = False) -> Outcome:
    """Everything that needs no body comes first, below the page pass: pages done before (done, a column url), the policy,
    robots rules; where rules are to be respected and there are none, robots_failure_policy decides. linked holds the pages
    that links lead to, pages itself unless given. once: the extracted rows are kept, so that what reads several of the
    results doesn't parse the pages again."""
    key = crawl_key(F.col(f"`{url}`"))
    wanted = pages.where(spec.policy.reject_reason(F.col(f"`{url}`")).isNull())
    if done is not None:
        wanted = wanted.withColumn("__key", key).join(done.select(crawl_key(F.col("url")).alias("__key")), "__key", "left_anti").drop("__key")
    if spec.respect_robots_txt:
        none = pages.sparkSession.createDataFrame([], "origin string, status int, body string")
        wanted = filter_by_robots(wanted, robots if robots is not None else none, url, spec.robots_failure_policy)
    keys = list(dict.fromkeys([url, *([order] if order else [])]))
    rows = extract(wanted, spec, keys, body)
    if any(f.follow_url for f in spec.fields):
        rows = follow(rows, page_index(linked if linked is not None else pages, url, body), spec, url)
    names = [f.name for f in spec.fields]
    invalid = validation_error(rows, names, spec.required_fields, spec.min_records, spec.record_field)
    rows = rows.withColumn("error_message", F.coalesce("error_message", F.when(F.col("error_category").isNull(), invalid)))
    rows = rows.withColumn("error_category", F.coalesce("error_category", F.when(F.col("error_message").isNotNull(), "validation_error")))
    if once:
        rows = materialise(rows)
    more = [F.col(f"`{order}`")] if order else []
    failures = rows.where("error_category is not null").select(F.col(f"`{url}`").alias("url"), F.col("error_category").alias("category"), F.col("error_message").alias("message"), *more)
    good = rows.where("error_category is null").drop("error_category", "error_message")
    return Outcome(deduplicate(good, spec.dedup_mode, names, keys[::-1], spec.dedup_fields, url, seen), failures, good)


def with_record_count(df: DataFrame, spec: Spec) -> DataFrame:
    return df.withColumn("record_count", record_count(df, [f.name for f in spec.fields], spec.record_field))
