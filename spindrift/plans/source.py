"""What a run works on: the pages of a list or of a chain, by a spec's mode, and the whole run over them with its state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import materialise
from ..functions import jsonpath
from ..functions.urls import canonicalize, crawl_key, next_url
from ..html import css, xpath
from ..html.tree import Node, Tree
from ..operators.crawl import incomplete, walk_pages, work_list
from ..operators.records import dedup_keys
from ..sources.robots import filter_by_robots
from ..sources.sitemap import discover
from ..spec import Pagination, Spec
from .run import Outcome, run_spec

LOG = "url string, kind string, status string, error string, parent_url string"


@dataclass
class SourceRun(Outcome):
    """Besides records and failures: the rows to append to the state log, and the keys of the records that are kept."""

    log: DataFrame
    keys: DataFrame


def next_token(body: str | None, pagination: Pagination, json_page: bool) -> str | None:
    """What a page says of the next one: the first match's href, or the first value of a JSON path, whatever the selector
    is called. None where there is none, or the page can't be read."""
    s = pagination.selector
    try:
        if json_page:
            found = jsonpath.find(json.loads(body or ""), s.value)
            return None if not found or found[0] is None else str(found[0])
        tree = Tree(body or "")
        found = css.select(tree.root, s.value) if s.kind == "css" else xpath.select(tree.root, s.value) if s.kind == "xpath" else []
        return found[0].attrs.get("href") if found and isinstance(found[0], Node) else None
    except ValueError:
        return None


def next_links(pages: DataFrame, spec: Spec, url: str = "url", body: str = "html", keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, key, next_key) of each page: canonical URLs, next_key null where a page has no next one or the policy forbids it."""
    json_page, pagination = spec.response_type == "json", spec.pagination
    kinds = [f for f in pages.select(*[F.col(f"`{k}`") for k in keys]).schema.fields]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, urls, bodies = batch.columns[:-2], batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            to = [None if u is None else next_url(u, next_token(b.as_py(), pagination, json_page), pagination.query_param, json_page) for u, b in zip(urls.to_pylist(), bodies)]
            yield pa.RecordBatch.from_arrays([*own, urls, pa.array(to, pa.string())], [*keys, "url", "to"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "url string, to string"])
    found = pages.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{url}`").alias("__url"), F.col(f"`{body}`").cast("string").alias("__body")).mapInArrow(follow, schema)
    ok = spec.policy.reject_reason(F.col("to"), F.col("url")).isNull()
    return found.select(*keys, canonicalize(F.col("url")).alias("key"), F.when(ok, canonicalize(F.col("to"))).alias("next_key"))


def chain_of(spec: Spec, pages: DataFrame, url: str = "url", body: str = "html", limit: int | None = None, head: str | None = None) -> DataFrame:
    """(key, place): the canonical URLs of a pagination, from base_url or from where an earlier run broke off."""
    most = min(spec.pagination.max_pages if spec.pagination else 1, limit or 1 << 30)
    start = pages.sparkSession.createDataFrame([(head or spec.base_url,)], "url string").where(spec.policy.reject_reason(F.col("url")).isNull())
    start = start.select(canonicalize(F.col("url")).alias("start"))
    if spec.pagination is None:
        return start.select(F.col("start").alias("key"), F.lit(1).cast("long").alias("place"))
    links = materialise(next_links(pages, spec, url, body).groupBy("key").agg(F.min("next_key").alias("next_key")))
    return walk_pages(start, links, most).select("key", F.col("page_no").cast("long").alias("place"))


def list_of(spec: Spec, pages: DataFrame, documents: DataFrame | None = None, robots: DataFrame | None = None, state: DataFrame | None = None, limit: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """(key, place): start URLs, then those of the sitemaps, then what an earlier run left; without what is done.

    start (url, place) stands for start_urls where there are too many for a spec. A limit counts what is still to be done."""
    spark = pages.sparkSession
    numbered = lambda urls: spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, place long")
    canonical = lambda df: df.select(canonicalize(F.col("url")).alias("url"), "place")
    found = None
    if spec.sitemap_urls and documents is not None:
        bounds = {k: spec.settings[f"sitemap_{k}"] for k in ("max_urls", "max_depth", "max_documents", "max_queue", "max_bytes") if f"sitemap_{k}" in spec.settings}
        found = canonical(numbered(discover(list(spec.sitemap_urls), documents, allowed=lambda u: spec.policy.reject_reason(u).isNull(), **bounds)))
    left = None if state is None else canonical(incomplete(state, "root").select("url", F.lit(0).alias("place")))
    done = None if state is None else state.where("kind = 'root' and status = 'done'").select(canonicalize(F.col("url")).alias("url"))
    work = work_list(canonical(start if start is not None else numbered(spec.start_urls)), found, left, done, limit)
    work = work.select(F.col("url").alias("key"), (F.col("part") * F.lit(1 << 40) + F.col("place")).alias("place"))
    if spec.respect_robots_txt:
        work = filter_by_robots(work, robots_or_none(pages, robots), "key", spec.robots_failure_policy)
    return work


def robots_or_none(pages: DataFrame, robots: DataFrame | None) -> DataFrame:
    """A table of robots files; without one no origin has rules, and the failure policy decides."""
    return robots if robots is not None else pages.sparkSession.createDataFrame([], "origin string, status int, body string")


def run_source(spec: Spec, pages: DataFrame, url: str = "url", body: str = "html", documents: DataFrame | None = None, robots: DataFrame | None = None, state: DataFrame | None = None, seen: DataFrame | None = None, limit: int | None = None, start: DataFrame | None = None) -> SourceRun:
    """A run as the spec's mode says, over the pages that it leads to; state is what latest_state makes of the log so far.

    A URL without a page is a failure; of pages that share a canonical URL the one of the smallest stands for it. In a chain the first page that fails ends it: later pages count as never reached.
    Rows are computed once and kept: records, failures and log are read from them."""
    chained = spec.mode == "pagination"
    kind = "pagination" if chained else "root"
    if chained:
        left = [] if state is None else incomplete(state, kind).select("url").limit(1).collect()
        if state is not None and not left and state.where((F.col("kind") == kind) & (F.col("status") == "done")).limit(1).count():
            limit_zero = pages.limit(0).withColumn("place", F.lit(0))
            return _outcome(spec, limit_zero, pages, url, body, robots, seen, kind, None)
        work = chain_of(spec, pages, url, body, limit, left[0].url if left else None)
    else:
        work = list_of(spec, pages, documents, robots, state, limit, start)
    work = materialise(work)
    # Which page stands for which URL is found from the URLs alone; bodies are read once, for the pages that are wanted.
    chosen = materialise(work.join(pages.select(crawl_key(F.col(f"`{url}`")).alias("key"), F.col(f"`{url}`").alias("__url")), "key", "left").groupBy("key", "place").agg(F.min("__url").alias("__url")))
    found = pages.join(chosen.where("__url is not null").select(F.col("__url").alias(url), "place"), url)
    missing = chosen.where("__url is null").select("key", "place")
    return _outcome(spec, found, pages, url, body, None if not chained else robots, seen, kind, missing)


def _outcome(spec: Spec, found: DataFrame, pages: DataFrame, url: str, body: str, robots: DataFrame | None, seen: DataFrame | None, kind: str, missing: DataFrame | None) -> SourceRun:
    plain = spec if kind == "pagination" else replace(spec, respect_robots_txt=False)  # a list's rules are applied before
    out = run_spec(plain, found, url, body, robots, seen=seen, order="place", linked=pages, once=True)
    bad = out.failures.select("url", "category", "message", "place")
    if missing is not None:
        bad = bad.unionByName(missing.select(F.col("key").alias("url"), F.lit("network_error").alias("category"), F.lit("there is no such page").alias("message"), "place"))
    records, good = out.records, out.good
    if kind == "pagination":
        first = bad.agg(F.min("place")).first()[0]
        if first is not None:
            bad, records, good = bad.where(F.col("place") == first), records.where(F.col("place") < first), good.where(F.col("place") < first)
    names = [f.name for f in spec.fields]
    row = lambda df, status, error: df.select(F.col("url"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), error.cast("string").alias("error"), F.lit(None).cast("string").alias("parent_url"))
    reached = good.select(F.col(f"`{url}`").alias("url"))
    log = row(reached, "in_progress", F.lit(None)).unionByName(row(bad, "in_progress", F.lit(None))).unionByName(row(reached, "done", F.lit(None))).unionByName(row(bad, "failed", F.col("category")))
    return SourceRun(records.drop("place"), bad.drop("place"), good, log, dedup_keys(records, spec.dedup_mode, names, spec.dedup_fields, url))
