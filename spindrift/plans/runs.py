"""Queries over whole runs: lists, chains, sitemaps, and a run that goes on from an earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import origin
from ..operators.crawl import latest_state
from ..sources.sitemap import discover
from ..spec import Spec, parse_spec, spec, take
from .base import query, table
from .extraction import plain
from .source import next_links, run_source

_TITLE = plain("regexp_extract(html, '<title>(.*?)</title>', 1)")
_ARTICLES = {"fields": [take("title", "title")], "validation": {"required_fields": ["title"]}}


def _start(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.col("page_id").alias("place"))


#: A page for each URL without its fragment, and a record for each title.
_RUN = f"""SELECT url, title FROM (SELECT min(page_id) AS place, min(url) AS url, arg_min({_TITLE}, url) AS title FROM pages GROUP BY regexp_replace(url, '#.*$', ''))
WHERE %s QUALIFY row_number() OVER (PARTITION BY title ORDER BY place) = 1"""


@query(_RUN % "NOT starts_with(regexp_extract(url, '^https?://[^/]+(/.*)$', 1), '/es/')")
def run_list_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as the list of a run that keeps to robots rules, one record a title."""
    pages = table(spark, sf_dir, "pages")
    robots = pages.select(origin(F.col("url")).alias("origin")).distinct().select("origin", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /es/").alias("body"))
    s = spec(**_ARTICLES, respect_robots_txt=True, robots_failure_policy="deny")
    return run_source(s, pages, robots=robots, start=_start(pages)).records.select("url", "title")


@query(_RUN % "true")
def run_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the first over half of the list, the second from its state and keys: together the records of one."""
    pages, s = table(spark, sf_dir, "pages"), spec(**_ARTICLES)
    first = run_source(s, pages, start=_start(pages), limit=pages.count() // 2)
    log = first.log.withColumns({"seq": F.when(F.col("status") == "in_progress", 0).otherwise(1), "ts": F.lit("")})
    second = run_source(s, pages, start=_start(pages), state=latest_state(log), seen=first.keys)
    return first.records.unionByName(second.records).select("url", "title")


def _api(after: int | None = None) -> Spec:
    raw = {"name": "api", "base_url": "http://api.test/list?after=0", "response_type": "json", "fields": [{"name": "id", "selector": {"type": "json", "value": "id"}, "type": "bigint"}], "pagination": {"selector": "data.after", "max_pages": 20}}
    return parse_spec(raw)[0]


def _json_pages(df: DataFrame, key: str, least: int) -> DataFrame:
    """A page for each key, whose cursor is the key after it."""
    n = F.col(key).cast("string")
    body = F.concat(F.lit('{"id": '), n, F.lit(', "data": {"after": "'), (F.col(key) + 1).cast("string"), F.lit('"}}'))
    return df.select(F.col(key), F.concat(F.lit("http://api.test/list?after="), (F.col(key) - least).cast("string")).alias("url"), body.alias("html"))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey < 20")
def run_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of an API by its cursors, 20 at most."""
    pages = _json_pages(table(spark, sf_dir, "nation"), "n_nationkey", 0)
    return run_source(_api(), pages).records.select("id")


@query("SELECT o_orderkey, 'http://api.test/list?after=' || (o_orderkey + 1) AS next_key FROM orders")
def proj_next_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _json_pages(table(spark, sf_dir, "orders"), "o_orderkey", 0)
    return next_links(pages, _api(), keys=("o_orderkey",)).select("o_orderkey", "next_key")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN 'http://shop.test/order/' || (o_orderkey + 1) END AS next_key FROM orders")
def proj_next_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page by a link; a link elsewhere, which the policy forbids, ends a chain."""
    raw = {"name": "shop", "base_url": "http://shop.test/order/1", "fields": [take("title", "h1")], "pagination": {"selector": "a.next"}, "url_policy": {"allow_external_urls": False}}
    k = F.col("o_orderkey")
    host = F.when(k % 7 > 0, "").otherwise("http://elsewhere.test")
    pages = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("http://shop.test/order/"), k.cast("string")).alias("url"), F.concat(F.lit('<h1>Order</h1><a href="/x">x</a><a class="next" href="'), host, F.lit("/order/"), (k + 1).cast("string"), F.lit('#top">next</a>')).alias("html"))
    return next_links(pages, parse_spec(raw)[0], keys=("o_orderkey",)).select("o_orderkey", "next_key")


@query("SELECT row_number() OVER (ORDER BY c_custkey // 500, c_custkey) - 1 AS place, 'http://shop.test/c/' || c_custkey AS url FROM customer")
def sitemap_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of sitemaps of 500 customers' pages each, walked breadth first."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 500).cast("long").alias("part"))
    loc = lambda tag, path, key: F.concat(F.lit(f"<{tag}><loc>{path}"), key.cast("string"))
    body = lambda root, items: F.concat(F.lit(f'<{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(items, ""), F.lit(f"</{root}>"))
    urls = F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(loc("url", "/c/", k), F.lit("</loc></url>")))
    maps = c.groupBy("part").agg(body("urlset", urls).alias("body")).select(F.concat(F.lit("http://shop.test/"), F.col("part").cast("string"), F.lit(".xml")).alias("url"), "body")
    parts = F.transform(F.array_sort(F.collect_set("part")), lambda k: F.concat(loc("sitemap", "/", k), F.lit(".xml</loc></sitemap>")))
    index = c.agg(body("sitemapindex", parts).alias("body")).select(F.lit("http://shop.test/index.xml").alias("url"), "body")
    found = discover(["http://shop.test/index.xml"], index.unionByName(maps), max_urls=1_000_000)
    return spark.createDataFrame(list(enumerate(found)), "place long, url string")
