"""Queries over joins, duplicates, windows, sets and sinks' shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flatten
from ..functions.urls import UrlPolicy
from ..operators import crawl, nested, records
from ..sinks.files import batches, flat_rows
from ..sources.pages import unnest
from ..spec import spec, take
from .base import query, table


def _lines(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """Orders with at most so many of their lines nested, in order, and their lineage."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("pos"), F.struct("l_partkey", F.concat(F.lit("/part/"), F.col("l_partkey").cast("string")).alias("_source_url"), F.concat(F.lit("/order/"), F.col("l_orderkey").cast("string")).alias("_parent_url")).alias("child"))
    kind = dict(links.dtypes)["child"]
    out = nested.attach(table(spark, sf_dir, "orders"), links, "o_orderkey", "lines", kind)
    return out.withColumn("lines", F.slice("lines", 1, limit))


@query("""
SELECT o_orderkey, CAST(least(count(l_orderkey), 5) AS INT) AS n_lines,
       coalesce(array_to_string(list_slice(list('/part/' || l_partkey || '</order/' || l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) FILTER (l_orderkey IS NOT NULL), 1, 5), '|'), '') AS lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("lines", lambda x: F.concat(x["_source_url"], F.lit("<"), x["_parent_url"])), "|")
    return _lines(spark, sf_dir, 5).select("o_orderkey", F.size("lines").alias("n_lines"), shown.alias("lines"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 = 0)")
def nested_fail_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for orders that link to pages for their parts; every tenth part has none, and a parent fails with any child."""
    s = spec(fields=[{**take("parts", "a"), "is_list": True, "attribute": "href", "follow_url": True, "nested_fields": [take("id", "h1")]}], max_nested_urls=100, fail_parent_on_nested_error=True)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda k: F.concat(F.lit('<a href="/part/'), k.cast("string"), F.lit('">p</a>'))), "").alias("links"))
    url = lambda kind, c: F.concat(F.lit(f"http://shop.test/{kind}/"), c.cast("string"))
    parents = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", url("order", F.col("o_orderkey")).alias("url"), F.concat(F.lit("<p>"), F.coalesce("links", F.lit(""))).alias("html")).repartition("url")  # a small file is one task, where its join is broadcast
    parts = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(url("part", F.col("p_partkey")).alias("url"), F.lit("<h1>Part</h1>").alias("html"))
    rows = nested.follow(nested.extract(parents, s, ("o_orderkey", "url")), nested.page_index(parts), s, policy=UrlPolicy())
    return rows.where("error_category is null").select("o_orderkey")


@query("""
SELECT c_custkey, CAST(count(o_orderkey) AS INT) AS n_children, coalesce(array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), ','), '') AS children
FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
WHERE n <= 5 GROUP BY c_custkey
""")
def follow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for customers that link to pages for their orders: extracted, followed and nested, five links at most."""
    s = spec(fields=[{**take("kids", "a"), "is_list": True, "attribute": "href", "follow_url": True, "nested_fields": [{**take("id", "h1"), "transformers": ["to_int"]}]}], url_policy={"allow_external_urls": False}, max_nested_urls=5)
    url = lambda kind, c: F.concat(F.lit(f"http://shop.test/{kind}/"), c.cast("string"))
    orders = table(spark, sf_dir, "orders")
    links = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit('<a href="../order/'), k.cast("string"), F.lit('#x">o</a>'))), "").alias("links"))
    parents = table(spark, sf_dir, "customer").join(links, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", url("customer", F.col("c_custkey")).alias("url"), F.concat(F.lit("<p>"), F.coalesce("links", F.lit(""))).alias("html")).repartition("url")  # a small file is one task, where its join is broadcast
    children = orders.select(url("order", F.col("o_orderkey")).alias("url"), F.concat(F.lit("<h1>Order "), F.col("o_orderkey").cast("string"), F.lit("</h1>")).alias("html"))
    rows = nested.follow(nested.extract(parents, s, ("c_custkey", "url")), nested.page_index(children), s, policy=UrlPolicy())
    return rows.select("c_custkey", F.size("kids").alias("n_children"), F.array_join(F.transform("kids", lambda k: k["id"].cast("string")), ",").alias("children"))


_EDGES = "SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation"


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), w(start, node, depth, path) AS (
  SELECT n_nationkey, n_nationkey, 0, [n_nationkey] FROM nation
  UNION ALL SELECT w.start, e.dst, w.depth + 1, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, e.dst))
SELECT start, depth, array_to_string(path, '>') AS path FROM w
""")
def cycle_depth_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    edges = n.select(k.alias("src"), ((k * 7 + 3) % 25).alias("dst")).union(n.select(k, (k * 3 + 1) % 25)).distinct()
    w = crawl.walk_links(n.select(k.alias("start")), edges, 3)
    return w.select("start", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""
WITH RECURSIVE l AS (SELECT page_id AS key, lead(page_id) OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS next_key FROM pages),
w(start, page_no, key) AS (SELECT min(page_id), 1, min(page_id) FROM pages GROUP BY page_id % 50
  UNION ALL SELECT w.start, w.page_no + 1, l.next_key FROM w JOIN l ON l.key = w.key WHERE w.page_no < 5 AND l.next_key IS NOT NULL)
SELECT start, page_no, key FROM w
""")
def next_page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty chains of pages, walked side by side, five pages each at most, as is usual."""
    from pyspark.sql.window import Window

    pages = table(spark, sf_dir, "pages")
    part = (F.col("page_id") % 50).alias("m")
    links = pages.select(F.col("page_id").alias("key"), F.lead("page_id").over(Window.partitionBy(part).orderBy("page_id")).alias("next_key"))
    return crawl.walk_pages(pages.groupBy(part).agg(F.min("page_id").alias("start")).select("start"), links)


def _dedup(mode: str, by: tuple[str, ...] = (), url: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records.deduplicate(table(spark, sf_dir, "documents"), mode, ["text", "lang"], ["doc_id"], by, url).select("doc_id")

    return run


query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang", "dedup_exact")(_dedup("exact_hash"))
query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, lang", "dedup_fields")(_dedup("fields", ("source", "lang")))
query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY source", "dedup_url")(_dedup("url", url="source"))
query("SELECT doc_id FROM documents", "dedup_none")(_dedup("none"))


@query("SELECT count(*) AS records, count(DISTINCT (text, lang)) AS kept, count(*) - count(DISTINCT (text, lang)) AS duplicates FROM documents")
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.duplicates(table(spark, sf_dir, "documents"), "exact_hash", ["text", "lang"])


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE (text, lang) NOT IN (SELECT (text, lang) FROM documents WHERE doc_id % 2 = 0) GROUP BY text, lang")
def dedup_against_earlier_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an earlier run kept (here of the even documents) go out first."""
    docs = table(spark, sf_dir, "documents")
    seen = records.dedup_keys(docs.where("doc_id % 2 = 0"), "exact_hash", ["text", "lang"])
    return records.deduplicate(docs, "exact_hash", ["text", "lang"], ["doc_id"], seen=seen).select("doc_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.struct("user_id", "event_type"))
    return records.ordered_distinct(e, "key", ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def keep_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest(table(spark, sf_dir, "events"), 3, ["ts", "event_id"], ["user_id"]).select("user_id", "event_id")


@query("SELECT source, doc_id FROM documents QUALIFY sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) <= 20000")
def running_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.within_bytes(table(spark, sf_dir, "documents"), 20000, "n_chars", ["doc_id"], ["source"]).select("source", "doc_id")


@query("""
SELECT CAST(c.c_custkey AS VARCHAR) AS customer_key, c_name AS customer_name, n_name AS customer_nation_name, c_mktsegment || ' | ' || n_name AS tags
FROM customer c JOIN nation ON n_nationkey = c_nationkey
""")
def csv_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("name")).alias("nation")).alias("customer"), F.array("c_mktsegment", "n_name").alias("tags"))
    return flat_rows(rows, ["tags", "missing"])


@query("SELECT event_id, CAST(event_id // 10 AS BIGINT) AS batch, event_type FROM events")
def batch_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches(table(spark, sf_dir, "events").select("event_id", "event_type"), 10, "event_id")
    return flatten(rows.select("batch", F.explode("items").alias("i"))).select("batch", F.col("i_event_id").alias("event_id"), F.col("i_event_type").alias("event_type"))


@query("SELECT count(*) AS items FROM events")
def unnest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnest(batches(table(spark, sf_dir, "events").select("event_id"), 10, "event_id")).agg(F.count("*").alias("items"))


@query("""
SELECT url, CAST(min(part) AS INT) AS part FROM (SELECT url, 0 AS part FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, 1 FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 2 FROM pages)
WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 7 = 0) GROUP BY url
""")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("place", F.col("page_id"))
    return crawl.work_list(p.where("page_id % 3 = 0"), p.where("page_id % 2 = 0"), p, p.where("page_id % 7 = 0")).select("url", F.col("part").cast("int").alias("part"))


@query("""
SELECT p_partkey, array_to_string(CASE WHEN p_size % 3 = 0 THEN [p_brand] WHEN p_size % 3 = 1 THEN [p_type, p_brand] ELSE [] END, ',') AS found FROM part
""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    a = F.when(F.col("p_size") % 3 == 0, F.array("p_brand")).otherwise(none)
    b = F.when(F.col("p_size") % 3 == 1, F.array("p_type", "p_brand")).otherwise(none)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(crawl.first_match(a, b), ",").alias("found"))


@query("""
SELECT l_orderkey, l_returnflag, CAST(l_linenumber AS INT) AS l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) = 1
""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order the flags of its lines, each at its first line."""
    lines = table(spark, sf_dir, "lineitem").withColumn("key", F.struct("l_orderkey", "l_returnflag"))
    return records.ordered_distinct(lines, "key", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("int").alias("l_linenumber"))
