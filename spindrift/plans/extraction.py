"""Queries that extract fields from pages and from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flatten
from ..operators.extract import extract
from ..operators.extract import preview as preview_of
from ..operators.records import record_count, validate
from ..spec import spec, take
from .base import query, table
from .run import run_spec, with_record_count

#: References that the pages have, as DuckDB undoes them; the ampersand's comes last.
_PLAIN = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '&middot;', '·'), '&amp;', '&')"


def plain(sql: str) -> str:
    return _PLAIN.format(sql)


_FLAG = spec(
    name="articles",
    fields=[
        {**take("title", "title"), "transformers": ["strip"]},
        {**take("heading"), "selectors": [".headline", "article h1"], "transformers": ["strip"]},
        {"name": "links", "is_list": True, "attribute": "href", "selector": "nav a"},
    ],
    validation={"required_fields": ["title"], "min_records_per_page": 1},
    dedup={"mode": "url"},
)


@query(f"""
SELECT page_id, url, trim({plain("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title,
       trim({plain("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS heading,
       CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INT) AS record_count
FROM pages WHERE len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) > 0
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1
""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings and links of all pages, validated, one record a URL."""
    out = run_spec(_FLAG, table(spark, sf_dir, "pages"), order="page_id")
    return with_record_count(out.records, _FLAG).select("page_id", "url", "title", "heading", F.col("record_count").cast("int").alias("record_count"))


@query(f"SELECT page_id, trim({plain("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec(fields=[{**take("title", "title"), "transformers": ["strip"]}])
    return extract(table(spark, sf_dir, "pages"), s, ("page_id",)).select("page_id", "title")


@query(f"""
SELECT page_id, CAST(i - 1 AS INT) AS pos, {plain("hrefs[i]")} AS href
FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i
      FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec(fields=[{"name": "links", "is_list": True, "attribute": "href", "selector": "a"}])
    return extract(table(spark, sf_dir, "pages"), s, ("page_id",)).select("page_id", F.posexplode("links").alias("pos", "href"))


@query(f"""
SELECT page_id, CAST(i - 1 AS INT) AS pos, {plain("regexp_extract(items[i], 'href=\"([^\"]*)\"', 1)")} AS href,
       {plain("regexp_extract(items[i], '>([^<]*)</a>', 1)")} AS label
FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>') AS items FROM pages))
""")
def html_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec(fields=[{**take("items", "nav ul > li"), "is_list": True, "children": [{**take("href", "a"), "attribute": "href"}, take("label", "a")]}])
    rows = extract(table(spark, sf_dir, "pages"), s, ("page_id",))
    return flatten(rows.select("page_id", F.posexplode("items").alias("pos", "item"))).withColumnsRenamed({"item_href": "href", "item_label": "label"})


@query("""
SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))), '|') AS names
FROM pages
""")
def html_regex_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over whole pages: no Python takes part."""
    s = spec(fields=[{"name": "names", "selector": {"type": "regex", "value": 'href="/([^"]*)"'}, "is_list": True}])
    return extract(table(spark, sf_dir, "pages"), s, ("page_id",)).select("page_id", F.array_join(F.array_sort("names"), "|").alias("names"))


@query(f"SELECT page_id, {plain("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS heading, 'en' AS nothing FROM pages")
def first_match_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec(fields=[{**take("heading"), "selectors": ["h1.missing", {"type": "xpath", "value": "//main/h1"}, {"type": "json", "value": "a.b"}, "article > h1", "title"]}])
    return extract(table(spark, sf_dir, "pages"), s, ("page_id",)).select("page_id", "heading", F.lit("en").alias("nothing"))


@query(f"""
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
       CAST(len(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: contains(x, 'e') AND NOT contains(x, 'r'))) AS INT) AS n_links,
       {plain("coalesce(list_extract(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1), -1), '')")} AS last_label
FROM pages
""")
def xpath_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda v: {"type": "xpath", "value": v}
    s = spec(
        fields=[
            {"name": "lang", "selector": x("/html/@lang")},
            {"name": "links", "selector": x("//nav//a[contains(@href,'e') and not(contains(@href,'r'))]"), "attribute": "href", "is_list": True},
            {"name": "last_label", "selector": x("//nav/ul/li[last()]/a/text()")},
        ]
    )
    rows = extract(table(spark, sf_dir, "pages"), s, ("page_id",))
    return rows.select("page_id", "lang", F.size("links").alias("n_links"), F.coalesce("last_label", F.lit("")).alias("last_label"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_float, json_extract_string(props, '$.none') AS missing FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain paths: variants in the JVM."""
    j = lambda v: {"type": "json", "value": v}
    s = spec(response_type="json", fields=[{"name": "k", "selector": j("k"), "type": "bigint"}, {"name": "k_float", "selector": j("$.k"), "transformers": ["to_float"]}, {"name": "missing", "selector": j("none")}])
    return extract(table(spark, sf_dir, "events"), s, ("event_id",), "props").select("event_id", "k", "k_float", "missing")


@query("SELECT o_orderkey, array_to_string(list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber, l_partkey), ',') AS lines, CAST(max(l_partkey) AS BIGINT) AS top_part FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def json_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards over lists of objects: bodies made of each order's lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.to_json(F.struct(F.struct("lines").alias("order"))).alias("body"))
    j = lambda v: {"type": "json", "value": v}
    s = spec(response_type="json", fields=[{"name": "numbers", "selector": j("$.order.lines[*].l_linenumber"), "is_list": True, "type": "bigint"}, {**take("parts"), "selectors": [j("missing[*].x"), j("$..l_partkey")], "is_list": True, "type": "bigint"}])
    return extract(rows, s, ("o_orderkey",), "body").select("o_orderkey", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("lines"), F.array_max("parts").alias("top_part"))


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS INT) AS record_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", name="record_count")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"), F.collect_set("l_returnflag").alias("flags"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", record_count(rows, ["o_orderkey", "lines", "flags"]).cast("int").alias("record_count"))


@query("SELECT page_id FROM pages WHERE len(regexp_extract_all(html, '<p>')) >= 12")
def validate_min_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spec(fields=[{**take("paragraphs", "p"), "is_list": True}])
    return validate(extract(table(spark, sf_dir, "pages"), s, ("page_id",)), ["paragraphs"], min_records=12).select("page_id")


@query("SELECT page_id, CASE WHEN html LIKE '%&copy;%</footer>%' THEN NULL ELSE 'footer is missing' END AS warning FROM pages")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft: pages that lack the field stay, with a warning."""
    s = spec(fields=[take("footer", "footer")])
    return validate(extract(table(spark, sf_dir, "pages"), s, ("page_id",)), ["footer"], ["footer"], hard=False).select("page_id", "warning")


@query("SELECT count(*) AS pages, CAST(sum(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(0 AS BIGINT) AS crashed FROM pages")
def failure_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the bodies is blank: they become failures, not exceptions."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 3 != 0, F.col("html")))
    rows = extract(pages, spec(fields=[take("title", "title")]), ("page_id",))
    return rows.agg(F.count("*").alias("pages"), F.count_if(F.col("error_category") == "parse_error").alias("empty"), F.count_if(F.col("error_category") == "internal_error").alias("crashed"))


@query()
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a spec finds on one page; the limit is the feature."""
    first = table(spark, sf_dir, "pages").orderBy("page_id").limit(1)
    return preview_of(extract(first, _FLAG), _FLAG)
