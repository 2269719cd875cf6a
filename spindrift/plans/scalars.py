"""Queries over scalar functions: transformers, URLs, policies, redaction, statuses and waits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network, text, transforms, urls
from ..sources.robots import filter_by_robots
from ..sources.sitemap import parse_sitemaps
from .base import query, table

_DIGITS = "coalesce(try_cast(regexp_extract(text, '[0-9]+') AS BIGINT), 0)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace('  ' || text || chr(10) || chr(9), '^\\s+', ''), '\\s+$', '')) AS stripped FROM documents")
def fn_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("text"), F.lit("\n\t"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(transforms.strip(padded)).alias("stripped"))


@query("SELECT doc_id, coalesce(try_cast(regexp_replace(source || ':' || CAST(n_chars AS VARCHAR) || '.25 EUR', '[^0-9.\\-]', '', 'g') AS DOUBLE), 0) AS price, coalesce(try_cast(regexp_replace(text, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0) AS number FROM documents")
def fn_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = F.concat("source", F.lit(":"), F.col("n_chars").cast("string"), F.lit(".25 EUR"))
    return _documents(spark, sf_dir).select("doc_id", transforms.to_float(priced).alias("price"), transforms.to_float(F.col("text")).alias("number"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(try_cast(replace(replace(replace(printf('%.2f', l_extendedprice), '.', ','), ' ', ''), ',', '.') AS DOUBLE), 0) AS price FROM lineitem")
def fn_to_float_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """European numbers: points for thousands, a comma for decimals."""
    shown = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", transforms.to_float(F.concat(F.lit("€"), shown), ".", ",").alias("price"))


@query(f"SELECT doc_id, {_DIGITS} AS number FROM documents")
def fn_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", transforms.to_int(F.col("text")).alias("number"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]+[a-z]') THEN regexp_extract(text, '([0-9]+)[a-z]', 1) END AS found FROM documents")
def fn_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", transforms.regex(F.col("text"), "([0-9]+)[a-z]").alias("found"))


@query("SELECT doc_id, md5(replace(text, 'the', 'THE')) AS replaced FROM documents")
def fn_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(transforms.replace(F.col("text"), "the", "THE")).alias("replaced"))


@query("SELECT doc_id, coalesce(try_cast(regexp_extract(replace(text, 'k', '000'), '[0-9]+') AS BIGINT), 0) AS number FROM documents")
def fn_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ["strip", ("replace", ["k", "000"]), "to_int"]
    return _documents(spark, sf_dir).select("doc_id", transforms.chain(F.col("text"), steps).alias("number"))


_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"


@query(f"""
SELECT page_id, regexp_replace(url, '#.*$', '') AS canonical, regexp_extract(url, '^[^/]+//[^/?#]+') AS origin, {_HOST} AS host,
       regexp_replace(url, '#.*$', '') AS from_shouted, CAST(NULL AS VARCHAR) AS from_user, regexp_extract(url, '^[^/]+//[^/?#]+') || ':8443/' AS with_port
FROM pages
""")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as they are, shouted with a default port, with user info, and with a port."""
    u = F.col("url")
    scheme, rest = F.regexp_extract(u, "^([a-z]+)://", 1), F.regexp_extract(u, "^[a-z]+://[^/?#]+(.*)$", 1)
    host = F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1)
    default = F.when(scheme == "http", ":80").otherwise(":443")
    shouted = F.concat(F.lit(" "), F.upper(scheme), F.lit("://"), F.upper(host), F.lit("."), default, rest)
    user = F.concat(scheme, F.lit("://me:pw@"), host, rest)
    port = F.concat(scheme, F.lit("://"), host, F.lit(":8443"))
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.canonicalize(u).alias("canonical"), urls.origin(u).alias("origin"), urls.domain_key(u).alias("host"),
        urls.canonicalize(shouted).alias("from_shouted"), urls.crawl_key(F.nullif(urls.canonicalize(user), F.lit(""))).alias("from_user"), urls.canonicalize(port).alias("with_port"),
    )


@query(f"""
SELECT page_id, pos, CASE WHEN pos % 3 = 0 THEN o || '/x' || pos WHEN pos % 3 = 1 THEN 'https://other.example.org/' || pos ELSE o || '/up/' || pos END AS target
FROM (SELECT page_id, regexp_extract(url, '^[^/]+//[^/?#]+') AS o, unnest([0, 1, 2]) AS pos FROM pages)
""")
def resolve_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from the root, absolute ones, and relative ones with dot segments."""
    base = F.concat(urls.origin(F.col("url")), F.lit("/a/b/page"))
    rows = table(spark, sf_dir, "pages").select("page_id", base.alias("base"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("pos"))
    p = F.col("pos").cast("string")
    link = F.when(F.col("pos") == 0, F.concat(F.lit("/x"), p, F.lit("#f"))).when(F.col("pos") == 1, F.concat(F.lit("HTTPS://Other.Example.ORG:443/"), p)).otherwise(F.concat(F.lit("../../up/./"), p))
    return rows.withColumn("link", link).select("page_id", "pos", urls.resolve(F.col("base"), F.col("link")).alias("target"))


@query(f"""
SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'private' WHEN page_id % 5 = 2 THEN 'scheme' WHEN page_id % 5 = 3 THEN 'invalid'
       WHEN NOT ({_HOST} LIKE '%.example.com' OR {_HOST} = 'example.net' OR {_HOST} LIKE '%.example.net') THEN 'domain' END AS reason
FROM pages
""")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = urls.UrlPolicy(("*.example.com", "example.net"), allow_subdomains=True)
    at = F.col("page_id") % 5
    private = F.concat(F.lit("http://10."), (F.col("page_id") % 256).cast("string"), F.lit(".0.9/x"))
    target = F.when(at == 1, private).when(at == 2, "ftp://a.example.com/x").when(at == 3, F.lit("/only/a/path")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", policy.reject_reason(target).alias("reason"))


@query(f"SELECT page_id, {_HOST} LIKE '%.example.org' OR page_id % 2 = 0 AS allowed FROM pages")
def origin_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same origin, or external of an allowed domain."""
    policy = urls.UrlPolicy(("*.example.org",), allow_external_urls=True)
    u = F.col("url")
    parent = F.when(F.col("page_id") % 2 == 0, F.concat(urls.origin(u), F.lit("/parent"))).otherwise("https://elsewhere.test/")
    return table(spark, sf_dir, "pages").select("page_id", policy.origin_allowed(u, parent).alias("allowed"))


@query("""
SELECT c_custkey, addr, a = 10 OR a = 127 OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) OR a >= 224 OR a = 0 AS private
FROM (SELECT c_custkey, [10, 127, 192, 172, 169, 224, 8, 0][1 + c_custkey % 8] AS a, [168, 16, 254, 31, 32, 1][1 + c_custkey % 6] AS b,
             CAST([10, 127, 192, 172, 169, 224, 8, 0][1 + c_custkey % 8] AS VARCHAR) || '.' || [168, 16, 254, 31, 32, 1][1 + c_custkey % 6] || '.7.' || c_custkey % 256 AS addr
      FROM customer)
""")
def flt_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs)).cast("int")).cast("string")
    addr = F.concat_ws(".", pick([10, 127, 192, 172, 169, 224, 8, 0]), pick([168, 16, 254, 31, 32, 1]), F.lit("7"), (F.col("c_custkey") % 256).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", addr.alias("addr")).withColumn("private", urls.is_private_host(F.col("addr")))


@query("""
SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^[^/]+//([^/?#]+)', 1) AS h, regexp_replace(regexp_replace(url, '^[^/]+//[^/?#]+', ''), '#.*$', '') AS path FROM pages)
WHERE CASE WHEN h LIKE '%.org' THEN false WHEN starts_with(path, '/fr/2') THEN true WHEN starts_with(path, '/fr') THEN false ELSE true END
""")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule file for each origin; those of .org failed, and a failure denies."""
    pages = table(spark, sf_dir, "pages")
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *  # all\nAllow: /fr/2\nDisallow: /fr\nDisallow:\n"
    o = urls.origin(F.col("url"))
    robots = pages.select(o.alias("origin")).distinct().select("origin", F.when(F.col("origin").endswith(".org"), 404).otherwise(200).alias("status"), F.lit(body).alias("body"))
    return filter_by_robots(pages, robots, failure_policy="deny").select("page_id")


@query("""
SELECT 'https://m.test/' || (page_id % 7) || '.xml' AS url, CAST(row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1 AS INT) AS place,
       regexp_replace(url, '#.*$', '') AS loc FROM pages
""")
def sitemap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    esc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    part = F.array_sort(F.collect_list(F.struct("page_id", esc.alias("u"))))
    docs = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 7).alias("m")).agg(part.alias("us"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="urn:any">'), F.array_join(F.transform("us", lambda x: F.concat(F.lit("<url><loc> "), x["u"], F.lit("</loc></url>"))), ""), F.lit("</urlset>"))
    docs = docs.select(F.concat(F.lit("https://m.test/"), F.col("m").cast("string"), F.lit(".xml")).alias("url"), xml.alias("body"))
    return parse_sitemaps(docs).select("url", "place", "loc")


@query("""
SELECT doc_id, 'get https://[REDACTED]@h.test/?a=1&token=[REDACTED]&b=2 Authorization: Bearer [REDACTED] password=[REDACTED], end ' || doc_id AS line FROM documents
""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.md5("text")
    line = F.concat(F.lit("get https://u:"), secret, F.lit("@h.test/?a=1&token="), secret, F.lit("&b=2 Authorization: Bearer "), secret, F.lit(" password="), secret, F.lit(", end "), F.col("doc_id").cast("string"))
    return _documents(spark, sf_dir).select("doc_id", text.redact_text(line).alias("line"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Accept=a;X-Api-Key=k;X_Session_Token=t' ELSE 'Accept=a' END AS headers FROM customer
""")
def flt_sensitive_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.create_map(*[F.lit(x) for kv in (("Accept", "a"), ("X-Api-Key", "k"), ("X_Session_Token", "t")) for x in kv])
    own = text.headers_for(headers, F.col("c_custkey") % 2 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.replace(text.cookie_header(own), F.lit("; "), F.lit(";")).alias("headers"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(value, 300) WHEN 1 THEN 0 WHEN 2 THEN 90 END AS seconds,
       least(1.0 * pow(2, event_id % 9 - CASE WHEN event_id % 9 > 0 THEN 1 ELSE 0 END), 30.0) AS wait FROM events
""")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry-After as a number, a negative number, a date or junk; and the doubling wait."""
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    at = F.col("event_id") % 4
    value = F.when(at == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(at == 1, "-5").when(at == 2, "Thu, 01 Jan 2026 00:01:30 GMT").otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", network.retry_after(value, now).alias("seconds"), network.backoff(F.col("event_id") % 9).alias("wait"))


@query("""
SELECT event_id, category, CASE WHEN category IN ('timeout', 'network_error', 'rate_limit') THEN true WHEN category = 'http_error' THEN status IN (408, 425, 429, 500, 502, 503, 504) ELSE false END AS retryable
FROM (SELECT event_id, status, CASE kind WHEN 'timeout' THEN 'timeout' WHEN 'dns' THEN 'network_error' WHEN 'odd' THEN 'internal_error'
        ELSE CASE WHEN status BETWEEN 200 AND 299 THEN NULL WHEN status = 429 THEN 'rate_limit' ELSE 'http_error' END END AS category
      FROM (SELECT event_id, [200, 404, 429, 503, 204][1 + event_id % 5] AS status, ['timeout', 'dns', 'odd', NULL, NULL, NULL, NULL][1 + event_id % 7] AS kind FROM events))
""")
def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs)).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick([200, 404, 429, 503, 204]).alias("status"), pick(["timeout", "dns", "odd", None, None, None, None]).alias("kind"))
    rows = rows.withColumn("category", network.classify_error(F.col("status"), F.col("kind")))
    return rows.select("event_id", "category", F.coalesce(network.is_retryable(F.col("category"), F.col("status")), F.lit(False)).alias("retryable"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'run' ELSE regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug, sha256(c_name) AS digest FROM customer")
def slug_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, "  ?? ").otherwise(F.concat("c_name", F.lit(" / "), "c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug(name).alias("slug"), F.sha2("c_name", 256).alias("digest"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '.json' AS api FROM pages")
def json_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.json_suffix(F.col("url")).alias("api"))
