import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift import cli
from spindrift.functions import urls
from spindrift.operators import crawl, metrics, nested, records
from spindrift.operators.extract import extract
from spindrift.plans.run import run_spec
from spindrift.sinks import files
from spindrift.sources.cookies import in_scope
from spindrift.sources.pages import read_batches
from spindrift.sources.robots import filter_by_robots, rules_of
from spindrift.sources.sitemap import discover, parse_sitemaps
from spindrift.spec import parse_spec, spec, take
from spindrift.streaming.stateful import CircuitBreaker, TokenBucket, keep_up, replay

PRODUCT = "".join(f"<div class=product><h1>{n}</h1><b class=price>${p}</b>{more}</div>" for n, p, more in (("Gaming Laptop", "999.99", "<ol><li>a<li>b</ol>"), ("Mouse", 5, "")))


def pages(spark, *bodies):
    return spark.createDataFrame([(f"http://s.test/{i}", b) for i, b in enumerate(bodies)], "url string, html string")


def test_extract_html(spark):
    s = spec(
        fields=[
            take("title", "h1"),
            {**take("price"), "selectors": [".none", {"type": "xpath", "value": "//b[@class='price']"}], "transformers": ["to_float"]},
            {**take("items", "div.product"), "is_list": True, "children": [take("name", "h1"), {**take("specs", "li"), "is_list": True}, {"name": "sku", "selector": {"type": "regex", "value": "La(p)(top)"}}]},
            take("missing", ".nonexistent"),
            {**take("href", "h1"), "attribute": " HREF "},
        ]
    )
    r = extract(pages(spark, PRODUCT), s).first()
    assert (r.title, r.price, r.missing, r.href, r.error_category) == ("Gaming Laptop", 999.99, None, "", None)
    assert [(i.name, i.specs, i.sku) for i in r["items"]] == [("Gaming Laptop", ["a", "b"], "ptop"), ("Mouse", [], None)]


def test_extract_json(spark):
    j = lambda v: {"type": "json", "value": v}
    s = spec(response_type="json", fields=[{**take("t"), "selectors": [j("v1.title"), j("v2.name")]}, {"name": "vs", "selector": j("$.items[*].v"), "is_list": True, "type": "bigint"}, {"name": "after", "selector": j("data.after")}, {"name": "big", "selector": j("big"), "type": "bigint"}])
    rows = {r.url[-1]: r for r in extract(pages(spark, '{"v2":{"name":"World"},"items":[{"v":1}],"data":{"after":null},"big":99999999999999999999}', "{not-json", None, ""), s).collect()}
    assert (rows["0"].t, rows["0"].vs, rows["0"].after, rows["0"].big) == ("World", [1], None, None)
    assert [rows[k].error_category for k in "123"] == ["parse_error"] * 3


def test_empty_table_and_clashing_names(spark):
    s = spec(fields=[take("title", "title")])
    assert extract(pages(spark, "x").limit(0), s).count() == 0
    odd = pages(spark, "<title>t</title>").withColumn("error_category", F.lit(1)).withColumn("__body", F.lit(2)).withColumn("a.b", F.lit(3))
    assert extract(odd, s).first().title == "t"


def test_follow(spark):
    s = spec(fields=[{**take("kids", "a"), "is_list": True, "attribute": "href", "follow_url": True, "nested_fields": [take("t", "h1"), {"name": "more", "is_list": True, "attribute": "href", "selector": "a", "follow_url": True, "nested_fields": [take("t", "h1")]}]}], fail_parent_on_nested_error=False)
    p = spark.createDataFrame([("http://s.test/a", "<h1>A</h1><a href=b>b</a><a href=/c>c</a><a href=/gone>g</a>"), ("http://s.test/b", "<h1>B</h1><a href=a>back</a><a href=c>c</a>"), ("http://s.test/c", "<h1>C</h1>")], "url string, html string")
    twice = p.where("url like '%/a'").union(p.where("url like '%/a'"))
    got = nested.follow(extract(twice, s), nested.page_index(p), s).collect()
    assert len(got) == 2
    kids = got[0].kids
    assert [(k.t, [m.t for m in k.more]) for k in kids] == [("B", ["C"]), ("C", [])]  # not back to A, which is an ancestor
    assert kids[0]._source_url == "http://s.test/b" and kids[0]._parent_url == "http://s.test/a"
    from dataclasses import replace

    strict = nested.follow(extract(p.where("url like '%/a'"), s), nested.page_index(p), replace(s, fail_parent_on_nested_error=True)).first()
    assert strict.error_category == "nested_error"
    shallow = nested.follow(extract(p.where("url like '%/a'"), s), nested.page_index(p), replace(s, max_depth=0)).first()
    assert shallow.kids == []


def test_dedup_and_validation(spark):
    df = spark.createDataFrame([(1, "a", 1, "u"), (2, "a", 1, "u"), (3, "a", 2, None), (4, "a", 2, None)], "seq int, name string, id int, url string")
    keep = lambda mode, **k: sorted(r.seq for r in records.deduplicate(df, mode, ["name", "id"], ["seq"], **k).collect())
    assert keep("none") == [1, 2, 3, 4] and keep("exact_hash") == [1, 3] and keep("fields", by=["name"]) == [1] and keep("url", url="url") == [1, 3]
    lists = spark.createDataFrame([([1, 2], [3, 4, 5])], "titles array<int>, prices array<int>")
    assert lists.select(records.record_count(lists, lists.columns), records.record_count(lists, lists.columns, "titles")).first()[:] == (3, 2)
    empty = spark.createDataFrame([("",), (None,)], "name string")
    assert records.validate(empty, ["name"], ["name"]).count() == 1


def test_walks(spark):
    heads = spark.createDataFrame([(1,)], "start long")
    links = spark.createDataFrame([(1, 2), (2, 2)], "key long, next_key long")
    assert [r.key for r in crawl.walk_pages(heads, links, 4).orderBy("page_no").collect()] == [1, 2, 2, 2]
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert sorted(map(tuple, (r.path for r in crawl.walk_links(heads, edges, 5).collect()))) == [(1,), (1, 2), (1, 2, 3)]


def test_percentiles(spark):
    ms = spark.range(1, 101).select(F.col("id").cast("double").alias("elapsed_ms"), F.lit("o").alias("origin"))
    r = metrics.percentiles(ms, by=None).first()
    assert r.p50 == 50.0 and 100 <= r.p95 <= 128
    assert metrics.percentiles(ms.limit(0)).count() == 0
    assert metrics.histogram(spark.createDataFrame([(float(2**17),)], "elapsed_ms double")).first().bucket == 17


def test_sitemaps(spark):
    locs = lambda outer, inner, *paths: f"<{outer} xmlns='urn:any'>" + "".join(f"<{inner}><loc>{p}</loc></{inner}>" for p in paths) + f"</{outer}>"
    rows = {"i": locs("sitemapindex", "sitemap", "/one.xml"), "one": locs("urlset", "url", "/a", "/b"), "bad": "<urlset>"}
    docs = spark.createDataFrame([(f"https://e.test/{k}.xml", v) for k, v in rows.items()], "url string, body string")
    assert discover(["https://e.test/i.xml"], docs) == ["https://e.test/a", "https://e.test/b"]
    assert discover(["https://e.test/i.xml"], docs, max_urls=1) == ["https://e.test/a"]
    assert discover(["https://e.test/i.xml"], docs, max_bytes=10) == []
    big = docs.union(spark.createDataFrame([("https://e.test/big.xml", locs("urlset", "url", *(f"/{i}" for i in range(99))))], "url string, body string"))
    assert discover(["https://e.test/big.xml", "https://e.test/i.xml"], big, max_bytes=400) == ["https://e.test/a", "https://e.test/b"]
    assert parse_sitemaps(docs).where("error is not null").count() == 1


def test_robots(spark):
    assert rules_of("User-agent: *\nDisallow: /p\nDisallow:") == [(False, "/p"), (True, "")]
    p = spark.createDataFrame([("http://a.test/private/x",), ("http://a.test/ok",), ("http://b.test/",)], "url string")
    robots = spark.createDataFrame([("http://a.test", 200, "User-agent: *\nDisallow: /private/"), ("http://b.test", 404, "")], "origin string, status int, body string")
    assert sorted(r.url for r in filter_by_robots(p, robots).collect()) == ["http://a.test/ok", "http://b.test/"]
    assert [r.url for r in filter_by_robots(p, robots, failure_policy="deny").collect()] == ["http://a.test/ok"]


def test_cookies(spark):
    c = spark.createDataFrame([("session", "ok", "https://e.test/x", None), ("other", "no", "https://o.test/", None), ("p", "1", None, ".e.test")], "name string, value string, url string, domain string")
    assert sorted(r.name for r in in_scope(c, "https://e.test/y").collect()) == ["p", "session"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["x", None], (2, "é"))], "id int, gone string, tags array<string>, s struct<a:int,b:string>")
    files.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    line = json.loads(next((tmp_path / "j").glob("part-*.json")).read_text())
    assert line["gone"] is None and line["s"]["b"] == "é"
    assert files.write_json_array(df, str(tmp_path / "a.json")) == 1 and json.loads((tmp_path / "a.json").read_text())[0]["id"] == 1
    flat = files.flat_rows(df, ["s_b", "nope"])
    assert flat.columns == ["s_b", "gone", "id", "s_a", "tags"] and flat.first().tags == "x | None"
    (tmp_path / "bad.jsonl").write_text('{"items":[{"id":1}]}\nnot-json\n')
    with pytest.raises(Exception):
        read_batches(spark, str(tmp_path / "bad.jsonl"), "struct<id:int>").collect()
    files.write_manifest(tmp_path / "m.json", {"name": "n", "headers": {"X": "secret"}})
    assert "secret" not in (tmp_path / "m.json").read_text()
    with pytest.raises(ValueError):
        files.write_manifest(tmp_path / "m.json", {"name": "other"}, resume=True)


def test_token_bucket_and_breaker(spark, tmp_path):
    rows = [("k", i, float(t), ok) for i, (t, ok) in enumerate([(0, False), (0, False), (1, True), (61, True), (62, True)])]
    df = spark.createDataFrame(rows, "k string, seq long, ts double, ok boolean")
    waits = [r.wait for r in replay(df, TokenBucket(1.0, 1), "k", "ts", "seq").orderBy("seq").collect()]
    assert waits == [0.0, 1.0, 1.0, 0.0, 0.0]
    states = [(r.admitted, r.state) for r in replay(df, CircuitBreaker(2, 60), "k", "ts", "seq", "ok").orderBy("seq").collect()]
    assert states == [(True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = keep_up(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), CircuitBreaker(2, 60), "k", "ts", "seq", "ok")
    q = stream.writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.admitted, r.state) for r in spark.table("breaker").orderBy("seq").collect()] == states


def test_spec_collects_all_issues():
    out, issues = parse_spec({"name": "x", "mode": "list", "odd": 1, "max_depth": 101, "fields": [{"name": "a", "selector": {"type": "xpath", "value": "//["}}], "dedup": {"mode": "fields"}})
    assert out is None
    assert {i.path for i in issues} == {"config", "max_depth", "fields[0].selectors[0]", "start_urls", "dedup.fields"}
    assert parse_spec([])[0] is None


def test_run_and_cli(spark, tmp_path, capsys):
    s = {"name": "r", "start_urls": [f"http://s.test/{i}" for i in range(4)], "mode": "list", "fields": [take("title", "title")], "validation": {"required_fields": ["title"]}}
    p = pages(spark, "<title>a</title>", "<p>no title</p>", "", "<title>a</title>")
    outcome = run_spec(parse_spec(s)[0], p)
    assert outcome.records.count() == 1 and {r.category for r in outcome.failures.collect()} == {"validation_error", "parse_error"}
    (tmp_path / "s.json").write_text(json.dumps(s))
    p.write.parquet(str(tmp_path / "p"))
    assert cli.main(["validate", str(tmp_path / "s.json")]) == 0
    assert cli.main(["validate", str(tmp_path / "none.json")]) == 1
    assert cli.main(["run", str(tmp_path / "s.json"), "--pages", str(tmp_path / "p"), "--output-dir", str(tmp_path / "o"), "--run-id", "one"]) == 4
    assert json.loads((tmp_path / "o/one/manifest.json").read_text())["counts"] == {"pages": 1, "records": 1, "failed": 2}
    assert cli.main(["preview", str(tmp_path / "s.json"), "--pages", str(tmp_path / "p"), "--format", "json"]) == 0


@pytest.mark.parametrize("before, after", [("/part/", ""), ("../order/", "#x")])
def test_plain_links_are_resolved_and_checked_quickly(spark, before, after):
    n = 100_000
    at, to = F.lit("http://shop.test/customer/1"), F.concat(F.lit(before), F.col("id").cast("string"), F.lit(after))
    start = time.perf_counter()
    links = spark.range(0, n, numPartitions=1).select("id", urls.resolve(at, to).alias("to")).withColumn("why", urls.UrlPolicy().reject_reason(F.col("to"), at))
    found = links.agg(F.count_if(F.col("to").endswith(F.concat(F.lit("/"), F.col("id").cast("string"))) & F.col("why").isNull())).first()[0]
    assert found == n and time.perf_counter() - start < 20


def test_odd_urls_are_taken_apart(spark):
    kept = ["http://a.test/", "https://a.test/x?q", "http://a.test:81/"]
    odd = {"http://a.test/x#f": "http://a.test/x", " HTTP://A.test.:80?q#f\n": "http://a.test/?q", "http://a.test/x?": "http://a.test/x", "http://a.test/x \n": "http://a.test/x", "http://u@a.test/": None, "http://a.test/#f\ng": None, "/x": None}
    rows = spark.createDataFrame([(u, u) for u in kept] + list(odd.items()), "u string, c string")
    assert rows.where(~urls.canonicalize(F.col("u")).eqNullSafe(F.col("c"))).count() == 0
    p = urls.UrlPolicy()
    why = lambda u, parent="http://a.test/": spark.range(1).select(p.reject_reason(F.lit(u), F.lit(parent))).first()[0]
    assert [why(u) for u in ("http://a.test/x", "http://b.test/", "http://localhost/", "http://10.0.0.1/", "ftp://a.test/", "x")] == [None, "origin", "private", "private", "scheme", "invalid"]
    assert why("http://a.test/x", "HTTP://A.test:80/y") is None and why("https://a.test/", "http://a.test/") == "origin"


def test_sitemaps_are_parsed_in_bounded_memory():
    """The worker hands on the rows of many documents bit by bit, not once a batch."""
    from spindrift.sources import sitemap

    body = "<urlset>" + "".join(f"<url><loc>/{i}</loc></url>" for i in range(500)) + "</urlset>"
    batch = pa.RecordBatch.from_pydict({"url": [f"https://e.test/{i}" for i in range(100)], "body": [body] * 99 + [None]})
    sizes = [b.num_rows for b in sitemap.parsed([batch], 1 << 20)]
    assert sum(sizes) == 99 * 500 + 1 and max(sizes) <= 4_000
