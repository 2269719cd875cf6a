import pytest
from pyspark.sql import functions as F

from spindrift.functions import jsonpath, network, text, transforms, urls
from spindrift.html import css, xpath
from spindrift.html.tree import Tree

CASES = [
    ("  hello  \n", ["strip"], "hello"),
    (None, ["strip"], None),
    (" $1,234.56 ", ["to_float"], 1234.56),
    ("invalid", ["to_float"], 0.0),
    ("€1.234,56", [("to_float", [".", ","])], 1234.56),
    ("-12.5", ["to_float"], -12.5),
    ("1e5", ["to_float"], 15.0),
    ("2024-01-01", ["to_float"], 0.0),
    ("Order #12345", ["to_int"], 12345),
    ("No digits", ["to_int"], 0),
    ("12 items, 34 left", ["to_int"], 12),
    ("-5", ["to_int"], 5),
    ("Your Order: 9999 ok", [("regex", ["Order: (\\d+)"])], "9999"),
    ("nothing", [("regex", ["Order: (\\d+)"])], None),
    ("nothing", [("regex", ["Order: (\\d+)"]), "to_float"], 0.0),
    ("  10k  ", ["strip", ("replace", ["k", "000"]), "to_int"], 10000),
]


@pytest.mark.parametrize(("value", "steps", "expected"), CASES)
def test_chain_on_a_value(value, steps, expected):
    assert transforms.apply_chain(value, transforms.normal(steps)) == expected


def test_chain_as_column_agrees(spark):
    one = spark.range(1)
    got = one.select(*[transforms.chain(F.lit(v).cast("string"), s).alias(f"c{i}") for i, (v, s, _) in enumerate(CASES)]).first()
    assert list(got) == [e for *_, e in CASES]


URLS = [
    ("HTTP://Shop.Example.ORG:80/p/../q", "http://shop.example.org/p/../q"),
    ("https://b.test:443/y?", "https://b.test/y"),
    ("http://b.test:8080/y#f", "http://b.test:8080/y"),
    ("https://me:pw@b.test/", None),
    ("b.test/path", None),
    ("https:///nothing", None),
    ("http://a.test:0/", None),
    ("http://a.test:not-a-port/", None),
    ("http://a.test:99999/", None),
    ("  https://A.test.  ", "https://a.test/"),
    ("http://[FE80::1]:81/x?q=1", "http://[fe80::1]:81/x?q=1"),
    (None, None),
    ("", None),
]


def test_canonical_urls(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "i int, u string").select("i", urls.canonicalize(F.col("u")).alias("c")).orderBy("i").collect()
    assert [r.c for r in rows] == [e for _, e in URLS]


def test_resolve_links(spark):
    base = "https://example.com/a/page"
    links = {"../other": "https://example.com/other", "/x": "https://example.com/x", "//b.test/y": "https://b.test/y", "z?q=1#f": "https://example.com/a/z?q=1", "HTTP://C.test": "http://c.test/", "mailto:a@b": None}
    df = spark.createDataFrame([(base, k) for k in links], "b string, l string")
    assert {r.l: r.u for r in df.select("l", urls.resolve(F.col("b"), F.col("l")).alias("u")).collect()} == links


def test_policy(spark):
    policy = urls.UrlPolicy(("*.example.com",), allow_external_urls=True)
    cases = {"http://a.example.com/": None, "http://deep.a.example.com/": None, "http://example.com/": "domain", "ftp://a.example.com/": "scheme", "x": "invalid", "http://127.9.8.7/": "private", "http://localhost/": "private", "http://[::1]/": "private", "http://[fc00::1]/": "private", "http://192.168.77.3/": "private", "http://169.254.169.254/": "private"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.why for r in df.select("u", policy.reject_reason(F.col("u")).alias("why")).collect()} == cases
    ports = urls.UrlPolicy(("example.com",), allow_external_urls=True)
    got = spark.range(1).select(*[ports.origin_allowed(F.lit(u), F.lit("https://p.test/")) for u in ("https://example.com:8080/", "https://example.com/", "https://p.test/x")]).first()
    assert list(got) == [False, True, True]


def test_next_url():
    assert urls.next_url("https://a.test/x?p=1", "tok", "after", True) == "https://a.test/x?p=1&after=tok"
    assert urls.next_url("https://a.test/x?after=old&e=", "0", "after", True) == "https://a.test/x?e=&after=0"
    assert urls.next_url("https://a.test/x/", "../y") == "https://a.test/y"
    assert urls.next_url("https://a.test/x/", "") is None


def test_redaction(spark):
    line = "Authorization: Bearer abc, Cookie=x; ?token=1&api_key=2 https://u:p@h.test/"
    out = spark.range(1).select(text.redact_text(F.lit(line)).alias("x")).first().x
    assert out == text.redact_string(line)
    assert "abc" not in out and "u:p" not in out and "token=1" not in out
    config = {"name": "n", "auth": {"client_secret": "s"}, "headers": {"X": "y"}, "list": [{"password": "p"}, "https://u:p@h"]}
    assert text.redact_config(config) == {"name": "n", "auth": {"client_secret": text.MARK}, "headers": {"X": text.MARK}, "list": [{"password": text.MARK}, f"https://{text.MARK}@h"]}


def test_waits(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    got = spark.range(1).select(*[network.retry_after(F.lit(v), now) for v in ("999999", "-1", "soon", "Thu, 01 Jan 2026 00:00:10 GMT", None)]).first()
    assert list(got) == [300.0, 0.0, None, 10.0, None]


def test_jsonpath():
    data = {"items": [{"v": 1}, {"v": [2, 3]}], "a b": {"v": 9}}
    assert jsonpath.find(data, "$.items[*].v") == [1, [2, 3]]
    assert jsonpath.find(data, "$..v") == [1, [2, 3], 9]
    assert jsonpath.find(data, "items[-1].v[0:1]") == [2]
    assert jsonpath.find(data, "$['a b'].v") == [9]
    assert jsonpath.find(data, "items[5].v") == []
    with pytest.raises(jsonpath.JsonPathError):
        jsonpath.parse("items[")


MESSY = "<div class='a x'><ul><li>one<li id=two>two</ul><p>p1<p>p2 <b>bold<p>p3<script>var t='</p>';</script><a href='/x?a=1&amp;b=2'>L</a><br><!-- <p>no</p> -->&copy;"


def test_messy_html():
    root = Tree(MESSY).root
    assert [x.text() for x in css.select(root, "li")] == ["one", "two"]
    assert len(css.select(root, "p")) == 3
    assert css.select(root, "a")[0].attrs["href"] == "/x?a=1&b=2"
    assert "©" in root.text()
    assert Tree("").root.text() == ""


def test_css():
    root = Tree("<div id=d class='a b'><h1>t</h1><p class=x>1</p><p>2</p><p lang=en-GB>3</p></div>").root
    texts = lambda s: [n.text() for n in css.select(root, s)]
    assert texts("div.a.b > p:last-child") == ["3"]
    assert texts("h1 + p") == ["1"]
    assert texts("h1 ~ p:not(.x)") == ["2", "3"]
    assert texts("p:nth-child(2n)") == ["1", "3"]
    assert texts("p[lang|='en'], h1") == ["t", "3"]
    assert texts("#d p:nth-of-type(2)") == ["2"]
    for bad in ("div[", "", "p:nope", "> "):
        with pytest.raises(css.SelectorError):
            css.parse(bad)


def test_xpath():
    root = Tree("<div><span class='price big'>1</span><span class='price'>2</span><a href='/u'>x</a></div>").root
    assert xpath.select(root, "//span[contains(@class,'price') and not(contains(@class,'big'))]")[0].text() == "2"
    assert xpath.select(root, "//a/@href") == ["/u"]
    assert xpath.select(root, "//span[2]/text()") == ["2"]
    assert xpath.select(root, "count(//span)") == ["2"]
    assert [n.tag for n in xpath.select(root, "//a | //span[@class='price']")] == ["span", "a"]
    with pytest.raises(xpath.XPathError):
        xpath.parse("//div[")


def test_references_end_with_a_semicolon():
    tree = Tree("<title>a&amp;b &lt;&#39;&#x27;&copy; &amp;lt; &nosuch; &notit; c&amp;&amp</title><a href='/x?a=1&amp;b=2&copy=3'>&amp</a>")
    title, link = tree.root.elements()
    assert title.text() == "a&b <''© &lt; &nosuch; &notit; c&&amp"
    assert link.attrs["href"] == "/x?a=1&b=2&copy=3" and link.text() == "&amp"
