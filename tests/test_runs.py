"""Runs by a spec: which pages they take, and what a resumed one does."""

import csv
import json

import pytest

from spindrift import cli
from spindrift.operators.crawl import latest_state
from spindrift.plans.source import next_token, run_source
from spindrift.spec import Pagination, Selector, parse_spec, take

LIST = {"name": "l", "mode": "list", "start_urls": ["http://s.test/b", "http://s.test/a", "http://s.test/gone"], "fields": [take("title", "title")], "validation": {"required_fields": ["title"]}}
CHAIN = {"name": "c", "base_url": "http://s.test/1", "fields": [take("title", "h1")], "validation": {"required_fields": ["title"]}, "pagination": {"selector": "a.next", "max_pages": 5}}


def table(spark, **bodies):
    return spark.createDataFrame([(f"http://s.test/{k.strip('_')}", v) for k, v in bodies.items()], "url string, html string")


def test_list_takes_its_urls_only(spark):
    pages = table(spark, a="<title>A</title>", b="<title>B</title>", other="<title>O</title>")
    out = run_source(parse_spec(LIST)[0], pages)
    assert sorted(r.title for r in out.records.collect()) == ["A", "B"]
    assert [(r.url, r.category) for r in out.failures.collect()] == [("http://s.test/gone", "network_error")]


def chain_pages(spark, bad=None):
    body = lambda i: f"<a class=next href='/{i + 1}'>n</a>" + ("" if i == bad else f"<h1>{i}</h1>")
    return spark.createDataFrame([(f"http://s.test/{i}", body(i)) for i in range(1, 9)], "url string, html string")


@pytest.mark.parametrize("bad, limit, kept, failed", [(None, None, "12345", []), (None, 2, "12", []), (3, None, "12", ["http://s.test/3"]), (1, None, "", ["http://s.test/1"])])
def test_chain_ends_at_its_bound_or_first_failure(spark, bad, limit, kept, failed):
    out = run_source(parse_spec(CHAIN)[0], chain_pages(spark, bad), limit=limit)
    assert "".join(sorted(r.title for r in out.records.collect())) == kept
    assert [r.url for r in out.failures.collect()] == failed


def test_chain_goes_on_where_it_broke_off(spark):
    s = parse_spec(CHAIN)[0]
    first = run_source(s, chain_pages(spark, 3))
    log = first.log.selectExpr("*", "if(status = 'in_progress', 0, 1) seq", "'' ts")
    second = run_source(s, chain_pages(spark), state=latest_state(log), seen=first.keys)
    assert sorted(r.title for r in second.records.collect()) == ["3", "4", "5", "6", "7"]
    done = second.log.selectExpr("*", "if(status = 'in_progress', 2, 3) seq", "'' ts")
    assert run_source(s, chain_pages(spark), state=latest_state(log.union(done))).records.count() == 0


def test_next_tokens():
    json_page = Pagination(Selector("css", "data.after"))
    assert next_token('{"data": {"after": "t"}}', json_page, True) == "t"
    assert [next_token(b, json_page, True) for b in ('{"data": {"after": null}}', "{bad", None)] == [None] * 3
    html = Pagination(Selector("xpath", "//a[@rel='next']"))
    assert next_token("<a rel=next href=x>", html, False) == "x" and next_token("<p>", html, False) is None


def test_robots_without_rules_follow_the_failure_policy(spark):
    pages = table(spark, a="<title>A</title>", b="<title>B</title>")
    for policy, n in (("allow", 2), ("deny", 0)):
        s = parse_spec({**LIST, "start_urls": ["http://s.test/a", "http://s.test/b"], "respect_robots_txt": True, "robots_failure_policy": policy})[0]
        assert run_source(s, pages).records.count() == n


def rows_of(folder):
    return [r for p in sorted(folder.glob("part-*.csv")) for r in csv.DictReader(p.open())]


def test_resumed_cli_runs(spark, tmp_path, capsys):
    """Two limited runs and a third over what failed; the same record isn't kept twice, and CSV and counts are the whole run's."""
    spec = {**LIST, "start_urls": [f"http://s.test/{k}" for k in "abcd"]}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    table(spark, a="<title>A</title>", b="<title>B</title>", c="<title>A</title>").write.parquet(str(tmp_path / "p"))
    table(spark, a="<title>A</title>", b="<title>B</title>", c="<title>A</title>", d="<title>D</title>").write.parquet(str(tmp_path / "q"))
    run = lambda pages, *more: cli.main(["run", str(tmp_path / "s.json"), "--pages", str(tmp_path / pages), "--output-dir", str(tmp_path / "o"), "--run-id", "r", *more])
    counts = lambda: json.loads((tmp_path / "o/r/manifest.json").read_text())["counts"]
    assert run("p", "--limit", "2") == 0 and counts()["records"] == 2
    assert run("p", "--limit", "2", "--resume") == 4  # c is a duplicate, d has no page
    assert counts() == {"pages": 2, "records": 2, "failed": 1}
    assert run("q", "--resume") == 0 and counts() == {"pages": 3, "records": 3, "failed": 0}
    assert sorted(r["title"] for r in rows_of(tmp_path / "o/r/csv")) == ["A", "B", "D"]
    report = json.loads((tmp_path / "o/r/report.json").read_text())
    assert report["pages"]["success"] == 4 and report["pages"]["failed"] == 0 and report["state"] == "completed"
