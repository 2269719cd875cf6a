"""Command line: validate a spec, preview it on one page, or run it over a table of pages."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import functions as F

from .functions.text import redact_config
from .spec import Spec, load_spec

#: A line of the state log.
_STATE = "url string, kind string, status string, error string, parent_url string, seq long, ts string"
OK, INVALID, FAILED, SOME_FAILED, INTERRUPTED = 0, 1, 2, 4, 130


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("spindrift").getOrCreate()


def _read(path: str, as_json: bool) -> tuple[Spec | None, int]:
    spec, issues = load_spec(path)
    if as_json:
        print(json.dumps({"valid": spec is not None, "issues": [vars(i) for i in issues]}))
    else:
        for i in issues:
            print(f"{i.severity}: {i.path}: {i.message}", file=sys.stderr)
    return spec, OK if spec is not None else INVALID


def validate(args: argparse.Namespace) -> int:
    spec, code = _read(args.spec, args.format == "json")
    if spec is not None and args.format == "text":
        print(f"{args.spec} is valid")
    return code


def preview(args: argparse.Namespace) -> int:
    from .operators.extract import extract
    from .operators.extract import preview as report

    spec, code = _read(args.spec, False)
    if spec is None:
        return code
    pages = _session().read.parquet(args.pages)
    if args.url:
        pages = pages.where(F.col("url") == args.url)
    rows = [r.asDict() for r in report(extract(pages.limit(1), spec, ("url",), args.body), spec).collect()]
    print(json.dumps(rows, ensure_ascii=False) if args.format == "json" else "\n".join(f"{r['field']}: {r['matches']} {r['samples']} {r['warning'] or ''}" for r in rows))
    return OK if rows else FAILED


def run(args: argparse.Namespace) -> int:
    from .operators.crawl import latest_state
    from .operators.metrics import final_report
    from .plans.run import with_record_count
    from .plans.source import run_source
    from .sinks.files import sizes, write_csv, write_failures, write_jsonl, write_manifest

    spec, code = _read(args.spec, False)
    if spec is None:
        return code
    if args.dry_run:
        return preview(args)
    run_id = args.run_id or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    folder = Path(args.output_dir) / run_id
    raw = json.loads(Path(args.spec).read_text(encoding="utf-8"))
    write_manifest(folder / "manifest.json", raw, resume=args.resume, run_id=run_id, state="running")
    spark = _session()
    pages = spark.read.parquet(args.pages)
    if args.url:
        pages = pages.where(F.col("url") == args.url)
    read = lambda name, schema: spark.read.schema(schema).json(str(folder / name)) if args.resume and (folder / name).exists() else None
    log = read("state", _STATE)
    state = None if log is None else latest_state(log)
    start = pages.select("url", F.monotonically_increasing_id().alias("place")) if args.all_pages else None
    table = lambda path: spark.read.parquet(path) if path else None
    now = datetime.now(timezone.utc).isoformat()
    status, counts = "failed", {"pages": 0, "records": 0, "failed": 0}
    try:
        if args.all_pages:
            spec = replace(spec, mode="list")
        outcome = run_source(spec, pages, "url", args.body, table(args.sitemaps), table(args.robots), state, read("keys", "key string"), args.limit, start)
        kept = with_record_count(outcome.records, spec)
        # Records first, the state last: what is done is never without its records.
        write_jsonl(kept, str(folder / "records"))
        write_jsonl(outcome.keys, str(folder / "keys"))
        write_failures(outcome.failures.withColumn("timestamp", F.lit(now)), str(folder / "failures"))
        turn = F.lit((log.agg(F.max("seq")).first()[0] or 0) + 1 if log is not None else 0)
        order = turn + F.when(F.col("status") == "in_progress", 0).otherwise(1)
        write_jsonl(outcome.log.withColumns({"seq": order.cast("long"), "ts": F.lit(now)}), str(folder / "state"))
        whole = spark.read.schema(kept.schema).json(str(folder / "records"))
        write_csv(whole.drop("record_count"), str(folder / "csv"), [f.name for f in spec.fields])
        ended = latest_state(spark.read.schema(_STATE).json(str(folder / "state")))
        pages_of = ended.select(F.when(F.col("status") == "done", "success").otherwise("failed").alias("status"), F.lit(0).alias("records"))
        failures = spark.read.schema("url string, category string, message string, timestamp string").json(str(folder / "failures"))
        written = whole.agg(F.count("*").alias("pages"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records")).first()
        report = final_report(pages_of, failures)
        counts = {"pages": written.pages, "records": written.records, "failed": report["pages"]["failed"]}
        status = "completed" if not counts["failed"] else "partial"
        report |= {"run_id": run_id, "state": status, "records": written.records, "artifacts": sizes([folder / x for x in ("records", "failures", "csv", "state", "keys")])}
        (folder / "report.json").write_text(json.dumps(report, indent=2, default=str))
    except KeyboardInterrupt:
        status = "cancelled"
    finally:
        write_manifest(folder / "manifest.json", raw, run_id=run_id, state=status, counts=counts)
    print(json.dumps({"run_id": run_id, "state": status, **counts, "spec": redact_config(raw).get("name")}))
    return INTERRUPTED if status == "cancelled" else SOME_FAILED if counts["failed"] else OK


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("validate", "check a spec"), ("preview", "extract one page and write nothing"), ("run", "extract all pages")):
        s = sub.add_parser(name, help=about)
        s.add_argument("spec")
        s.add_argument("--format", choices=("text", "json"), default="text")
        if name != "validate":
            s.add_argument("--pages", required=True, help="Parquet with url and a body")
            s.add_argument("--body", default="html")
            s.add_argument("--url")
        if name == "run":
            s.add_argument("--output-dir", default="output")
            s.add_argument("--run-id")
            s.add_argument("--limit", type=int, help="pages of this run, of those that aren't done")
            s.add_argument("--all-pages", action="store_true", help="take all pages of the table instead of the spec's URLs")
            s.add_argument("--sitemaps", help="Parquet with url and body of sitemap documents")
            s.add_argument("--robots", help="Parquet with origin, status and body of robots files")
            s.add_argument("--dry-run", action="store_true")
            s.add_argument("--resume", action="store_true")
    args = p.parse_args(argv)
    try:
        return {"validate": validate, "preview": preview, "run": run}[args.command](args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    raise SystemExit(main())
