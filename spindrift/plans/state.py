"""Queries over crawl state, request metrics, statistics, and stateful replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, metrics
from ..spec import issues_frame, parse_spec
from ..streaming.stateful import CircuitBreaker, TokenBucket, replay, windowed_counts
from .base import query, table

_STATUS = "CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'error' THEN 'failed' ELSE 'done' END"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a state log: users are URLs, the value's parity the kind."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "root").otherwise("nested")
    status = F.when(F.col("event_type") == "view", "in_progress").when(F.col("event_type") == "error", "failed").otherwise("done")
    parent = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("p"), F.col("event_id").cast("string")))
    return e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"), kind.alias("kind"), status.alias("status"), parent.alias("parent_url"), F.col("props").alias("error"), "ts", F.col("event_id").alias("seq"))


_LOG = f"(SELECT '/u/' || user_id AS url, CASE WHEN event_id % 2 = 0 THEN 'root' ELSE 'nested' END AS kind, {_STATUS} AS status, CASE WHEN event_id % 3 = 0 THEN 'p' || event_id END AS parent_url, props AS error, ts, event_id AS seq FROM events)"
_LATEST = f"""SELECT url, kind, arg_max(status, seq) AS status, count(*) FILTER (status = 'in_progress') AS attempts,
 CASE WHEN arg_max(status, seq) = 'failed' THEN arg_max(error, seq) END AS last_error, arg_max(parent_url, seq) FILTER (parent_url IS NOT NULL) AS parent_url FROM {_LOG} GROUP BY url, kind"""


@query(_LATEST)
def resume_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.latest_state(_log(spark, sf_dir)).drop("completed_at")


@query(f"SELECT url, kind FROM ({_LATEST}) WHERE status IN ('in_progress', 'failed') AND kind = 'root'")
def incomplete_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.incomplete(crawl.latest_state(_log(spark, sf_dir)), "root").select("url", "kind")


@query(f"SELECT seq FROM {_LOG} l WHERE NOT EXISTS (SELECT 1 FROM ({_LATEST}) s WHERE s.url = l.url AND s.kind = l.kind AND s.status = 'done')")
def done_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return crawl.not_done(log, crawl.latest_state(log)).select("seq")


@query(f"SELECT url, kind, status FROM ({_LATEST}) UNION ALL SELECT '/u/' || c_custkey, 'root', 'done' FROM customer WHERE '/u/' || c_custkey NOT IN (SELECT url FROM {_LOG} WHERE kind = 'root')")
def state_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.concat(F.lit("/u/"), F.col("c_custkey").cast("string")).alias("url"), F.lit("done").alias("status"))
    return crawl.migrate(crawl.latest_state(_log(spark, sf_dir)), old, "root")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests: the type is the origin, the value the latency."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 10 == 0, 503).otherwise(200)
    category = F.when(F.col("event_id") % 17 == 0, "blocked").when(F.col("event_id") % 10 == 0, "http_error")
    return e.select(F.col("event_type").alias("origin"), status.alias("status_code"), category.alias("category"), F.col("value").alias("elapsed_ms"))


_SAMPLES = "(SELECT event_type AS origin, CASE WHEN event_id % 10 = 0 THEN 503 ELSE 200 END AS status_code, CASE WHEN event_id % 17 = 0 THEN 'blocked' WHEN event_id % 10 = 0 THEN 'http_error' END AS category, value AS elapsed_ms FROM events)"


@query(f"""SELECT origin, count(*) AS requests, count(*) FILTER (status_code = 200 AND category IS NULL) AS success, count(*) FILTER (category = 'blocked') AS blocked,
count(*) FILTER (NOT (status_code = 200 AND category IS NULL) AND category IS DISTINCT FROM 'blocked') AS failed FROM {_SAMPLES} GROUP BY origin""")
def origin_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.origin_metrics(_samples(spark, sf_dir))


@query(f"SELECT origin, category, count(*) AS n, CAST(grouping(origin, category) AS INT) AS level FROM {_SAMPLES} GROUP BY ROLLUP (origin, category)")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_rollup(_samples(spark, sf_dir))


@query(f"SELECT origin, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM (SELECT origin, category, count(*) AS n FROM {_SAMPLES} WHERE category IS NOT NULL GROUP BY ALL) GROUP BY origin")
def origin_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.categories_by_origin(_samples(spark, sf_dir))
    return m.select("origin", F.array_join(F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("categories"))


_BUCKET = "CAST(CASE WHEN elapsed_ms < 1 THEN 0 ELSE least(ceil(log2(elapsed_ms)), 17) END AS INT)"


@query(f"SELECT origin, {_BUCKET} AS bucket, count(*) AS n FROM {_SAMPLES} GROUP BY ALL")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_samples(spark, sf_dir), by=("origin",)).drop("max_ms")


def _share(p: float) -> str:
    low = "pow(2, bucket - 1)"
    return f"arg_min(round(CASE WHEN bucket = 0 THEN 1.0 WHEN bucket > 16 THEN mx ELSE {low} + {low} * (size * {p} - (done - n)) / n END, 6), bucket) FILTER (done >= size * {p})"


@query(f"""WITH h AS (SELECT origin, {_BUCKET} AS bucket, elapsed_ms FROM {_SAMPLES} UNION ALL SELECT NULL, {_BUCKET}, elapsed_ms FROM {_SAMPLES}),
b AS (SELECT origin, bucket, count(*) AS n, max(elapsed_ms) AS top FROM h GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY origin ORDER BY bucket) AS done, sum(n) OVER (PARTITION BY origin) AS size, max(top) OVER (PARTITION BY origin) AS mx FROM b)
SELECT origin, CAST(max(size) AS BIGINT) AS samples, max(mx) AS max_ms, {_share(0.5)} AS p50, {_share(0.95)} AS p95 FROM c GROUP BY origin""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(_samples(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


@query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS n FROM events GROUP BY event_type")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_counts(table(spark, sf_dir, "events"), n="user_id")


@query("SELECT count(*) FILTER (event_type = 'view') AS success, count(*) FILTER (event_type = 'error') AS failed, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS blocked, coalesce(CAST(sum(user_id) FILTER (event_type = 'click') AS BIGINT), 0) AS entries FROM events")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "view", "page_success").when(t == "error", "page_error").when(t == "click", "entries_added")
    return metrics.run_stats(table(spark, sf_dir, "events").select(kind.alias("event_type"), F.when(t == "click", F.col("user_id")).otherwise(1).alias("count")))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING), 6) AS moving_avg FROM events")
def moving_avg_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.moving_average(table(spark, sf_dir, "events"), "value", "event_id", "user_id").select("event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"))


@query()
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(table(spark, sf_dir, "events"), TokenBucket(0.001, 2), "user_id", "ts", "event_id")


@query()
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error").withColumn("took", F.col("value"))
    return replay(e, CircuitBreaker(2, 3600), "user_id", "ts", "event_id", "ok", "took")


_BAD = {
    "mode": "list", "name": "bad", "colour": 1, "min_delay": 5, "max_delay": 1, "concurrency": 0, "record_field": "none", "dedup": {"mode": "fields"},
    "fields": [{"name": "a", "selector": "div[", "transformers": ["shout"]}, {"name": "b", "selector": "a", "follow_url": True}],
}


@query("""SELECT * FROM (VALUES ('config', 'warning'), ('concurrency', 'error'), ('min_delay', 'error'), ('fields[0].selectors[0]', 'error'), ('fields[0].transformers[0]', 'error'),
('fields[1].nested_fields', 'error'), ('start_urls', 'error'), ('record_field', 'error'), ('dedup.fields', 'error')) t(path, severity)""")
def spec_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults of a spec at once."""
    return issues_frame(spark, parse_spec(_BAD)[1]).select("path", "severity")
