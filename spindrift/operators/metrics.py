"""Metrics of requests: counts by origin and category, histograms of latency and the percentiles that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.network import is_success

#: The last bucket of the histogram, in powers of two of a millisecond; what is beyond overflows.
LAST_BUCKET = 16


def bucket(ms: Column) -> Column:
    """0 below a millisecond, else its binary logarithm, rounded up."""
    return F.when(ms < 1, 0).otherwise(F.ceil(F.log2(ms))).cast("int")


def histogram(samples: DataFrame, ms: str = "elapsed_ms", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bucket, n); the overflow is the bucket after LAST_BUCKET."""
    b = F.least(bucket(F.col(ms)), F.lit(LAST_BUCKET + 1))
    return samples.where(F.col(ms).isNotNull()).groupBy(*by, b.alias("bucket")).agg(F.count("*").alias("n"), F.max(ms).alias("max_ms"))


def percentiles(samples: DataFrame, ms: str = "elapsed_ms", by: str | None = "origin", shares: dict[str, float] | None = None) -> DataFrame:
    """(by, samples, max_ms, p50, p95): over all rows (by is null there) and for each group.

    Latencies are reduced to at most 18 buckets a group before anything is sorted, and a percentile is interpolated inside
    its bucket. In bucket 0 it is 1; in the overflow it is the largest latency."""
    shares = shares or {"p50": 0.5, "p95": 0.95}
    b = F.least(bucket(F.col(ms)), F.lit(LAST_BUCKET + 1)).alias("bucket")
    key = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    rows = samples.where(F.col(ms).isNotNull()).select(key.alias("origin"), b, F.col(ms).alias("ms"))
    one = rows.groupBy("origin", "bucket").agg(F.count("*").alias("n"), F.max("ms").alias("top"))
    every = one.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top")).select(F.lit(None).cast("string").alias("origin"), "bucket", "n", "top", F.lit(True).alias("total"))
    h = every if by is None else one.select("origin", "bucket", "n", "top", F.lit(False).alias("total")).unionByName(every)
    w = Window.partitionBy("total", "origin")
    h = h.withColumn("done", F.sum("n").over(w.orderBy("bucket"))).withColumn("size", F.sum("n").over(w)).withColumn("max_ms", F.max("top").over(w))
    parts = []
    for name, p in shares.items():
        need = F.col("size") * p
        low = F.pow(F.lit(2.0), F.col("bucket") - 1)
        inside = low + low * (need - (F.col("done") - F.col("n"))) / F.col("n")
        value = F.when(F.col("bucket") == 0, 1.0).when(F.col("bucket") > LAST_BUCKET, F.col("max_ms")).otherwise(inside)
        parts.append(F.min_by(value, F.when(F.col("done") >= need, F.col("bucket"))).alias(name))
    return h.groupBy("total", "origin").agg(F.max("size").alias("samples"), F.max("max_ms").alias("max_ms"), *parts).drop("total")


def origin_metrics(samples: DataFrame) -> DataFrame:
    """(origin, requests, success, blocked, failed); what is neither success nor blocked failed."""
    good = is_success(F.col("status_code")) & F.col("category").isNull()
    blocked = F.coalesce(F.col("category") == "blocked", F.lit(False))
    return samples.groupBy("origin").agg(
        F.count("*").alias("requests"),
        F.count_if(F.coalesce(good, F.lit(False))).alias("success"),
        F.count_if(blocked).alias("blocked"),
        F.count_if(~F.coalesce(good, F.lit(False)) & ~blocked).alias("failed"),
    )


def category_rollup(samples: DataFrame, origin: str = "origin", category: str = "category") -> DataFrame:
    """(origin, category, n) for each pair, each origin and in all; level tells which: 0, 1 or 3."""
    return samples.rollup(origin, category).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def categories_by_origin(samples: DataFrame) -> DataFrame:
    """(origin, categories): a map of category to count."""
    n = samples.where("category is not null").groupBy("origin", "category").agg(F.count("*").alias("n"))
    return n.groupBy("origin").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))


def event_counts(events: DataFrame, name: str = "event_type", n: str | None = None) -> DataFrame:
    """(name, n): named counters; a row counts once, or as often as its column n says."""
    return events.groupBy(name).agg((F.count("*") if n is None else F.sum(n)).alias("n"))


def run_stats(events: DataFrame) -> DataFrame:
    """(success, failed, skipped, blocked, entries) of a run, as one row, from its events (event_type, count)."""
    total = lambda *names: F.coalesce(F.sum(F.when(F.col("event_type").isin(*names), F.col("count"))), F.lit(0)).cast("long")
    return events.agg(total("page_success").alias("success"), total("page_error").alias("failed"), total("page_skipped").alias("skipped"), total("blocked").alias("blocked"), total("entries_added").alias("entries"))


def moving_average(df: DataFrame, value: str, order: str, by: str, size: int = 10) -> DataFrame:
    """df with the mean of the last size values of each group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn("moving_avg", F.avg(value).over(w))


def final_report(pages: DataFrame, failures: DataFrame) -> dict:
    """The report of a run: counts of pages (status, records) and the last five failures. Collected: it is one row and five."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    row = pages.agg(n("success"), n("failed"), n("skipped"), n("blocked"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first().asDict()
    last = [r.asDict() for r in failures.orderBy(F.col("timestamp").desc(), "url").limit(5).collect()]
    return {"pages": {**{k: row[k] for k in ("success", "failed", "skipped", "blocked")}, "total": row["success"] + row["failed"]}, "records": row["records"], "failed_urls": last}
