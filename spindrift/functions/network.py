"""Statuses, failures and waiting times of requests, as Spark expressions over their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_STATUSES = (408, 425, 429, 500, 502, 503, 504)
#: Kind of error, as a source names it, to category. What isn't here is internal_error.
CATEGORIES = {
    "timeout": "timeout",
    "connection": "network_error",
    "dns": "network_error",
    "tls": "network_error",
    "os": "network_error",
    "parse": "parse_error",
    "json": "parse_error",
    "robots": "robots_blocked",
    "auth": "auth_error",
    "policy": "url_policy_blocked",
    "private_address": "url_policy_blocked",
    "validation": "validation_error",
    "nested": "nested_error",
    "interaction": "interaction_error",
}
NEVER_RETRIED = ("parse_error", "robots_blocked", "auth_error", "url_policy_blocked", "validation_error", "internal_error", "interaction_error")


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def is_retryable_status(status: Column, statuses: Sequence[int] = RETRY_STATUSES) -> Column:
    return status.isin(*statuses)


def classify_error(status: Column, kind: Column, exhausted: Column | None = None) -> Column:
    """The category of a failed request; null for one that succeeded. A 429 counts as rate_limit only once its attempts
    are used up."""
    by_kind = F.lit("internal_error")
    for name, category in reversed(CATEGORIES.items()):
        by_kind = F.when(kind == name, category).otherwise(by_kind)
    limited = (status == 429) & (F.lit(True) if exhausted is None else exhausted)
    return F.when(kind.isNotNull(), by_kind).when(is_success(status), None).when(limited, "rate_limit").otherwise("http_error")


def is_retryable(category: Column, status: Column, statuses: Sequence[int] = RETRY_STATUSES) -> Column:
    return F.when(category.isin(*NEVER_RETRIED), False).when(category == "http_error", F.coalesce(status.isin(*statuses), F.lit(False))).otherwise(category.isNotNull())


def backoff(attempt: Column, base: float = 1.0, most: float = 30.0, jitter: Column | None = None) -> Column:
    """Seconds to wait after an attempt: doubling, bounded, times a jitter column where there is one."""
    seconds = F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(most))
    return seconds if jitter is None else seconds * jitter


def retry_after(value: Column, now: Column, cap: float = 300.0) -> Column:
    """Seconds of a Retry-After header, a number or a date, within 0 and cap; null where it is neither."""
    v = F.trim(value)
    number = v.try_cast("double")
    date = F.try_to_timestamp(F.concat(F.regexp_extract(v, r"([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1), F.lit(" UTC")), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.coalesce(number, F.unix_micros(date) / 1e6 - F.unix_micros(now) / 1e6)
    return F.when(seconds.isNotNull(), F.least(F.greatest(seconds, F.lit(0.0)), F.lit(cap)))
