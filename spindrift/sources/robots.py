"""robots.txt rules as a table, and the filter that applies them to URLs by origin."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonicalize, origin

BROADCAST_ORIGINS = 100_000


def rules_of(body: str, agent: str = "*") -> list[tuple[bool, str]]:
    """(allow, path prefix) in order, of the groups for an agent, or of those for all where it has none of its own."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    agents_open = False
    for line in body.splitlines():
        key, colon, value = line.partition("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not agents_open:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            agents_open = True
        elif key in ("allow", "disallow"):
            agents_open = False
            if groups:
                # An empty "disallow" allows everything.
                groups[-1][1].append((key == "allow" or not value, value))
    own = [r for names, rules in groups if any(n != "*" and n in agent.lower() for n in names) for r in rules]
    return own or [r for names, rules in groups if "*" in names for r in rules]


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(origin, known, rules) of a table (origin, status, body): one row an origin; known tells whether it was fetched."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("allow", pa.bool_()), ("path", pa.string())]))
        for batch in batches:
            origins, good, bodies = (c.to_pylist() for c in batch.columns)
            rules = [[{"allow": a, "path": p} for a, p in rules_of(b, agent)] if g and b is not None else [] for g, b in zip(good, bodies)]
            yield pa.RecordBatch.from_arrays([pa.array(origins, pa.string()), pa.array(good, pa.bool_()), pa.array(rules, kind)], ["origin", "known", "rules"])

    one = robots.groupBy("origin").agg(F.min_by(F.struct("status", "body"), F.struct("status", "body")).alias("r"))
    rows = one.select("origin", F.coalesce(F.col("r.status").between(200, 299), F.lit(False)).alias("good"), F.col("r.body").cast("string").alias("body"))
    return rows.mapInArrow(parse, "origin string, known boolean, rules array<struct<allow:boolean,path:string>>")


def allowed_by(rules: Column, path: Column) -> Column:
    """The first rule whose prefix fits decides; without one the path is allowed."""
    first = F.get(F.filter(rules, lambda r: path.startswith(r["path"])), 0)
    return F.coalesce(first["allow"], F.lit(True))


def filter_by_robots(pages: DataFrame, robots: DataFrame, url: str = "url", failure_policy: str = "allow", agent: str = "*") -> DataFrame:
    """The pages that their origin's rules allow. An origin without rules, fetched with a failure or not at all, follows
    failure_policy."""
    rules = robots_rules(robots, agent)
    if robots.limit(BROADCAST_ORIGINS + 1).count() <= BROADCAST_ORIGINS:
        rules = F.broadcast(rules)
    path = F.regexp_replace(canonicalize(F.col(f"`{url}`")), "^[^/]+//[^/]+", "")
    joined = pages.withColumn("__origin", origin(F.col(f"`{url}`"))).join(rules.withColumnsRenamed({"origin": "__origin", "known": "__known", "rules": "__rules"}), "__origin", "left")
    ok = F.when(F.coalesce("__known", F.lit(False)), allowed_by(F.col("__rules"), path)).otherwise(F.lit(failure_policy == "allow"))
    return joined.where(ok).drop("__origin", "__known", "__rules")
