"""Walks over tables of pages: pagination chains, bounded link walks, work lists and crawl state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _recursion(spark) -> None:
    # Spark stops a recursive query at a million rows unless told otherwise; ours are bounded by levels.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def walk_pages(heads: DataFrame, links: DataFrame, max_pages: int = 5) -> DataFrame:
    """(start, page_no, key): the pages of each chain. heads has start; links has key and next_key, one row a key.

    A chain ends without a next page or after max_pages. A link to the page itself repeats it until then. All chains
    advance together, a join a step."""
    spark = heads.sparkSession
    _recursion(spark)
    return spark.sql(
        f"""WITH RECURSIVE w(start, page_no, key) MAX RECURSION LEVEL {max_pages + 1} AS (
              SELECT start, 1, start FROM {{heads}}
              UNION ALL
              SELECT w.start, w.page_no + 1, l.next_key FROM w JOIN {{links}} l ON l.key = w.key
              WHERE w.page_no < {max_pages} AND l.next_key IS NOT NULL)
            SELECT start, page_no, key FROM w""",
        heads=heads,
        links=links,
    )


def walk_links(heads: DataFrame, edges: DataFrame, max_depth: int = 2) -> DataFrame:
    """(start, node, depth, path): all walks along edges (src, dst) from each start, without returning to a node of the
    same walk; two walks may meet."""
    spark = heads.sparkSession
    _recursion(spark)
    return spark.sql(
        f"""WITH RECURSIVE w(start, node, depth, path) MAX RECURSION LEVEL {max_depth + 2} AS (
              SELECT start, start, 0, array(start) FROM {{heads}}
              UNION ALL
              SELECT w.start, e.dst, w.depth + 1, array_append(w.path, e.dst) FROM w JOIN {{edges}} e ON e.src = w.node
              WHERE w.depth < {max_depth} AND NOT array_contains(w.path, e.dst))
            SELECT start, node, depth, path FROM w""",
        heads=heads,
        edges=edges,
    )


def work_list(start: DataFrame, sitemap: DataFrame | None = None, incomplete: DataFrame | None = None, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(url, place): start, then sitemap, then incomplete URLs, each once, at its first place, without those done.

    Each input has url and place. A limit takes the first ones; without one nothing is sorted as a whole."""
    parts = [d.select("url", F.lit(i).alias("part"), F.col("place").cast("long").alias("place")) for i, d in enumerate((start, sitemap, incomplete)) if d is not None]
    all_urls = parts[0]
    for p in parts[1:]:
        all_urls = all_urls.unionByName(p)
    out = all_urls.groupBy("url").agg(F.min(F.struct("part", "place")).alias("at"))
    if done is not None:
        out = out.join(done.select("url"), "url", "left_anti")
    return (out.orderBy("at").limit(limit) if limit is not None else out).select("url", "at.part", "at.place")


def latest_state(log: DataFrame, keys: Sequence[str] = ("url", "kind"), order: str = "seq") -> DataFrame:
    """The state of each key after its log: last status, number of attempts, error and completion time, first known parent.

    The log only grows, so that writers never update; the state is one aggregation with partial results on the map side.
    A status in_progress or done clears the error."""
    error = F.when(F.col("status") == "failed", F.col("error"))
    return log.groupBy(*keys).agg(
        F.max_by("status", order).alias("status"),
        F.count_if(F.col("status") == "in_progress").alias("attempts"),
        F.max_by(error, order).alias("last_error"),
        F.max_by(F.when(F.col("status") == "done", F.col("ts")), order).alias("completed_at"),
        F.max_by("parent_url", F.when(F.col("parent_url").isNotNull(), F.col(order))).alias("parent_url"),
    )


def incomplete(state: DataFrame, kind: str | None = None) -> DataFrame:
    """What a resumed run has to do again: failed, or never finished."""
    out = state.where(F.col("status").isin("in_progress", "failed"))
    return out if kind is None else out.where(F.col("kind") == kind)


def not_done(items: DataFrame, state: DataFrame, keys: Sequence[str] = ("url", "kind")) -> DataFrame:
    return items.join(state.where("status = 'done'").select(*keys), list(keys), "left_anti")


def migrate(items: DataFrame, visited: DataFrame, kind: str = "generic") -> DataFrame:
    """items (url, kind, status) with the rows of an older table (url, status) that items lacks."""
    old = visited.select("url", F.lit(kind).alias("kind"), "status").join(items.select("url", "kind"), ["url", "kind"], "left_anti")
    return items.select("url", "kind", "status").unionByName(old)


def first_match(*values: Column) -> Column:
    """The first list that isn't empty; an empty one where all are."""
    out = F.coalesce(*[F.when(F.size(v) > 0, v) for v in values])
    return F.coalesce(out, F.slice(values[0], 1, 0))


def sequence_of(order: Sequence[str]) -> Column:
    """A row's place in a whole order; it sorts everything in one task, so it is for tables that one task can hold."""
    return F.row_number().over(Window.orderBy(*order))
