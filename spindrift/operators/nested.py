"""Following links: child pages joined to their parents, nested in link order, to a bounded depth and without cycles.

Each level is one join on the canonical URL. A page is extracted once for each field that leads to it, however many
parents link to it; cycles are told by each branch's own ancestry, so a page may appear in several branches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import materialise
from ..functions.urls import UrlPolicy, crawl_key, json_suffix, resolve
from ..spec import Field, Spec
from .extract import extract


def page_index(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """(key, final_url, body) with one row a canonical URL, the smallest of those that share it."""
    return pages.select(crawl_key(F.col(f"`{url}`")).alias("key"), F.struct(F.col(f"`{url}`").alias("final_url"), F.col(f"`{body}`").cast("string").alias("body")).alias("page")).where("key is not null").groupBy("key").agg(F.min("page").alias("page")).select("key", "page.*")


def attach(parents: DataFrame, child_rows: DataFrame, row_key: str, name: str, child_type: str) -> DataFrame:
    """parents with child_rows (row_key, pos, child) nested under name as a list in order of pos."""
    lists = child_rows.groupBy(row_key).agg(F.array_sort(F.collect_list(F.struct("pos", "child"))).alias("__c"))
    lists = lists.select(row_key, F.transform("__c", lambda x: x["child"]).alias(f"__{name}"))
    return parents.join(lists, row_key, "left").withColumn(name, F.coalesce(F.col(f"`__{name}`"), F.array().cast(f"array<{child_type}>"))).drop(f"__{name}")


def nested_type(f: Field, json_page: bool, depth: int) -> str:
    """The type of a followed field's members, to the depth that is left."""
    parts = []
    for c in f.nested_fields:
        kind = c.spark_type(json_page)
        if c.follow_url:
            kind = f"array<{nested_type(c, json_page, depth - 1)}>"
        parts.append(f"`{c.name}`:{kind}")
    return f"struct<{','.join([*parts, '_source_url:string', '_parent_url:string'])}>"


def follow(records: DataFrame, index: DataFrame, spec: Spec, url: str = "url", policy: UrlPolicy | None = None) -> DataFrame:
    """records (of extract, url among its keys) with every field that follows URLs replaced by the child records.

    Links beyond max_nested_urls are left out, before the policy looks at them; links that the policy rejects or that lead
    back to an ancestor are skipped. A child that isn't in the index, or can't be read, fails: with
    fail_parent_on_nested_error its parent gets error_category nested_error, else it is just missing. From max_depth on,
    lists are empty."""
    row = "__row"
    # Records are read several times below: the page pass that made them must not run as often. The row numbers are fixed
    # by the checkpoint, so that repeated rows stay apart.
    base = materialise(records.withColumn(row, F.monotonically_increasing_id()).withColumn("__path", F.array(crawl_key(F.col(f"`{url}`")))))
    out = _level(base, index, spec, spec.fields, F.col(f"`{url}`"), row, 0, policy or spec.policy)
    return out.drop(row, "__path")


def _level(rows: DataFrame, index: DataFrame, spec: Spec, fields: tuple[Field, ...], at: Column, row: str, depth: int, policy: UrlPolicy) -> DataFrame:
    json_page = spec.response_type == "json"
    for f in fields:
        if not f.follow_url:
            continue
        kind = nested_type(f, json_page, spec.max_depth - depth)
        if depth >= spec.max_depth:
            rows = rows.withColumn(f.name, F.array().cast(f"array<{kind}>"))
            continue
        links = rows.select(F.col(row).alias("__parent"), "__path", at.alias("__at"), F.posexplode(F.slice(f"`{f.name}`", 1, spec.max_nested_urls)).alias("pos", "link"))
        target = resolve(F.col("__at"), F.col("link"))
        if json_page and spec.append_json_suffix:
            target = json_suffix(target)
        # Checked in the pass that resolves, and written out before it is filtered: a filter that is pushed below would repeat
        # the resolution at each of its uses, and one above would run at each of the two below.
        ok = policy.reject_reason(F.col("child_url"), F.col("__at")).isNull() & ~F.array_contains("__path", F.col("child_url"))
        links = materialise(links.withColumn("child_url", target).withColumn("child_url", F.when(ok, F.col("child_url")))).where("child_url is not null")
        wanted = links.select(F.col("child_url").alias("key")).distinct()
        pages = index.join(wanted, "key", "left_semi")
        children = extract(pages, replace(spec, fields=f.nested_fields), ("key", "final_url"), "body")
        joined = links.join(children.withColumnRenamed("key", "child_url").withColumnRenamed("error_category", "__child_error"), "child_url", "left")
        joined = materialise(joined.withColumn("__failed", F.col("final_url").isNull() | F.col("__child_error").isNotNull()))
        good = joined.where("not __failed").withColumn("__path", F.array_append("__path", F.col("child_url"))).withColumn("__parent_pos", F.struct("__parent", "pos"))
        if any(c.follow_url for c in f.nested_fields):
            good = good.withColumn("error_category", F.lit(None).cast("string"))
            good = _level(good, index, spec, f.nested_fields, F.col("final_url"), "__parent_pos", depth + 1, policy)
            nested_bad = F.col("error_category").isNotNull()
        else:
            nested_bad = F.lit(False)
        child = F.struct(*[F.col(f"`{c.name}`") for c in f.nested_fields], F.col("child_url").alias("_source_url"), F.col("__at").alias("_parent_url")).cast(kind)
        members = good.where(~nested_bad).select(F.col("__parent").alias(row), "pos", child.alias("child"))
        rows = attach(rows, members, row, f.name, kind)
        if spec.fail_parent_on_nested_error:
            bad = joined.where("__failed").select("__parent").unionByName(good.where(nested_bad).select("__parent")).distinct().select(F.col("__parent").alias(row), F.lit(True).alias("__bad"))
            rows = rows.join(bad, row, "left").withColumn("error_category", F.coalesce("error_category", F.when(F.col("__bad"), "nested_error"))).drop("__bad")
    return rows


def with_known_children(links: DataFrame, known: DataFrame, field_key: str) -> DataFrame:
    """links (parent_url, child_url, ...) with the child records that an earlier run kept for the same parent and field."""
    own = known.where(F.col("field_key") == field_key).select(F.col("url").alias("child_url"), "parent_url", F.col("record").alias("known_record"))
    return links.join(own, ["child_url", "parent_url"], "left")
