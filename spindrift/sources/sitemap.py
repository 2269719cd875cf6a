"""Sitemaps: documents to locations, and the bounded walk from an index to pages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import resolve

_SCHEMA = "url string, root string, place int, loc string, error string"

#: A worker holds the parsed rows of so many documents, and hands on so many rows: a document may have very many locations.
PARSED_AT_ONCE, ROWS_AT_ONCE, BATCH_BYTES = 8, 10_000, 16 << 20


def _locations(url: str | None, text: str | None, max_bytes: int) -> list[tuple]:
    """(url, root, place, loc, error) of one document."""
    from xml.etree import ElementTree

    if text is None or len(text.encode()) > max_bytes:
        return [(url, None, None, None, "empty" if text is None else "too large")]
    try:
        if "<!ENTITY" in text:
            raise ElementTree.ParseError("entities aren't read")
        root = ElementTree.fromstring(text.strip().encode())
    except ElementTree.ParseError as e:
        return [(url, None, None, None, f"malformed: {e}"[:200])]
    name = root.tag.rpartition("}")[2].lower()
    found = [x.text.strip() for x in root.iter() if isinstance(x.tag, str) and x.tag.rpartition("}")[2].lower() == "loc" and x.text and x.text.strip()]
    return [(url, name, i, x, None) for i, x in enumerate(found)]


def parsed(batches: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The locations of batches of documents (url, body), a few documents at a time."""
    for batch in batches:
        for part in range(0, batch.num_rows, PARSED_AT_ONCE):
            rows = [r for u, text in zip(*(c.slice(part, PARSED_AT_ONCE) for c in batch.columns[:2])) for r in _locations(u.as_py(), text.as_py(), max_bytes)]
            for at in range(0, len(rows), ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + ROWS_AT_ONCE]), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], ["url", "root", "place", "loc", "error"])


def parse_sitemaps(documents: DataFrame, url: str = "url", body: str = "body", max_bytes: int = 10_000_000) -> DataFrame:
    """(url, root, place, loc, error): each location of each document, resolved against its URL, in order.

    Names count without their namespace; every loc counts, at any depth; the root's name tells an index from a set of
    URLs. A document that isn't well formed, or has more bytes than max_bytes, gives one row with an error."""

    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    raw = documents.select(F.col(f"`{url}`").alias("url"), F.col(f"`{body}`").cast("string").alias("body")).mapInArrow(lambda batches: parsed(batches, max_bytes), _SCHEMA)
    return raw.withColumn("loc", resolve(F.col("url"), F.col("loc"))).where("loc is not null or error is not null")


def discover(roots: list[str], documents: DataFrame, max_urls: int = 10_000, max_depth: int = 3, max_documents: int = 10_000, max_queue: int = 10_000, max_bytes: int = 10_000_000, allowed=None) -> list[str]:
    """The page URLs that a breadth-first walk over the documents (url, body) finds, in order, within the bounds.

    A level is one join of the frontier with the documents; only those are parsed. The bounds limit what is kept on the
    driver: at most max_queue URLs of documents and max_urls of pages. A document of more than max_bytes is passed over.
    allowed(url Column) may restrict documents and pages."""
    spark = documents.sparkSession
    frontier, seen, urls, used_documents = list(dict.fromkeys(roots))[:max_queue], set(), {}, 0
    for _ in range(max_depth + 1):
        frontier = [u for u in frontier if u not in seen][: max_documents - used_documents]
        if not frontier or len(urls) >= max_urls:
            break
        seen.update(frontier)
        used_documents += len(frontier)
        at = F.broadcast(spark.createDataFrame(list(enumerate(frontier)), "turn int, url string"))  # at most max_queue rows
        level = documents.join(at, "url", "left_semi")
        if allowed is not None:
            level = level.where(allowed(F.col("url")))
        rows = parse_sitemaps(level, max_bytes=max_bytes).join(at, "url").where("loc is not null")
        if allowed is not None:
            rows = rows.where(allowed(F.col("loc")))
        first = Window.partitionBy("loc", "root").orderBy("turn", "place")
        rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
        found = rows.where("root = 'urlset'").orderBy("turn", "place").limit(max_urls).select("loc").collect()
        for r in found:
            if len(urls) < max_urls:
                urls.setdefault(r.loc)
        frontier = [r.loc for r in rows.where("root = 'sitemapindex'").orderBy("turn", "place").limit(max_queue).select("loc").collect()]
    return list(urls)
