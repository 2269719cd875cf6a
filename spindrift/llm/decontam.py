"""Benchmark decontamination: which documents contain a test item.

Containment of a short item in a long document is a matter of a small part of it, so both sides are partitioned by size.
Items are partitioned by their number of shingles, in powers of two; for the partition of at most u shingles a document
is cut into windows of 2u shingles, one every u, so that an item lies whole in some window of a size fit for its own. Of
each window and item the minimum of PERMUTATIONS hashes is taken; where one agrees, document and item are candidates.
Block minima of one partition come from those of the one below, so a document is hashed once for all of them.

Each candidate is verified by exact containment: the part of the item's distinct shingles that the document has.

The items travel to the documents: no shuffle. SLICE_WORDS bounds what is sent; a larger benchmark is cut into as many
slices as it needs, each searched in a pass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, mix64, read_table, shingle_hashes, texts, tune_arrow, words

SHINGLE = 4
THRESHOLD = 0.5
PERMUTATIONS = 40
#: Words of items in one slice.
SLICE_WORDS = 2_000_000
#: Shingles of a document that are hashed at a time.
SEGMENT = 1 << 16
SEED = 7_919


class Sketches:
    """One slice of the items, ready for search."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float, shingle: int) -> None:
        self.threshold, self.n = threshold, shingle
        hashes = WordHash()
        rng = np.random.default_rng(SEED)
        self.odd = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.ids, self.shingles, self.run = [], [], []
        by_level: dict[tuple[int, int], list[int]] = {}
        for item_id, text in items:
            ws = words(text)
            if not ws:
                continue
            n = min(shingle, len(ws))  # an item of fewer words is a shingle of its own length
            sh = np.unique(shingle_hashes(hashes.array(ws), n))
            # Windows are counted in positions, and repeated shingles take up positions too.
            level = max(0, math.ceil(math.log2((len(ws) - n + 1) / 8)))
            by_level.setdefault((n, level), []).append(len(self.ids))
            self.ids.append(item_id)
            self.shingles.append(sh)
        #: For each length of shingles and each size: sorted keys of hash and permutation, and their items.
        self.tables: dict[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for (n, level), members in by_level.items():
            low = np.stack([self.hashed(self.shingles[m]).min(axis=1) for m in members], axis=1)  # permutation x item
            keys = (low | self.marks()).ravel()
            owners = np.broadcast_to(np.array(members), low.shape).ravel()
            order = np.argsort(keys, kind="stable")
            flags = np.zeros(1 << max(16, math.ceil(math.log2(len(keys) * 16))), bool)
            flags[(low.ravel() & np.uint64(len(flags) - 1)).astype(np.int64)] = True
            self.tables.setdefault(n, {})[level] = (keys[order], owners[order], flags)

    def marks(self) -> np.ndarray:
        return (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(48))[:, None]

    def hashed(self, sh: np.ndarray) -> np.ndarray:
        """permutation x shingle, 40 bits each."""
        return (sh[None, :] * self.odd[:, None]) >> np.uint64(24)

    def candidates(self, sh: np.ndarray, levels: dict) -> set[int]:
        found: set[int] = set()
        top = max(levels)
        # Segments overlap by a window of the largest size.
        window = 16 << top
        step = max(SEGMENT, 4 * window)
        for s in range(0, max(1, len(sh) - window), step - window) if len(sh) > step else (0,):
            part = sh[s : s + step]
            low = np.minimum.reduceat(self.hashed(part), np.arange(0, len(part), 8), axis=1)
            for level in range(top + 1):
                if level:
                    if low.shape[1] % 2:
                        low = np.concatenate([low, low[:, -1:]], axis=1)
                    low = np.minimum(low[:, ::2], low[:, 1::2])
                if level in levels:
                    keys, owners, flags = levels[level]
                    wide = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
                    p, at = np.nonzero(flags[(wide & np.uint64(len(flags) - 1)).astype(np.int64)])
                    if len(p):
                        k = np.unique(wide[p, at] | self.marks()[p, 0])
                        a, b = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
                        for x, y in zip(a[b > a], b[b > a]):
                            found.update(owners[x:y].tolist())
        return found

    def search(self, text: str | None, hashes: WordHash) -> list[tuple[int, float]]:
        """(place of the item, containment) of the items that the text contains."""
        if not (ws := words(text)):
            return []
        h, out = hashes.array(ws), []
        for n, levels in self.tables.items():
            sh = shingle_hashes(h, n)
            if len(sh) and (found := sorted(self.candidates(sh, levels))):
                own = np.unique(sh)
                for m in found:
                    at = np.searchsorted(own, self.shingles[m])
                    part = float((own[np.minimum(at, len(own) - 1)] == self.shingles[m]).mean())
                    if part >= self.threshold:
                        out.append((m, part))
        return out


def _slices(items: DataFrame, threshold: float, shingle: int, slice_words: int) -> list[Sketches]:
    """The items, whole, in slices of a bounded size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 6 / slice_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [Sketches(sorted((tuple(r) for r in rows.where(part == i).collect()), key=repr), threshold, shingle) for i in range(n)]


def _finder(spark: SparkSession, sketches: Sketches) -> Callable[[], tuple[Sketches, WordHash]]:
    sent = spark.sparkContext.broadcast(sketches)
    return lambda: (sent.value, WordHash())


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, containment) for each document and each item of which it has at least that part.

    Each row of docs is judged by itself, so a repeated row gives repeated results and a null doc_id is kept; an item
    repeated with its id counts once, and items of equal text under two ids are both reported. A null or wordless text,
    on either side, contains nothing and is contained in nothing. An item of fewer words than a shingle is searched as
    one shingle of its own length. Empty tables give an empty result; other columns are ignored."""
    spark = docs.sparkSession
    tune_arrow(spark)
    out = None
    for sketches in _slices(items, threshold, shingle, slice_words):
        start = _finder(spark, sketches)

        def search(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            known, hashes = start()
            for batch in batches:
                hits = [(d, known.ids[m], part) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m, part in known.search(t.as_py(), hashes)]
                if hits:
                    d, i, c = zip(*hits)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.float64())], ["doc_id", "item_id", "containment"])

        found = texts(docs).mapInArrow(search, "doc_id long, item_id long, containment double")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs without the rows that contain an item, with all their columns; judged as by find_contained. No join: the
    test is a predicate on the text."""
    spark = docs.sparkSession
    tune_arrow(spark)
    for sketches in _slices(items, threshold, shingle, slice_words):
        if sketches.ids:
            docs = docs.where(~_contains(spark, sketches)(F.col("text").cast("string")))
    return docs


def _contains(spark: SparkSession, sketches: Sketches) -> Callable[[Column], Column]:
    start = _finder(spark, sketches)

    @F.arrow_udf("boolean")
    def contains(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, hashes = start()
        for batch in batches:
            yield pa.array([bool(known.search(t.as_py(), hashes)) for t in batch], pa.bool_())

    return contains


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 3], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM bw)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS s
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM dw))
       WHERE s IN (SELECT s FROM bs))
SELECT doc_id, item_id, count(*) / min(n)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / min(n)::DOUBLE >= 0.5
"""
