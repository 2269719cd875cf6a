"""Near-duplicate documents by SimHash: all pairs of fingerprints within a distance, and their components.

A document's fingerprint has BITS bits: each distinct word votes on each bit. Equal fingerprints are grouped exactly.
Among the distinct ones every pair within MAX_DISTANCE bits is found: pieces of the table are compared two by two, each two
in a task of their own. Within a task all pairs are compared, tile by tile, or, where that is less work, those whose chunks
of 16 bits are so alike that no pair within the distance is missed. Groups are the connected components.

search_list is for a list in memory of which some pairs may be missed: the May-Ozerov recursion on coordinate strips. A
strip of 7 random coordinates has 16 centres (the codewords of the perfect Hamming code, shifted at random), and a
fingerprint goes to the list of the one centre from which its partial weight is at most 1. Short lists are compared by
brute force, and all is repeated with other strips.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CACHE_WORDS, materialise, read_table, texts, tune_arrow, without_keys, words

BITS = 256
MAX_DISTANCE = 48
STRIP = 7
LEAF_ROWS = 192
#: Rows of a piece, of which a task compares two, at most and at least; pieces that a table of enough rows is in at least.
MOST_ROWS, LIST_ROWS = 500_000, 20_000
PIECES = 8
#: Distances that are held at once, in a list of short leaves; pairs in a tile, its columns, and near pairs held before a merge.
BLOCK = 2_000_000
TILE, TILE_COLUMNS, HELD = 131_072, 8192, 500_000
#: Bits of a chunk that rows are sorted by; least pairs, and widest radius, for which that is tried; pairs as costly as a value.
CHUNK = 16
INDEX_PAIRS, MOST_RADIUS, BUCKET_PAIRS = 1_000_000_000, 4, 30_000
SEED = 20_011
WORDS64 = BITS // 64
FP = [f"f{i}" for i in range(WORDS64)]

#: Of each value of 7 bits the codeword within distance 1, as a number below 16.
_CODE = [c for c in range(128) if not any((sum((c >> j & 1) * ((j + 1) >> k & 1) for j in range(7)) & 1) for k in range(3))]
NEAREST = np.array([next(i for i, c in enumerate(_CODE) if bin(c ^ v).count("1") <= 1) for v in range(128)], np.int64)

#: All values of a chunk, those of few bits first, and their bits.
MASKS = np.argsort(np.bitwise_count(np.arange(1 << CHUNK)), kind="stable")
MASK_BITS = np.bitwise_count(MASKS)


class WordVotes(dict):
    """Word to the row of its bits in a table; emptied between batches once it is large."""

    def __init__(self) -> None:
        super().__init__()
        self.rows = np.zeros((1024, BITS), np.uint8)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=BITS // 8).digest()
        self.rows[i] = np.unpackbits(np.frombuffer(digest, np.uint8))
        self[word] = i
        return i


def fingerprints(found: list[list[str]], votes: WordVotes) -> np.ndarray:
    """A row of WORDS64 64-bit integers for each list of words, none of which is empty."""
    if len(votes) > CACHE_WORDS // 2:
        votes.clear()
    ids = [np.fromiter(map(votes.__getitem__, ws), np.int64, len(ws)) for ws in map(set, found)]
    sizes = np.array([len(x) for x in ids])
    # Eight one-byte counters ride in each 64-bit lane; 255 rows can't overflow them.
    starts = [np.arange(s, s + n, 255) for s, n in zip(np.cumsum(sizes) - sizes, sizes)]
    lanes = np.take(votes.rows, np.concatenate(ids), axis=0).view(np.uint64)
    parts = np.add.reduceat(lanes, np.concatenate(starts), axis=0).view(np.uint8).astype(np.int32)
    pieces = np.array([len(s) for s in starts])
    counts = np.add.reduceat(parts, np.cumsum(pieces) - pieces, axis=0)
    return np.packbits(counts * 2 > sizes[:, None], axis=1).view(np.int64)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of each row; rows without doc_id or without any word have none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = WordVotes()
        for batch in batches:
            ids, found, at = batch.column(0).to_numpy(zero_copy_only=False), [], []
            block, size = batch.column(1), 0
            for i in range(len(block)):
                if ws := words(block[i].as_py()):
                    found.append(ws)
                    at.append(i)
                    size += len(ws)
                if found and (size > 200_000 or i == len(block) - 1):
                    fp = fingerprints(found, votes)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WORDS64))], ["doc_id", *FP])
                    found, at, size = [], [], 0

    tune_arrow(docs.sparkSession)
    return texts(docs).where("doc_id is not null and text is not null").mapInArrow(make, "doc_id long, " + ", ".join(f"{c} long" for c in FP))


def capture(distance: int, depth: int, bits: int = BITS) -> float:
    """The chance that two fingerprints so far apart go to the same list on each of so many strips."""
    g = distance / bits
    one = (1 - g) ** 6 + 6 * g * g * (1 - g) ** 5
    none = (1 - g) ** 7 + 7 * g * (1 - g) ** 6
    # A value within the ball of its centre lies at weight 0 once in 8; the partner must be in the same ball.
    return (none / 8 + one * 7 / 8) ** depth


def repeats(p: float, recall: float) -> int:
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def strips(rng: np.random.Generator, depth: int) -> list[tuple[np.ndarray, int]]:
    """So many strips of 7 coordinates that don't overlap, each with a shift."""
    at = rng.permutation(BITS)[: STRIP * depth].reshape(depth, STRIP)
    return [(a, int(rng.integers(128))) for a in at]


def strip_values(fp: np.ndarray, coords: np.ndarray, shift: int) -> np.ndarray:
    value = np.zeros(len(fp), np.uint64)
    for j, c in enumerate(coords):
        word, bit = divmod(int(c), 64)
        value |= ((fp[:, word] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j)
    return NEAREST[(value ^ np.uint64(shift)).astype(np.int64)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits by which each row of a differs from each row of b."""
    d = np.zeros((len(a), len(b)), np.uint16)
    for w in range(WORDS64):
        d += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return d


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of the rows a[i] and b[i]; root has each row's smallest one, and is changed in place."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root[:] = up


class Joined:
    """The components of rows, joined as near pairs come; pairs are held for a while, as a merge passes over all rows."""

    def __init__(self, fp: np.ndarray, most: int, root: np.ndarray) -> None:
        self.x, self.most, self.root = np.ascontiguousarray(fp.T), most, root
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0
        self.room = [np.empty(TILE, t) for t in (np.uint64, np.uint64, np.uint8, bool)]  # new ones for each tile take twice the time

    def settle(self) -> None:
        if self.held:
            merge(self.root, *(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.n_held = [], 0

    def lead(self, rows: np.ndarray) -> None:
        """A few leaders join what lies around them: a cluster of near copies is one component after a pass or two."""
        while len(rows) > LEAF_ROWS:
            near = np.bitwise_count(self.x[:, rows[:1]] ^ self.x[:, rows]).sum(axis=0) <= self.most
            merge(self.root, rows[near], np.full(near.sum(), rows[0]))
            if near.sum() * 16 < len(rows):
                break
            rows = rows[~near]

    def tiles(self, xa: np.ndarray, a: np.ndarray, xb: np.ndarray, b: np.ndarray, own: bool = False) -> None:
        """Compares the rows a with the rows b, whose words are xa and xb; own: a is b, and each pair is wanted once.

        Bits that differ in any word of a fingerprint are no more than those that differ: one count rules out most pairs."""
        high = max(1, min(len(a), TILE // min(max(1, len(b)), TILE_COLUMNS)))
        for s in range(0, len(a), high):
            ra, ya = a[s : s + high], xa[:, s : s + high, None]
            for e in range(s if own else 0, len(b), TILE_COLUMNS):
                rb, yb = b[e : e + TILE_COLUMNS], xb[:, e : e + TILE_COLUMNS]
                if len(rb) == TILE_COLUMNS and (self.root[rb] == self.root[ra[0]]).all() and (self.root[ra] == self.root[ra[0]]).all():
                    continue
                d, other, bits, close = (x[: len(ra) * len(rb)].reshape(len(ra), len(rb)) for x in self.room)
                np.bitwise_xor(ya[0], yb[0], out=d)
                for w in range(1, WORDS64):
                    np.bitwise_or(d, np.bitwise_xor(ya[w], yb[w], out=other), out=d)
                at = np.flatnonzero(np.less_equal(np.bitwise_count(d, out=bits), self.most, out=close))
                if not len(at):
                    continue
                i, j = np.divmod(at, len(rb))
                apart = self.root[ra[i]] != self.root[rb[j]]
                i, j = i[apart], j[apart]
                near = np.bitwise_count(ya[:, i, 0] ^ yb[:, j]).sum(axis=0) <= self.most
                self.held.append((ra[i[near]], rb[j[near]]))
                self.n_held += int(near.sum())
                if self.n_held > HELD or len(self.held) > 4096:
                    self.settle()

    def all_pairs(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> None:
        """As tiles, for rows in any order. Rows of one component stand together, so that whole tiles are joined already."""
        self.settle()
        a = a[np.argsort(self.root[a], kind="stable")]
        b = a if own else b[np.argsort(self.root[b], kind="stable")]
        if not (a.size and b.size):
            return
        plan = chunk_plan(self.x, a, b, self.most)
        if plan is None:
            self.tiles(np.take(self.x, a, 1), a, np.take(self.x, b, 1), b, own)
        for chunk, radius in plan or ():
            masks = MASKS[: np.searchsorted(MASK_BITS, radius, "right")]
            (xa, a1, at_a), (xb, b1, at_b) = (self.by_chunk(chunk, r) for r in (a, b))
            for v in np.flatnonzero(np.diff(at_a)):
                to = v ^ masks
                if own:
                    to = to[to >= v]
                low = at_b[to]
                n = at_b[to + 1] - low
                ends = np.cumsum(n)
                at = np.repeat(low - ends + n, n) + np.arange(ends[-1])
                here = slice(at_a[v], at_a[v + 1])
                self.tiles(xa[:, here], a1[here], np.take(xb, at, 1), b1[at])
        self.settle()

    def by_chunk(self, chunk: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and rows, sorted by a chunk of the fingerprint, and where each of its values begins."""
        value = chunk_values(self.x, chunk, rows)
        rows = rows[np.argsort(value, kind="stable")]
        return np.take(self.x, rows, 1), rows, np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << CHUNK))])


def chunk_values(x: np.ndarray, chunk: int, rows: np.ndarray) -> np.ndarray:
    word, part = divmod(chunk, 64 // CHUNK)
    return (x[word, rows] >> np.uint64(CHUNK * part)).astype(np.uint16)


def chunk_plan(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]] | None:
    """Chunks and radii, such that any pair within the distance has a chunk that differs by its radius at most; None where
    comparing all pairs is less work.

    If every chunk differed by more than its radius, the pair would differ by the sum of radii and the number of chunks,
    which is one more than the distance."""
    chunks = BITS // CHUNK
    radius, wider = divmod(most + 1 - chunks, chunks)
    all_pairs = len(a) * len(b)
    if all_pairs < INDEX_PAIRS or radius > MOST_RADIUS:
        return None
    counts = [tuple(np.bincount(chunk_values(x, c, r), minlength=1 << CHUNK) for r in (a, b)) for c in range(chunks)]
    order = np.argsort([np.dot(ca, cb) for ca, cb in counts])
    plan = [(int(c), radius + (k < wider)) for k, c in enumerate(order)]
    plan = [(c, r) for c, r in plan if r >= 0]
    work, every = 0, np.arange(1 << CHUNK)
    for c, r in plan:
        ca, cb = counts[c]
        work += BUCKET_PAIRS * np.count_nonzero(ca)
        for m in MASKS[: np.searchsorted(MASK_BITS, r, "right")]:
            work += int(np.dot(ca, cb[every ^ m]))
            if work > all_pairs:
                return None
    return plan


def join_leaf(fp: np.ndarray, rows: np.ndarray, most: int, root: np.ndarray) -> None:
    """Joins all rows of a list that lie within the distance, whatever its size, in memory of a tile and HELD pairs."""
    joined = Joined(fp, most, root)
    joined.lead(rows)
    joined.all_pairs(rows, rows, own=True)


def search_list(fp: np.ndarray, most: int = MAX_DISTANCE, recall: float = 0.95, seed: int = SEED) -> np.ndarray:
    """Of each row the smallest row of its component, within one list. The recursion goes to a fixed depth, so that the
    chance of finding a pair is known; what is left there, however uneven, is compared by brute force."""
    n = len(fp)
    depth = max(0, math.ceil(math.log(max(1, n / LEAF_ROWS), 16)))
    root = np.arange(n)
    rng = np.random.default_rng(seed)
    for _ in range(repeats(capture(most, depth), recall)):
        if not root.any():
            break  # all are one component
        key = np.zeros(n, np.int64)
        for coords, shift in strips(rng, depth):
            key = key * 16 + strip_values(fp, coords, shift)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in np.split(order, cuts):
            if len(rows) > 4 * LEAF_ROWS:
                join_leaf(fp, rows, most, root)
            elif len(rows) > 1:
                i, j = np.nonzero(np.triu(distances(fp[rows], fp[rows]) <= most, 1))
                apart = root[rows[i]] != root[rows[j]]
                held.append((rows[i[apart]], rows[j[apart]]))
                if sum(len(a) for a, _ in held[-64:]) > BLOCK or len(held) > 4096:
                    merge(root, *(np.concatenate(x) for x in zip(*held)))
                    held = []
        if held:
            merge(root, *(np.concatenate(x) for x in zip(*held)))
    return root


def _sorted_list(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A list by doc_id, so that the smallest row of a component is its smallest id; with ids and fingerprints."""
    table = table.sort_by("doc_id")
    return table, table.column("doc_id").to_numpy(), np.stack([table.column(c).to_numpy() for c in FP], axis=1).view(np.uint64)


def _links(ids: np.ndarray, root: np.ndarray) -> pa.Table:
    at = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": ids[at], "b": ids[root[at]]})


def near_edges(reps: DataFrame, n: int, most: int = MAX_DISTANCE, most_rows: int = MOST_ROWS) -> DataFrame:
    """Edges (a, b), a > b, that join all that lies within the distance, with no loss; reps has doc_id and n distinct fingerprints.

    Rows fall into pieces by a hash of their ids, and each pair of pieces is a task, so that no task gets more than about
    twice most_rows, however alike they are. A task gives a link for a row at most."""
    pieces = max(1, math.ceil(n / most_rows), min(PIECES, math.ceil(n / LIST_ROWS)))
    piece = F.pmod(F.xxhash64(F.lit(-1), "doc_id"), F.lit(pieces)).cast("int")
    task = lambda q: F.least("piece", q) * F.lit(pieces).cast("long") + F.greatest("piece", q)
    tasks = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), task)
    sent = reps.select("doc_id", *FP, piece.alias("piece")).withColumn("task", F.explode(tasks))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table, ids, fp = _sorted_list(table)
        joined = Joined(fp, most, np.arange(len(ids)))
        first, second = divmod(key[0].as_py(), pieces)
        of = table.column("piece").to_numpy()
        a = np.flatnonzero(of == first)
        joined.lead(np.arange(len(ids)))
        joined.all_pairs(a, a if first == second else np.flatnonzero(of == second), own=first == second)
        return _links(ids, joined.root)

    # Partitions by number aren't put together for being small: a task takes long for its bytes.
    parted = sent.repartition(min(pieces * (pieces + 1) // 2, math.ceil(max(1, n) / 1000)), "task")
    return parted.groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge that isn't its component's smallest, by large-star and small-star steps.

    Each step is one shuffle of the edges; a star of any size is sorted, not collected."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    sign = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    now = sign(e)
    while now[0]:
        both = e.union(e.select("b", "a"))
        w = Window.partitionBy("a")
        large = both.withColumn("m", F.least("a", F.min("b").over(w))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = F.min("b").over(w)
        small = large.withColumn("m", m).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = materialise(small)
        now, before = sign(e), now
        if now == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id) for each document that has a near duplicate; group_id is the smallest doc_id of the group.

    Documents with the same words, whatever their order and punctuation, are always in one group; so are rows that
    repeat a doc_id. Null or wordless texts and null doc_ids are in no group. A text of any length counts whole, by its
    distinct words. A cluster of any number of near copies, all tied, is one group. No pair within
    the distance is missed, see near_edges.
    An empty table gives an empty result. Other columns of docs are ignored."""
    fps = materialise(fingerprint_table(docs))
    same = fps.groupBy(*FP).agg(F.min("doc_id").alias("rep"))
    reps = materialise(same)
    edges = near_edges(reps.select(F.col("rep").alias("doc_id"), *FP), reps.count(), max_distance)
    members = fps.join(reps, FP).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # Exact copies are already stars: only their centres take part in the search for components, unless an id repeats.
    repeated = fps.groupBy("doc_id").agg(F.count_distinct(*FP).alias("n")).where("n > 1").select("doc_id")
    twice = fps.join(repeated, "doc_id", "left_semi").join(reps, FP).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    near = materialise(components(edges.unionByName(twice)))
    lost = members.join(near, F.col("b") == F.col("node"), "left").select(F.col("a").alias("doc_id"), F.coalesce("root", "b").alias("group_id"))
    lost = lost.unionByName(near.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))).groupBy("doc_id").agg(F.min("group_id").alias("group_id")).where("doc_id <> group_id")
    lost = materialise(lost)
    return lost.unionByName(lost.select(F.col("group_id").alias("doc_id"), "group_id").distinct())


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs, with of each group just the document of the smallest doc_id; all its columns.

    Documents in no group stay, null and empty texts too. Of rows that repeat a doc_id one stays, that of the smallest
    text; rows with a null doc_id all stay."""
    groups = near_duplicates(docs, **options)
    kept = without_keys(docs, groups.where("doc_id <> group_id").select("doc_id"))
    ids = docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id")
    repeated = materialise(ids)
    if not repeated.take(1):
        return kept
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    name = "__row_of_id"
    once = kept.join(repeated, "doc_id", "left_semi").withColumn(name, row).where(F.col(name) == 1).drop(name)
    return without_keys(kept, repeated).unionByName(once)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
