"""Clusters of near copies that are larger than a task may hold: the same components as by brute force, in bounded memory."""

import numpy as np
import pytest

from spindrift.llm import simhash


def cluster(rng, n, flips):
    """n fingerprints, each so many random bits away from a common one."""
    x = np.repeat(rng.integers(0, 1 << 63, (1, simhash.WORDS64), dtype=np.uint64), n, axis=0)
    for r in x:
        for b in rng.permutation(simhash.BITS)[:flips]:
            r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return np.unique(x, axis=0)


def brute_components(x, most=simhash.MAX_DISTANCE):
    root = np.arange(len(x))
    near = simhash.distances(x, x) <= most
    while True:
        low = np.where(near, root[None, :], len(x)).min(axis=1)
        if (low == root).all():
            return root
        root = low


def test_large_cluster_of_near_copies():
    x = cluster(np.random.default_rng(4), 50_000, 10)
    assert not simhash.search_list(x).any()


@pytest.mark.parametrize("flips", [20, 26])
def test_list_of_any_shape(flips):
    """With 26 flips many pairs lie beyond the distance, and components are chains of neighbours."""
    rng = np.random.default_rng(flips)
    x = np.concatenate([cluster(rng, 900, flips), cluster(rng, 300, flips), rng.integers(0, 1 << 63, (500, simhash.WORDS64), dtype=np.uint64)])
    root = np.arange(len(x))
    simhash.join_leaf(x, np.arange(len(x)), simhash.MAX_DISTANCE, root)
    assert (root == brute_components(x)).all()


def test_crowded_lists_are_split_without_loss(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([cluster(rng, 120, 12), cluster(rng, 60, 27), rng.integers(0, 1 << 63, (40, simhash.WORDS64), dtype=np.uint64)])
    x = x[rng.permutation(len(x))]
    want = brute_components(x)
    rows = [(i, *(int(v) for v in f.view(np.int64))) for i, f in enumerate(x)]
    reps = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in simhash.FP))
    for most_rows in (7, 50, 1000):
        edges = simhash.near_edges(reps, len(rows), most_rows=most_rows)
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        assert got == {i: int(r) for i, r in enumerate(want) if r != i}, most_rows


def at_distance(rng, rows, bits):
    """The rows, each with so many random bits flipped."""
    x = rows.copy()
    for r in x:
        for b in rng.permutation(simhash.BITS)[:bits]:
            r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return x


def test_no_pair_at_the_largest_distance_is_missed(spark):
    """Pairs that meet the threshold just so are all found, and those one bit further apart are not."""
    rng = np.random.default_rng(48)
    base = rng.integers(0, 1 << 63, (1500, simhash.WORDS64), dtype=np.uint64)
    x = np.concatenate([base, at_distance(rng, base[:600], simhash.MAX_DISTANCE), at_distance(rng, base[600:900], simhash.MAX_DISTANCE + 1)])
    rows = [(i, *(int(v) for v in f.view(np.int64))) for i, f in enumerate(x)]
    reps = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in simhash.FP))
    for most_rows in (1_000, 10_000):
        got = {(r.a, r.b) for r in simhash.near_edges(reps, len(rows), most_rows=most_rows).collect()}
        assert got == {(1500 + i, i) for i in range(600)}, most_rows


@pytest.mark.parametrize("most", [10, 48, 60])
def test_chunks_miss_no_pair(monkeypatch, most):
    """By chunks the components are those by brute force, for a list with itself and for two lists."""
    monkeypatch.setattr(simhash, "INDEX_PAIRS", 0)
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 0)
    rng = np.random.default_rng(most)
    base = rng.integers(0, 1 << 63, (500, simhash.WORDS64), dtype=np.uint64)
    x = np.concatenate([base, at_distance(rng, base[:200], most), at_distance(rng, base[:200], most // 2), cluster(rng, 100, 4)])
    every = np.arange(len(x))
    assert simhash.chunk_plan(np.ascontiguousarray(x.T), every, every, most)
    root = every.copy()
    simhash.Joined(x, most, root).all_pairs(every, every, own=True)
    assert (root == brute_components(x, most)).all()
    root = every.copy()
    simhash.Joined(x, most, root).all_pairs(every[500:], every[:500])
    assert (root[500:700] == np.arange(200)).all() and (root[700:900] == np.arange(200)).all() and (root[900:] >= 900).all()


def test_links_between_neighbours_of_neighbours(spark):
    """A chain, each text 40 bits from the next and further from all others, is one component, however small the pieces."""
    bits = np.zeros((7, simhash.BITS), np.uint8)
    for i in range(7):
        bits[i, : 40 * i] = 1
    x = np.packbits(bits, axis=1).view(np.int64)
    reps = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(x)], "doc_id long, " + ", ".join(f"{c} long" for c in simhash.FP))
    for most_rows in (2, 3, 100):
        got = {r.node: r.root for r in simhash.components(simhash.near_edges(reps, len(x), most_rows=most_rows)).collect()}
        assert got == dict.fromkeys(range(1, 7), 0), most_rows
