"""The induced lexicon: counts and walks against plain versions, what only the walk can find, and labelled documents."""

import math
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import toxicity
from spindrift.llm.common import materialise, words


def test_toxicity_on_labelled_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id for r in toxicity.find_toxic(docs, labels).collect()}
    known = labels.join(docs, "doc_id").select("doc_id", "toxic").collect()
    bad, good = {r.doc_id for r in known if r.toxic == 1}, {r.doc_id for r in known if r.toxic == 0}
    assert found and bad
    assert len(found & bad) >= 0.6 * len(bad) and len(found & good) <= 0.02 * len(good)


@pytest.mark.parametrize("n_docs, n_toxic", [(120, 40), (9000, 8)])
def test_toxic_terms_of_any_share(spark, n_docs, n_toxic):
    """Terms of a third of all documents, and terms of fewer than one in a thousand."""
    rng = np.random.default_rng(7)
    fill = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*rng.choice(fill, 25), *(["vilea", "vileb", "vilec"] if i < n_toxic else ["kinda", "kindb", "kindc"] if i < 400 and i % 2 else [])])) for i in range(n_docs)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i < n_toxic)) for i in range(min(n_docs, 400))], "doc_id long, toxic int")
    assert {r.doc_id for r in toxicity.find_toxic(texts, known).collect()} == set(range(n_toxic))


def test_walk_finds_terms_that_no_label_knows(spark):
    """vilex and viley are in no labelled document, but stand beside the seeds: documents that hold just them are found."""
    rng = np.random.default_rng(5)
    fill = [f"w{i}" for i in range(200)]

    def text(*terms):
        ws = list(rng.choice(fill, 30))
        for k, t in enumerate(terms):
            ws.insert(5 + k, t)
        return " ".join(ws)

    labelled = [(i, text("vilea", "vileb", "vilec")) for i in range(30)] + [(i, text("kinda", "kindb")) for i in range(30, 120)]
    beside = [(i, text("vilea", "vilex", "vileb", "viley", "vilec")) for i in range(200, 240)]
    alone = [(i, text("vilex", "viley")) for i in range(300, 320)]
    clean = [(i, text("kinda", "kindb")) for i in range(400, 500)]
    docs = spark.createDataFrame(labelled + beside + alone + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(120)], "doc_id long, toxic int")
    lexicon = toxicity.induce_lexicon(docs, labels)
    assert {"vilex", "viley"} <= lexicon.polarity.keys() and len(set(lexicon.polarity.values())) > 2
    found = {r.doc_id for r in toxicity.find_toxic(docs, labels).collect()}
    assert found == {*range(30), *range(200, 240), *range(300, 320)}


ROWS = [(1, "a b c a d"), (2, "b a"), (3, None), (4, ""), (5, "z a z b"), (6, "z a z b"), (None, "z a z b"), (7, "c")]


def plain_counts(rows):
    """Neighbours of each pair of words and of each word, of each text as often as it is distinct."""
    pairs, occurs = Counter(), Counter()
    for t in {t for _, t in rows if t is not None}:
        ws = words(t)
        for i, a in enumerate(ws):
            for j, b in enumerate(ws):
                if i != j and abs(i - j) <= toxicity.WINDOW:
                    occurs[a] += 1
                    if a != b:
                        pairs[a, b] += 1
    return pairs, occurs


def test_counts_by_brute_force(spark):
    pairs, occurs = plain_counts(ROWS)
    rows = toxicity.weighed(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3))
    assert {r.word: r.occurs for r in toxicity.word_occurrences(rows).collect()} == pytest.approx({**occurs, "c": occurs["c"]})
    got = {(r.a, r.b): r.n for r in toxicity.neighbour_counts(rows, ["a", "z", "none"]).collect()}
    assert got == pytest.approx({k: n for k, n in pairs.items() if k[0] in "az"})


def test_walks_by_dense_power_iteration(spark, monkeypatch):
    """With nothing too small to be passed on, the rings cover the graph: the same as iterating over a dense matrix."""
    monkeypatch.setattr(toxicity, "PASSED_ON", 0.0)
    monkeypatch.setattr(toxicity, "RINGS", 8)
    monkeypatch.setattr(toxicity, "LEAST", 1e-9)
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(25)]
    data = [(i, " ".join(vocabulary[int(x)] for x in (rng.integers(0, 25) + rng.integers(0, 4, 12)) % 25)) for i in range(60)]
    pairs, occurs = plain_counts(data)
    seeds = (["v0", "v1", "v2"], ["v12", "v13"])
    w, total = np.zeros((25, 25)), sum(occurs.values())
    at = {v: i for i, v in enumerate(vocabulary)}
    for (a, b), n in pairs.items():
        least = n - toxicity.EDGE_Z * math.sqrt(n)
        if least > 0:
            w[at[a], at[b]] = max(0.0, math.log(least * total / (occurs[a] * occurs[b])))
    step = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
    want = {}
    for kind, own in zip(("toxic", "clean"), seeds):
        logs = []
        for k in (0, 1):
            start = np.zeros(25)
            start[[at[v] for v in own[k::2]]] = 1 / len(own[k::2])
            p = np.linalg.solve(np.eye(25) - toxicity.GO_ON * step.T, (1 - toxicity.GO_ON) * start)
            logs.append(np.log(np.maximum(p, toxicity.LEAST)))
        want[kind] = np.exp(np.mean(logs, axis=0))
    rows = toxicity.weighed(spark.createDataFrame(data, "doc_id long, text string"))
    got = toxicity.walks(rows, materialise(toxicity.word_occurrences(rows)), seeds).set_index("word")
    assert len(got) == 25
    for kind, x in want.items():
        assert got[kind].loc[vocabulary].to_numpy() == pytest.approx(x, rel=1e-5)
