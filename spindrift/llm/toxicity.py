"""Toxic documents by an induced lexicon.

Seed terms come from labelled documents: words far more, or far less, frequent in toxic ones. Over all documents, a graph
joins words that occur near each other, with their positive pointwise mutual information as weight: at the lower bound of
what the count allows, EDGE_Z deviations below it, so that chance neighbours of rare words are no edges. Random walks that
start again from the toxic seeds, and others from the clean ones, give each word two probabilities; the log of their
ratio, averaged with that of the word's rates in the labelled documents, is its polarity. A document's score is the sum of its words' polarities over the root of its length. The labelled
documents choose the least polarity that counts and the threshold.

The graph isn't built whole, since its size grows with the corpus: of each word that a walk reaches with a probability of
at least PASSED_ON, all neighbours are counted, in one pass over all documents for the seeds and one for each further
ring of such words, RINGS passes at most. There are at most 4 / PASSED_ON such words a pass, for the four walks. Elsewhere what arrives stays:
so each probability is exact to within what less than PASSED_ON at a word could have passed on. A probability below LEAST
is as good as none, so at most 4 / LEAST words have a polarity, whatever the size of the corpus.

No word is left out for being rare or common. Of n rows of the same text each counts as 1/n. Only the labelled rows to fit
on are a sample, of FIT_ROWS at most, first by a hash of their id. Near copies among them count once: a document copied a
thousand times would otherwise make all its words look like its label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, sized, texts, tune_arrow, words
from .simhash import FP, fingerprint_table, search_list

FIT_ROWS = 20_000
#: Places between two words that count as neighbours, and deviations that a pair's count is lowered by.
WINDOW = 3
EDGE_Z = 1.0
#: Chance that a walk goes on.
GO_ON = 0.5
PASSED_ON, RINGS, LEAST = 2e-3, 3, 1e-5
#: A seed's signed root of the likelihood ratio, its rate in toxic documents against that in clean ones, and toxic documents.
SEED_Z, SEED_RATIO, SEED_DOCS = 3.3, 8.0, 3
#: Clean seeds: the strongest, as many as toxic ones, but so many at least.
CLEAN_SEEDS = 10
#: Least polarities that the labelled documents choose from, as shares of the strongest.
CUTOFFS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85)
#: Labelled documents that the walks count for, where a word's polarity by them and its rates by label are averaged.
WALK_DOCS = 5
COUNTED = 400_000


@dataclass
class Lexicon:
    """Polarity by word, and the score from which a document counts as toxic."""

    polarity: dict[str, float]
    threshold: float = float("inf")

    def score(self, found: list[str]) -> float:
        if not found or self.polarity.keys().isdisjoint(found):
            return 0.0
        get = self.polarity.get
        return sum(get(w, 0.0) for w in found) / len(found) ** 0.5


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic) of the labelled documents to fit on, one of each group of near copies; at most fit_rows, kept."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    fps = fingerprint_table(texts(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    rows = fps.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", *FP]).drop_duplicates("doc_id")
    keep = np.zeros(len(rows), bool)
    for toxic in (0, 1):
        at = np.flatnonzero(rows.toxic.to_numpy() == toxic)
        if len(at):
            root = search_list(np.ascontiguousarray(rows[FP].to_numpy()[at]).view(np.uint64))
            keep[at[root == np.arange(len(at))]] = True
    return docs.sparkSession.createDataFrame(rows.loc[keep, ["doc_id", "toxic"]], "doc_id long, toxic int")


def sample_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): the documents of the sample that each word is in, by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in batches:
            for t, label in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[label].update(set(words(t.as_py())))
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in reversed(seen))], ["word", "toxic", "clean"])

    tune_arrow(docs.sparkSession)
    rows = texts(docs).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    return rows.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def root_of_ratio(t: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed root of the log-likelihood ratio of a word's rates in toxic and clean documents."""
    p = (t + c) / (n_toxic + n_clean)
    part = lambda seen, of: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(of, 1e-9)), 0.0)
    g = part(t, n_toxic * p) + part(n_toxic - t, n_toxic * (1 - p)) + part(c, n_clean * p) + part(n_clean - c, n_clean * (1 - p))
    return np.sqrt(np.maximum(2 * g, 0)) * np.sign(t / n_toxic - c / n_clean)


def seed_terms(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """Toxic and clean seeds, by word. Only what may be a seed is sent to the driver: the sample bounds its vocabulary."""
    v = counts.where((F.col("toxic") >= SEED_DOCS) | (F.col("clean") >= SEED_DOCS)).toPandas().sort_values("word").reset_index(drop=True)
    t, c = v.toxic.to_numpy(float), v.clean.to_numpy(float)
    z = root_of_ratio(t, c, n_toxic, n_clean)
    ratio = (t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1))
    toxic = np.flatnonzero((z >= SEED_Z) & (t >= SEED_DOCS) & (ratio >= SEED_RATIO))
    low = np.argsort(z, kind="stable")[: max(CLEAN_SEEDS, len(toxic))]
    return v.word[toxic].tolist(), v.word[low[z[low] < 0]].tolist()


def weighed(docs: DataFrame) -> DataFrame:
    """(text, n): the rows with a text, and how many have the same one, null for 1. Texts are compared by 128 bits of hashes."""
    hashed = texts(docs).where("text is not null").withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})
    copied = materialise(hashed.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1"))
    return hashed.join(sized(copied), ["h", "g"], "left").select("text", "n")


def word_occurrences(rows: DataFrame) -> DataFrame:
    """(word, occurs): how many neighbours each word has in all, over the rows of weighed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, rest = Counter(), Counter()

        def send() -> pa.RecordBatch:
            keys = list(once.keys() | rest.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([2 * WINDOW * once[k] + rest[k] for k in keys], pa.float64())], ["word", "occurs"])
            once.clear()
            rest.clear()
            return out

        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1).to_pylist()):
                if not (ws := words(t.as_py())):
                    continue
                part = 1 / (n or 1)
                if n is None:
                    once.update(ws)
                else:
                    for w in ws:
                        rest[w] += 2 * WINDOW * part
                for i in range(min(WINDOW, len(ws))):  # less at both ends of a text
                    rest[ws[i]] -= (WINDOW - i) * part
                    rest[ws[-1 - i]] -= (WINDOW - i) * part
            if len(once) + len(rest) > COUNTED:
                yield send()
        yield send()

    tune_arrow(rows.sparkSession)
    return rows.mapInArrow(count, "word string, occurs double").groupBy("word").agg(F.sum("occurs").alias("occurs"))


def neighbour_counts(rows: DataFrame, ring: list[str]) -> DataFrame:
    """(a, b, n): how often a word b is at most WINDOW places from a word a of the ring, another one."""
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(ring))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = sent.value, Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.string()), pa.array(seen.values(), pa.float64())], ["a", "b", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1).to_pylist()):
                ws = words(t.as_py())
                if own.isdisjoint(ws):
                    continue
                part = 1 / (n or 1)
                for i, a in enumerate(ws):
                    if a in own:
                        for b in ws[max(0, i - WINDOW) : i + WINDOW + 1]:
                            if b != a:
                                seen[a, b] += part
                if len(seen) > COUNTED:
                    yield send()
        yield send()

    tune_arrow(rows.sparkSession)
    return rows.mapInArrow(count, "a string, b string, n double").groupBy("a", "b").agg(F.sum("n").alias("n"))


def edges_of(rows: DataFrame, occurs: DataFrame, ring: list[str], all_pairs: float) -> DataFrame:
    """(a, b, w), kept: the edges of the words of the ring, and their weights."""
    spark = rows.sparkSession
    least = F.col("n") - EDGE_Z * F.sqrt("n")
    pairs = neighbour_counts(rows, ring).where(least > 0).withColumn("least", least)
    own = occurs.join(F.broadcast(spark.createDataFrame([(w,) for w in ring], "word string")), "word", "left_semi")
    pairs = pairs.join(F.broadcast(own.select(F.col("word").alias("a"), F.col("occurs").alias("of_a"))), "a")
    weight = F.log(F.col("least") * all_pairs / (F.col("of_a") * F.col("occurs")))
    return materialise(pairs.join(occurs.withColumnRenamed("word", "b"), "b").select("a", "b", weight.alias("w")).where("w > 0"))


def stay(starts: np.ndarray, size: int, at: np.ndarray, to: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Probabilities of the known words: what starts there and what comes from known ones; a column a walk."""
    p = (1 - GO_ON) * starts
    for _ in range(60):  # what is still under way then is GO_ON to that power
        p, before = (1 - GO_ON) * starts, p
        for k in range(starts.shape[1]):
            p[:, k] += GO_ON * np.bincount(to, before[at, k] * share, size)
    return p


def walks(rows: DataFrame, occurs: DataFrame, seeds: tuple[list[str], list[str]]) -> pd.DataFrame:
    """(word, toxic, clean): the probabilities that walks from either kind of seeds are at a word.

    Each kind has two walks, from every other one of its seeds, and their geometric mean counts: what just one seed leads
    to, by a chance neighbourhood, is as good as not reached. A walk's probability below LEAST counts as LEAST."""
    starting = [own[k::2] or own for own in seeds for k in (0, 1)]
    names = [f"p{k}" for k in range(len(starting))]
    spark = rows.sparkSession
    all_pairs = float(occurs.agg(F.sum("occurs")).first()[0] or 1)
    known, edges, ring = [], None, sorted({*seeds[0], *seeds[1]})
    for k in range(RINGS):
        known += ring
        place = {w: i for i, w in enumerate(known)}
        more = edges_of(rows, occurs, ring, all_pairs)
        edges = more if edges is None else edges.unionByName(more)
        out = {r.a: r.w for r in edges.groupBy("a").agg(F.sum("w").alias("w")).collect()}
        inner = edges.join(F.broadcast(spark.createDataFrame([(w,) for w in known], "b string")), "b", "left_semi").toPandas()
        starts = np.zeros((len(known), len(starting)))
        for j, own in enumerate(starting):
            starts[[place[w] for w in own], j] = 1 / len(own)
        at, to = (np.array([place[w] for w in inner[c]], np.int64) for c in "ab")
        p = stay(starts, len(known), at, to, inner.w.to_numpy(float) / np.array([out[a] for a in inner.a], float) if len(inner) else np.zeros(0))
        sent = spark.createDataFrame([(w, *(GO_ON * x / out[w] for x in p[i].tolist())) for w, i in place.items() if w in out], "a string, " + ", ".join(f"{c} double" for c in names))
        mass = edges.join(F.broadcast(sent), "a").groupBy(F.col("b").alias("word")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
        reached = mass.where(F.greatest(*names) >= LEAST).toPandas()
        reached = reached[~reached.word.isin(place)]
        ring = sorted(reached.word[reached[names].max(axis=1) >= PASSED_ON])
        if not ring:
            break
    out = pd.concat([pd.DataFrame(p, columns=names).assign(word=known), reached], ignore_index=True)
    logs = np.log(np.maximum(out[names].to_numpy(float), LEAST))
    return pd.DataFrame({"word": out.word, "toxic": np.exp(logs[:, :2].mean(axis=1)), "clean": np.exp(logs[:, 2:].mean(axis=1))})


def induce_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """The lexicon of a corpus. Without labels of both kinds, or without seeds of both, it is empty."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, fit_rows)
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Lexicon({})
    counts = materialise(sample_counts(docs, sample))
    seeds = seed_terms(counts, sizes[1], sizes[0])
    if not all(seeds):
        return Lexicon({})
    rows = weighed(docs)
    v = walks(rows, materialise(word_occurrences(rows)), seeds)
    v["polarity"] = np.log(v.toxic / v.clean)
    v = v[v.polarity > 0]
    own = spark.createDataFrame([(w,) for w in v.word], "word string")
    v = v.merge(counts.join(F.broadcast(own), "word", "left_semi").toPandas(), "left", "word").fillna({"toxic_y": 0, "clean_y": 0})
    t, c = v.toxic_y.to_numpy(float), v.clean_y.to_numpy(float)
    rate = np.log((t + 0.5) / (sizes[1] + 1)) - np.log((c + 0.5) / (sizes[0] + 1))
    v["polarity"] = (WALK_DOCS * v.polarity + (t + c) * rate) / (WALK_DOCS + t + c)
    return fitted(docs, sample, {w: x for w, x in zip(v.word, v.polarity.tolist()) if x > 0})


def fitted(docs: DataFrame, sample: DataFrame, polarity: dict[str, float]) -> Lexicon:
    """Of the lexicons by least polarity, the one that parts the sample's documents best; the larger one of equals."""
    if not polarity:
        return Lexicon({})
    top = max(polarity.values())
    by_cutoff = [Lexicon({w: x for w, x in polarity.items() if x >= cut * top}) for cut in CUTOFFS]
    sent = docs.sparkSession.sparkContext.broadcast(by_cutoff)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([[x.score(ws) for x in sent.value] for ws in found], pa.list_(pa.float64())), batch.column(1)], ["scores", "toxic"])

    known = texts(docs).join(F.broadcast(sample), "doc_id").select("text", "toxic").mapInArrow(score, "scores array<double>, toxic int").toPandas()
    toxic = known.toxic.to_numpy()
    fits = [best_threshold(np.array([x[k] for x in known.scores], float), toxic) for k in range(len(CUTOFFS))]
    best = min(range(len(CUTOFFS)), key=lambda k: fits[k][0])
    return Lexicon(by_cutoff[best].polarity, fits[best][1])


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The least balanced error, and midway between two scores the one that parts the labels so; above 0 always."""
    cuts = np.unique(score[score > 0])
    if not len(cuts):
        return 1.0, math.inf
    cuts = np.concatenate([[0.0], cuts])
    mids = np.concatenate([(cuts[:-1] + cuts[1:]) / 2, [cuts[-1] + 1]])
    pos, neg = np.sort(score[toxic == 1]), np.sort(score[toxic == 0])
    error = np.searchsorted(pos, mids) / max(1, len(pos)) + 1 - np.searchsorted(neg, mids) / max(1, len(neg))
    return float(error.min()), float(mids[error.argmin()])


def scores(docs: DataFrame, lexicon: Lexicon, least: float | None = None) -> DataFrame:
    """(doc_id, score) of each row, or of those that reach a least score."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([sent.value.score(words(t.as_py())) for t in batch.column(1)], float)
            keep = np.ones(len(x), bool) if least is None else x >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(x[keep])], ["doc_id", "score"])

    tune_arrow(docs.sparkSession)
    return texts(docs).mapInArrow(score, "doc_id long, score double")


def find_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score) of the rows of docs that count as toxic.

    Each row is scored by itself: repeated rows are all reported and a null doc_id is kept. Null, empty and wordless
    texts score 0 and are never toxic; a text of any length is scored whole. Without labels of both kinds, or without words
    that tell them apart, nothing is. An empty table gives an empty result; other columns, and labels of other documents, are
    ignored."""
    lexicon = induce_lexicon(docs, labels, fit_rows)
    return scores(docs, lexicon, lexicon.threshold if lexicon.polarity else float("inf"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_toxic(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
