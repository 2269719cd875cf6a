"""Document quality by a sparse rule ensemble.

Statistics of a text are Spark expressions. On labelled documents, shallow trees are boosted over them; every path from
a root becomes a rule, a conjunction of bounds on statistics; a lasso logistic regression on the rules leaves a few with
weights; and those are compiled into one Spark expression, so scoring runs in the JVM, in the scan's own stage.

The only sample is of the rows to fit on: FIT_ROWS labelled documents at most, those first by a hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts

FIT_ROWS = 20_000
TREES = 24
DEPTH = 3
BINS = 32
LASSO = 2e-3
SEED = 104_729


def _left(text: Column, pattern: str) -> Column:
    """How many characters the pattern takes away."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def _with(value: Column, make) -> Column:
    """make(value), with the value computed once however often make uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), make), 0)


STATISTICS = ["chars", "words", "mean_word", "distinct_words", "symbols", "upper", "digits", "stops", "lines", "distinct_lines"]


def statistics(text: Column) -> Column:
    """A struct of STATISTICS; shares where they are counts of parts.

    One regular expression goes over the text; the others over what it leaves, which has no small letters."""
    n = lambda a: F.size(a).cast("double")

    def distinct(a: Column) -> Column:
        return F.struct(n(a).alias("n"), (n(F.array_distinct(a)) / n(a)).alias("d"))

    parts = F.struct(
        F.length(text).cast("double").alias("chars"),
        _with(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), distinct).alias("w"),
        _with(F.split(text, "\n"), distinct).alias("l"),
        F.regexp_replace(text, "[\\p{Ll}\\p{Lo}\\s]+", "").alias("rest"),
    )
    return _with(
        parts,
        lambda p: F.struct(
            p["chars"].alias("chars"),
            p["w"]["n"].alias("words"),
            (p["chars"] / p["w"]["n"]).alias("mean_word"),
            p["w"]["d"].alias("distinct_words"),
            (_left(p["rest"], "[#$%&*|<>{}\\[\\]=~^\\\\]+") / p["chars"]).alias("symbols"),
            (_left(p["rest"], "\\p{Lu}+") / p["chars"]).alias("upper"),
            (_left(p["rest"], "\\d+") / p["chars"]).alias("digits"),
            (_left(p["rest"], "[.!?]+") / p["w"]["n"]).alias("stops"),
            p["l"]["n"].alias("lines"),
            p["l"]["d"].alias("distinct_lines"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics, all of which must hold: (statistic, above or not, bound)."""

    bounds: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, bound in self.bounds:
            out &= (x[:, f] > bound) == above
        return out

    def column(self, s: Column) -> Column:
        out = None
        for f, above, bound in self.bounds:
            c = s[STATISTICS[f]] > bound if above else s[STATISTICS[f]] <= bound
            out = c if out is None else out & c
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))

    def column(self, text: Column) -> Column:
        def total(s: Column) -> Column:
            out = F.lit(self.bias)
            for r, w in self.rules:
                out = out + F.when(r.column(s), F.lit(w)).otherwise(F.lit(0.0))
            return out

        return _with(statistics(text), total)


def _tree(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, features: np.ndarray, bounds: tuple, paths: list, out: np.ndarray) -> None:
    """Splits rows by the best gain; paths gets every rule on the way and out the leaves' values."""
    best = (1e-6, None)
    if len(bounds) < DEPTH and len(rows) >= 20:
        G, H = g[rows].sum(), h[rows].sum()
        for f in features:
            k = len(edges[f]) + 1
            gs = np.bincount(binned[rows, f], g[rows], k)[:-1].cumsum()
            hs = np.bincount(binned[rows, f], h[rows], k)[:-1].cumsum()
            gain = np.where((hs > 1) & (H - hs > 1), gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        out[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    f, cut = best[1]
    left = binned[rows, f] <= cut
    for above, part in ((False, rows[left]), (True, rows[~left])):
        now = (*bounds, (int(f), above, float(edges[f][cut])))
        paths.append(Rule(now))
        _tree(x, edges, binned, g, h, part, features, now, paths, out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights, by accelerated proximal gradient; the bias isn't penalised."""
    a = np.concatenate([np.ones((len(m), 1)), m], axis=1)
    rate = 4 * len(a) / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w, v, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(steps):
        z = v - rate * (a.T @ (_sigmoid(a @ v) - y)) / len(a)
        z[1:] = np.sign(z[1:]) * np.maximum(np.abs(z[1:]) - rate * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v = z + (before - 1) / t * (z - w)
        w = z
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = LASSO, seed: int = SEED) -> RuleEnsemble:
    """x: STATISTICS by row; y: 0 or 1. With one class only, an ensemble without rules, which keeps every document."""
    if len(x) == 0 or y.min() == y.max():
        return RuleEnsemble(1.0, ())
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    z, paths = np.zeros(len(y)), []
    for _ in range(TREES):
        p = _sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        features = np.sort(rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)])
        step, own = np.zeros(len(y)), []
        _tree(x, edges, binned, p - y, p * (1 - p), rows, features, (), own, step)
        paths += own
        z += 0.3 * step
    rules = list(dict.fromkeys(paths))
    held = np.stack([r.holds(x) for r in rules], axis=1)
    _, first = np.unique(held, axis=1, return_index=True)  # rules that hold for the same rows count once
    first = np.sort(first)
    bias, w = lasso_logistic(held[:, first].astype(float), y.astype(float), penalty)
    return RuleEnsemble(bias, tuple((rules[i], float(v)) for i, v in zip(first, w) if abs(v) > 1e-6))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the documents to fit on. An id's label is the majority of its rows, ties counting as 1."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded by fit_rows, so it can be sent
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").where(F.col("text").rlike(r"\S")).select("doc_id", "quality", statistics(F.col("text")).alias("s")).select("doc_id", "quality", "s.*").toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS]).drop_duplicates()
    return rows[STATISTICS].to_numpy(float), rows.quality.to_numpy(int)


def quality_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    return fit_rules(*training_rows(docs, labels, fit_rows))


def quality_column(model: RuleEnsemble, text: Column) -> Column:
    """The score of a text, a log odds; null where the text is null or blank."""
    t = text.cast("string")
    return F.when(t.rlike(r"\S"), model.column(t))


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    return texts(docs).select("doc_id", quality_column(quality_model(docs, labels, fit_rows), F.col("text")).alias("score"))


def keep_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose score is at least 0, with all their columns.

    Null and blank texts are rejected. Each row is judged by itself: repeated rows and null doc_ids stay if their text
    is good. Labels of other documents, null labels and repeated ones do no harm; without labels of both kinds every
    text that isn't blank stays. An empty table gives an empty result."""
    return docs.where(quality_column(quality_model(docs, labels, fit_rows), F.col("text")) >= 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, each with its score."""
    docs = read_table(spark, sf_dir, "documents")
    score = quality_column(quality_model(docs, read_table(spark, sf_dir, "labels")), F.col("text"))
    # The score is computed once: a filter on it would be pushed below and repeat it.
    return texts(docs).select("doc_id", F.explode(F.filter(F.array(score), lambda s: s >= 0)).alias("score"))
