"""Toxicity by a classifier chain over words and word stems.

Categories are predicted one after the other; each later linear model also
sees the probabilities of the categories before it. While training, those
probabilities are out-of-fold: a row's value comes from a model that has not
seen the row, so later models learn what earlier ones are worth on new text.

The table labels only overall toxicity. The categories before it are its
parts by a small seed list: a toxic text that uses one of the seeds.

A text's features are its distinct words in lower case and their stems of
``STEMS`` characters. The features with most evidence in the labelled sample
are kept, so a model is a short table of weights that every task holds. How
much evidence is enough depends on the sample, so the floor is the one whose
features, chosen and weighed without a fold, lose least on that fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, need, ship_package, stored

#: Labelled texts at most that the chain is trained on, and features at most that it weighs.
MAX_LABELLED = 20_000
MAX_FEATURES = 2_000
#: Least log-likelihood ratios of a feature to choose from, by held-out loss (ties: the first).
FLOORS = (30.0, 20.0, 15.0, 12.0, 10.0, 8.0)
STEMS = (4, 5, 6)
FOLDS = 5
#: Texts over this probability of the label count as toxic.
THRESHOLD = 0.3
#: Distinct words whose features a worker remembers, and entries of a task's partial counts.
MEMO_WORDS = 200_000
#: Category -> seed words; the last category of the chain is the label itself.
CATEGORIES = {
    "insult": ("idiot", "moron", "loser", "clown", "scum"),
    "contempt": ("pathetic", "worthless", "disgusting", "stupid", "trash"),
}
LABEL = "toxic"
CHAIN = (*CATEGORIES, LABEL)
_TOKEN = re.compile(r"\w+")


def words(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def word_features(word: str) -> list[str]:
    """The word, and its stems marked with a star."""
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


def text_features(text: str) -> set[str]:
    return {f for w in words(text) for f in word_features(w)}


# ---- linear models on sparse rows -------------------------------------------------------
class Rows:
    """Sparse 0/1 rows (lists of column numbers) and dense columns beside them."""

    def __init__(self, indices: list[list[int]], n_features: int, dense: np.ndarray | None = None):
        self.n, self.n_features = len(indices), n_features
        self.row = np.repeat(np.arange(self.n), [len(x) for x in indices])
        self.col = np.array([j for x in indices for j in x], dtype=np.int64)
        self.dense = np.zeros((self.n, 0)) if dense is None else dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        k = self.n_features
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ w[k:-1] + w[-1]

    def gradient(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, r[self.row], self.n_features), self.dense.T @ r, [r.sum()]])


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def fit_linear(x: Rows, y: np.ndarray, weight: np.ndarray, *, l2: float = 1e-5, steps: int = 300) -> np.ndarray:
    """Logistic regression by accelerated gradient descent with backtracking-free
    diagonal scaling (each weight's step follows how often its feature occurs)."""
    total = weight.sum()
    w = np.zeros(x.n_features + x.dense.shape[1] + 1)
    if not (weight * y).any():
        w[-1] = -20.0           # nothing is labelled with the category: nothing has it
        return w
    hits = np.bincount(x.row, minlength=x.n) + (x.dense != 0).sum(axis=1) + 1.0
    scale = x.gradient(weight * hits * 0.25) / total            # bounds the curvature of each weight
    scale = np.maximum(np.where(np.arange(len(w)) < x.n_features, scale, np.maximum(scale, 0.25 * hits.mean())),
                       1e-6) + l2
    decay = np.full(len(w), l2)
    decay[-1] = 0.0
    v, t = w.copy(), 1.0
    for _ in range(steps):
        g = x.gradient(weight * (sigmoid(x.dot(v)) - y)) / total + decay * v
        new, t_new = v - g / scale, (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


@dataclass
class Chain:
    """features[f] = column; weights[k] = sparse weights, weights of the
    earlier categories' probabilities, bias."""
    features: dict[str, int]
    weights: list[np.ndarray]

    def probabilities(self, indices: list[list[int]]) -> np.ndarray:
        x = Rows(indices, len(self.features))
        for w in self.weights:
            x.dense = np.column_stack([x.dense, sigmoid(x.dot(w))])
        return x.dense


def class_weights(y: np.ndarray) -> np.ndarray:
    """Toxic texts are few: one weighs as the root of the others' number to theirs."""
    return np.where(y > 0, (max(1.0, len(y) - y.sum()) / max(1.0, y.sum())) ** 0.5, 1.0)


def best_floor(indices: list[list[int]], y: np.ndarray, fold: np.ndarray,
               candidates: list[list[tuple[float, int]]], **options) -> float:
    """The floor with the least held-out loss. ``candidates[k]`` are the
    (evidence, column) that the texts outside of fold k give, strongest first."""
    best, done = (math.inf, FLOORS[0]), {}
    for floor in FLOORS:
        loss = 0.0
        for k, found in enumerate(candidates):
            kept = [j for e, j in found if e >= floor]
            if (k, len(kept)) not in done:
                out, place = fold == k, {j: i for i, j in enumerate(kept)}
                x = Rows([[place[j] for j in row if j in place] for row in indices], len(kept))
                w = fit_linear(x, y, class_weights(y) * ~out, **{"steps": 100, **options})
                p = sigmoid(x.dot(w))[out].clip(1e-3, 1 - 1e-3)
                done[k, len(kept)] = -(y[out] * np.log(p) + (1 - y[out]) * np.log(1 - p)).sum()
            loss += done[k, len(kept)]
        if loss < best[0] - 1e-9:
            best = (loss, floor)
    return best[1]


def train_chain(indices: list[list[int]], targets: np.ndarray, features: dict[str, int], *,
                folds: int = FOLDS, **options) -> Chain:
    """``targets`` has one 0/1 column per category of the chain."""
    n = len(indices)
    fold = np.arange(n) % folds
    x = Rows(indices, len(features))
    weights = []
    for k in range(targets.shape[1]):
        y = targets[:, k].astype(float)
        even = class_weights(y)
        w = fit_linear(x, y, even, **options)
        # a text without any feature is not likelier to have the category than any text of the sample
        share = (y.sum() + 0.5) / (n + 1)
        w[-1] = min(w[-1], math.log(share / (1 - share)))
        weights.append(w)
        if k + 1 < targets.shape[1]:                     # out-of-fold input of the later models
            held = np.zeros(n)
            for f in range(folds):
                out = fold == f
                held[out] = sigmoid(x.dot(fit_linear(x, y, even * ~out, **options)))[out]
            x.dense = np.column_stack([x.dense, held])
    return Chain(features, weights)


# ---- training data ------------------------------------------------------------------------
def _counts(batches):
    """Partial (feature, fold, toxic texts, other texts) of a task."""
    seen: Counter = Counter()

    def flush():
        keys = list({k[:2] for k in seen})
        row = pa.RecordBatch.from_pydict({"feature": [f for f, _ in keys], "fold": [k for _, k in keys],
                                          "pos": [seen[f, k, True] for f, k in keys],
                                          "neg": [seen[f, k, False] for f, k in keys]},
                                         pa.schema([("feature", pa.string()), ("fold", pa.int64()),
                                                    ("pos", pa.int64()), ("neg", pa.int64())]))
        seen.clear()
        return row

    for batch in batches:
        for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
            seen.update((f, fold, toxic) for f in text_features(text))
            seen["", fold, toxic] += 1                 # the texts themselves
            if len(seen) > MEMO_WORDS:
                yield flush()
    if seen:
        yield flush()


def _vectors(features: dict[str, int]):
    def run(batches):
        for batch in batches:
            key, texts, toxic = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(key, pa.int64()), "toxic": pa.array(toxic, pa.bool_()),
                "indices": pa.array([sorted(features[f] for f in text_features(t) if f in features) for t in texts],
                                    pa.list_(pa.int32())),
                "seeds": pa.array([[bool(words(t) & set(s)) for s in CATEGORIES.values()] for t in texts],
                                  pa.list_(pa.bool_()))})
    return run


def fit_chain(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES,
              **options) -> Chain:
    """Train on at most ``max_labelled`` labelled texts (the lowest hashes of
    their ids, and of several texts of one id the lowest hashes of those). Their feature counts are summed by Spark; the driver gets the
    ``max_features`` strongest features of the sample and of the sample
    without each fold, and the sample's rows over those.
    NULL ids, labels and texts are passed over."""
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    ship_package(docs.sparkSession)
    some = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .select(F.col(id_col).alias("k"), (F.col(label_col) != 0).alias("toxic"))
            .orderBy(F.xxhash64("k"), "k", "toxic").limit(max_labelled))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    # an id may have any number of texts: the bound holds for the texts, too
    texts = texts.withColumn("h", F.xxhash64("t"))
    bounded = stored(texts.join(F.broadcast(some), "k").select(F.xxhash64("k").alias("hk"), "k", "h", "toxic").distinct()
                     .orderBy("hk", "k", "h", "toxic").limit(max_labelled), "labelled-texts")
    # copies of one text say it once
    sample = (texts.join(F.broadcast(bounded.drop("hk")), ["k", "h"]).groupBy("h", "toxic").agg(F.min("t").alias("t")))
    fold = F.pmod("h", F.lit(FOLDS))
    counts = (sample.select("t", "toxic", fold.alias("fold")).mapInArrow(_counts, "feature string, fold long, pos long, neg long")
              .groupBy("feature").agg(*[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
                                        for c in ("pos", "neg") for k in range(FOLDS)]))
    counts = stored(counts, "feature-counts")
    totals = counts.where("feature = ''").first()

    def strongest(without: int) -> DataFrame:
        """Features of the texts outside of a fold (FOLDS: of all texts)."""
        every = [k for k in range(FOLDS) if k != without]
        pos, neg = (sum(totals[f"{c}{k}"] for k in every) if totals else 0 for c in ("pos", "neg"))
        share = (pos + 0.5) / (pos + neg + 1)
        # evidence: log-likelihood ratio of the feature's toxic share against the sample's
        p, q = (sum((F.col(f"{c}{k}") for k in every), F.lit(0)) for c in ("pos", "neg"))
        n, q = p + q, F.greatest(q, F.lit(1e-9))
        evidence = 2 * (p * F.ln(p / (n * share)) + q * F.ln(q / (n * (1 - share))))
        return (counts.where((F.col("feature") != "") & (p > 0) & (p > n * share))
                .select(F.lit(without).alias("without"), "feature", evidence.alias("evidence"))
                .where(F.col("evidence") >= FLOORS[-1]).orderBy(F.col("evidence").desc(), "feature").limit(max_features))
    found = reduce(DataFrame.unionByName, map(strongest, range(FOLDS + 1))).collect()
    found.sort(key=lambda r: (-r.without, -r.evidence, r.feature))
    column = {f: j for j, f in enumerate(dict.fromkeys(r.feature for r in found))}
    rows = sample.select("h", "t", "toxic").mapInArrow(
        _vectors(column), "h long, toxic boolean, indices array<int>, seeds array<boolean>").collect()
    rows.sort(key=lambda r: (r.h, r.toxic, r.indices))
    floor = best_floor([r.indices for r in rows], np.array([r.toxic for r in rows], dtype=float),
                       np.array([r.h % FOLDS for r in rows]),
                       [[(r.evidence, column[r.feature]) for r in found if r.without == k] for k in range(FOLDS)], **options)
    features = {r.feature: column[r.feature] for r in found if r.without == FOLDS and r.evidence >= floor}
    indices = [[j for j in r.indices if j < len(features)] for r in rows]      # those of all texts come first
    targets = np.array([[*(r.toxic and s for s in r.seeds), r.toxic] for r in rows], dtype=float)
    return train_chain(indices, targets.reshape(len(rows), len(CHAIN)), features, **options)


# ---- scoring ------------------------------------------------------------------------------
def _score(chain: Chain, text_at: int):
    def run(batches):
        features, memo = chain.features, {}

        class Found(dict):
            def __missing__(self, word):
                hit = tuple(features[f] for f in word_features(word) if f in features)
                if len(self) > MEMO_WORDS:
                    self.clear()
                self[word] = hit
                return hit
        memo = Found()
        for batch in batches:
            indices = []
            for t in batch.column(text_at):
                t = t.as_py()
                hits = filter(None, map(memo.__getitem__, words(t))) if t else ()
                indices.append(sorted({j for h in hits for j in h}))
            p = chain.probabilities(indices) if indices else np.zeros((0, len(CHAIN)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(p[:, k], pa.float64()) for k in range(len(CHAIN))]],
                names=[f"c{j}" for j in range(batch.num_columns + len(CHAIN))])
    return run


def score(docs: DataFrame, chain: Chain, *, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` and one probability per category (``p_insult`` ..., double).

    A NULL or empty text has no words and gets each model's bias; repeated
    rows score alike; an empty table gives no row. Names that clash with a
    column of ``docs`` raise.
    """
    need(docs, text_col)
    ship_package(docs.sparkSession)
    names = [prefix + c for c in CHAIN]
    if set(names) & set(docs.columns):
        raise ValueError(f"{names} clash with columns of the table; choose another prefix=")
    schema = T.StructType([T.StructField(f"c{j}", f.dataType) for j, f in enumerate(docs.schema.fields)]
                          + [T.StructField(f"c{len(docs.columns) + j}", T.DoubleType()) for j in range(len(names))])
    return docs.mapInArrow(_score(chain, docs.columns.index(text_col)), schema).toDF(*docs.columns, *names)


def flag(docs: DataFrame, chain: Chain, *, text_col: str = "text", threshold: float = THRESHOLD,
         name: str = "toxic") -> DataFrame:
    """``docs`` and a boolean column: is the label's probability over ``threshold``?"""
    (prefix,) = fresh(docs, "p_")
    scored = score(docs, chain, text_col=text_col, prefix=f"{prefix}_")
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns],
                         (F.col(f"{prefix}_{LABEL}") > threshold).alias(name))
