"""The classifier chain on held-out labels, out-of-fold training, odd rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayeslake.llm import catalog, toxicity as X

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"),
            spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_labels(spark, tables):
    docs, labels = tables
    chain = X.fit_chain(docs, labels.where("doc_id % 2 = 0"))
    held = X.flag(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), chain, name="found")
    n = {(r.toxic, r.found): r["count"] for r in held.groupBy("toxic", "found").count().collect()}
    caught, missed = n.get((1, True), 0), n.get((1, False), 0)
    wrong, clean = n.get((0, True), 0), n.get((0, False), 0)
    # about one labelled toxic text in seven has none of the vocabulary of the others
    assert caught > 0.8 * (caught + missed), n
    assert wrong < 0.01 * (wrong + clean), n


@pytest.mark.parametrize("sf, seeded, other, clean", [("sf0.001", 0.9, 0.0, 0.01), ("sf0.01", 0.9, 0.5, 0.04)])
def test_small_samples_catch_what_large_ones_do(spark, tables, sf, seeded, other, clean):
    """Trained on few labels, held against the texts of sf0.1 that were not among them."""
    docs, labels = tables
    few = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    chain = X.fit_chain(few, spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"))
    held = docs.join(labels, "doc_id").join(few.select("text"), "text", "left_anti").dropDuplicates(["text", "toxic"])
    seeds = {w for s in X.CATEGORIES.values() for w in s}
    n = Counter((r.toxic, bool(X.words(r.text) & seeds), r.found) for r in X.flag(
        held.withColumnRenamed("toxic", "label"), chain).withColumnsRenamed({"toxic": "found", "label": "toxic"}).collect())
    share = lambda toxic, seed: n[toxic, seed, True] / max(1, n[toxic, seed, True] + n[toxic, seed, False])
    print(sf, n)
    assert share(1, True) > seeded and share(1, False) >= other and share(0, False) < clean, n


def test_one_id_with_many_texts_stays_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    sizes, train = [], X.train_chain
    monkeypatch.setattr(X, "train_chain", lambda indices, *a, **o: sizes.append(len(indices)) or train(indices, *a, **o))
    X.fit_chain(docs, labels, max_labelled=20)
    assert sizes == [20]


def test_no_feature_no_flag(spark):
    rows = [(i, f"w{i} v{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    assert not any(r.toxic for r in X.flag(docs, X.fit_chain(docs, labels)).collect())


def test_query_scores_every_document(spark):
    got = catalog.op3_toxicity(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "p_insult", "p_contempt", "p_toxic", "toxic"]
    rows = got.collect()
    assert len(rows) == len({r.doc_id for r in rows}) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(0 <= r.p_toxic <= 1 and r.toxic == (r.p_toxic > X.THRESHOLD) for r in rows)


def brute_probability(chain, text):
    """The chain on one text, weight by weight."""
    found = {chain.features[f] for f in X.text_features(text or "") if f in chain.features}
    p = []
    for w in chain.weights:
        z = w[-1] + sum(w[j] for j in found) + sum(a * b for a, b in zip(w[len(chain.features):-1], p))
        p.append(1 / (1 + np.exp(-z)))
    return p


def test_scores_equal_brute_force_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    feats = ["bad", "worse", "terr*", "über"]
    chain = X.Chain({f: i for i, f in enumerate(feats)}, [rng.normal(size=len(feats) + k + 1) for k in range(3)])
    texts = [None, "", "...", "Bad bad WORSE", "terrible terrific", "über Terra", "fine text", "bad " * 5000]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] * 2, "doc_id long, text string, c0 double")
    for r in X.score(df, chain).collect():
        assert np.allclose([r.p_insult, r.p_contempt, r.p_toxic], brute_probability(chain, texts[r.doc_id]))
        assert r.c0 == 0.5
    assert X.score(df.where(F.lit(False)), chain).collect() == []
    with pytest.raises(ValueError):
        X.score(df.withColumn("p_toxic", F.lit(1)), chain)


def test_later_models_see_out_of_fold_probabilities():
    # the label is exactly the first category; its own features are noise that a
    # model could learn by heart, so only held-out probabilities are honest
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    indices = [[int(t)] + ([2 + i] if i < 100 else []) for i, t in enumerate(y)]
    chain = X.train_chain(indices, np.column_stack([y, y]), {str(j): j for j in range(102)})
    p = chain.probabilities([[0], [1], []])
    assert p[0, 1] < 0.1 < 0.9 < p[1, 1] and p.shape == (3, 2)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    chain = X.fit_chain(docs, labels)
    assert chain.features == {} and all(r.p_toxic < 1e-6 for r in X.score(docs, chain).collect())
    assert [r.toxic for r in X.flag(docs, chain).collect()] == [False, False]
