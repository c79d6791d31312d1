"""The hidden Markov model against plain counts, plain recursions and held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayeslake.llm import catalog, hidden_markov as H

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def plain(rows):
    """doc_id -> (held_out, n_tokens, n_known, N, base score); and the counts."""
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return c, [(i, held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n,
                sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for i, x in rows]


def random_model(rng, classes=7, states=3):
    return H.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states),
                   rng.dirichlet(np.ones(classes), states).T.copy(), np.ones(classes), 100, 5)


def plain_expect(docs, model):
    """Expected counts by the sums over all state paths' forward and backward values, unscaled."""
    k = len(model.start)
    counts, moves, starts, total = np.zeros_like(model.emit), np.zeros((k, k)), np.zeros(k), 0.0
    for d in docs:
        a = [model.start * model.emit[d[0]]]
        for w in d[1:]:
            a.append(a[-1] @ model.move * model.emit[w])
        b = [np.ones(k)]
        for w in reversed(d[1:]):
            b.append(model.move @ (model.emit[w] * b[-1]))
        b.reverse()
        p = a[-1].sum()
        total += math.log(p)
        for t, w in enumerate(d):
            counts[w] += a[t] * b[t] / p
            if t:
                moves += np.outer(a[t - 1], model.emit[w] * b[t]) * model.move / p
        starts += a[0] * b[0] / p
    return counts, moves, starts, total


@pytest.mark.parametrize("segment", [1, 2, 3, 5, 9, 1024])
def test_expected_counts_equal_the_plain_recursion(monkeypatch, segment):
    monkeypatch.setattr(H, "SEGMENT", segment)
    monkeypatch.setattr(H, "BATCH_TOKENS", 12)
    rng = np.random.default_rng(segment)
    model = random_model(rng)
    docs = [rng.integers(0, 7, n) for n in (1, 1, 2, 5, 9, 40, 4)]
    lengths, wanted = np.array([len(d) for d in docs]), np.array([0, 2, 3, 5, 6])
    want = plain_expect([docs[i] for i in wanted], model)
    got = [np.zeros_like(x) for x in want[:3]]
    total = H.expect(lengths, np.concatenate(docs), wanted, model, *got)
    for x, y in zip(got, want):
        assert np.allclose(x, y)
    assert total == pytest.approx(want[3])
    assert H.log_likelihoods(lengths, np.concatenate(docs), model) == pytest.approx([plain_expect([d], model)[3] for d in docs])


def test_emissions_sum_to_one_for_every_state():
    rng = np.random.default_rng(3)
    tokens_, once = np.zeros(H.CLASSES), np.zeros(H.CLASSES)
    at = rng.integers(1, H.CLASSES, 500)
    tokens_[at] = rng.integers(1, 50, 500)
    once[at] = np.minimum(tokens_[at], rng.integers(0, 5, 500))
    model = H.first_model(tokens_, once, 100, 4)
    assert np.allclose(model.emit.sum(axis=0), 1) and (model.emit[H.UNKNOWN_CLASS] > 0).all()
    nothing = H.first_model(np.zeros(H.CLASSES), np.zeros(H.CLASSES), 0, 4)
    assert np.allclose(nothing.emit[H.UNKNOWN_CLASS], 1)


def test_rounds_never_lower_the_likelihood_and_states_help_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = H.held_out_by_id()
    blocks = H.stored(H.token_blocks(docs, "doc_id", "text", held_out), "t")
    n = blocks.agg(F.sum("n_train")).first()[0]
    encoded = H.stored(H.encode_blocks(blocks, n), "t")
    seen = []
    once = np.zeros(H.CLASSES)
    for c, s in encoded.select(F.explode(F.arrays_zip("class_ids", "class_once")).alias("x")).groupBy("x.class_ids").agg(
            F.sum("x.class_once")).collect():
        once[c] = s
    model = H.train(encoded, rounds=0)
    for _ in range(4):
        model = H.one_round(encoded, model, once, 8)
        seen.append(model.log_likelihood)
    assert all(b > a for a, b in zip(seen, seen[1:]))
    one = H.score_documents(docs, states=1, rounds=1).where("held_out").agg(F.sum("score")).first()[0]
    many = H.score_blocks(encoded, model).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert many[0] > one > many[1]


def test_query_equals_plain_counts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    _, want = plain(rows)
    got = {r.doc_id: r for r in catalog.op11_hidden_markov(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, h, n, known, total, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert math.isfinite(r.score) and r.score < 0
    total = {h: (sum(r.base_score for r in got.values() if r.held_out == h),
                 sum(r.score for r in got.values() if r.held_out == h)) for h in (True, False)}
    assert total[True][1] > total[True][0] and total[False][1] > total[False][0]


def test_scores_equal_the_plain_recursion_over_words(spark):
    """The whole way on a small table: classes, shares within classes and the recursion."""
    docs = spark.createDataFrame([(i, ("the cat " if i % 2 else "der Hund ") * (i % 4 + 1) + f"x{i}") for i in range(40)],
                                 "doc_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    counts, _ = plain(rows)
    n = sum(counts.values())
    blocks = H.stored(H.token_blocks(docs, "doc_id", "text", H.held_out_by_id()), "t")
    encoded = H.stored(H.encode_blocks(blocks, n), "t")
    model = H.train(encoded, states=3, rounds=3)
    got = {r.doc_id: r.score for r in H.score_blocks(encoded, model).collect()}
    words = spark.createDataFrame([(w.encode(), counts[w]) for w in {t for _, x in rows for t in tokens(x)}],
                                  "w binary, c long")
    cls = {bytes(r.w).decode(): r.k for r in words.select("w", H.class_of(F.col("w"), F.col("c"), n).alias("k")).collect()}
    for i, text in rows:
        d = [cls[t] for t in tokens(text)]
        inside = sum(math.log10(counts[t] / model.tokens[cls[t]]) for t in tokens(text) if counts[t])
        assert got[i] == pytest.approx(plain_expect([d], model)[3] / math.log(10) + inside)


def test_odd_rows(spark):
    long = "Word " * 70_000
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "ÄB Äb\x1cz\x0bq", "c"), (3, "ÄB Äb\x1cz\x0bq", "c"), (None, "a a", "d"), (7, long, "e")],
        "doc_id long, text string, score string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, want = plain(rows)
    got = H.score_documents(docs, rounds=2, states=3).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])                                     # noqa: E731
    assert len(got) == 6
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5], abs=1e-6) and math.isfinite(r[6])
    assert H.score_documents(docs.limit(0)).collect() == []
    alone = H.score_documents(docs.where("doc_id = 7"), held_out=F.lit(True)).first()
    assert (alone.train_tokens, alone.n_known, alone.n_tokens) == (0, 0, 70_001)
    assert abs(alone.base_score) < 1e-6 and abs(alone.score) < 1e-6
