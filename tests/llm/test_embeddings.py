"""Embedding near-duplicates against all pairs, the error bound, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayeslake.llm import catalog, embeddings as E
from test_minhash import classes

SF = "/root/testdata/sf0.01"


def brute(rows, threshold):
    ok, links = [], []
    for p, (i, v, label) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if i is not None and label is not None and x is not None and x.size and np.isfinite(x).all() and (x != 0).any():
            ok.append((p, i, x / np.abs(x).max(), label))
    n = [0] * len(rows)
    for s, (p, i, x, la) in enumerate(ok):
        for q, j, y, lb in ok[:s]:
            if la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                n[p] += 1
                n[q] += 1
                links.append((i, j))
    c = classes({r[0] for r in rows if r[0] is not None}, links)
    return [(r[0], k, c.get(r[0]), r[0] is None or c[r[0]] == r[0]) for r, k in zip(rows, n)]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:2])


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in catalog.op7_embedding_near_dedup(spark, SF).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 0.98), key=key)


@pytest.mark.parametrize("tile", [8, 1000])
def test_families_and_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    centre = rng.normal(size=(4, 12))
    rows = []
    for i in range(240):
        x = centre[i % 4] + rng.normal(scale=rng.choice([0.0, 0.05, 0.12]), size=12)
        rows.append((i, (x * rng.choice([1.0, 1e-18, 1e15])).astype(np.float32).tolist(), int(i % 8 // 4)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = [tuple(r) for r in E.near_duplicates(df, threshold=0.98, tile=tile).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 0.98), key=key)


def test_bound_is_rigorous():
    rng = np.random.default_rng(1)
    for d in (1, 2, 64):
        u = E.unit_rows(rng.normal(size=(200, d)) * 10.0 ** rng.integers(-30, 30, (200, 1)))
        q, s, n, e = E.quantise(u)
        about = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
        bound = n[:, None] * e[None, :] + e[:, None] * (n + e)[None, :] + E.SLACK
        assert (np.abs(u @ u.T - about) <= bound).all()
        side = (q.astype(np.float32), s, n, e)
        assert not (np.triu(u @ u.T >= 0.9, 1) & ~E.possible_pairs(side, side, True, 0.9)).any()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
            (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 1), (10, [1.0, 2.0], 1),
            (None, [1.0, 2.0], 1), (11, [1.0, 2.0], 2), (12, [1.0, 2.0, 0.0], 1), (13, [-1.0, -2.0], 1),
            (14, [1e-40, 2e-40], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, dim string")
    got = [tuple(r) for r in E.near_duplicates(df, threshold=0.999).collect()]
    want = [(i, n, c, k) for i, n, c, k in brute(rows, 0.999)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[0]: r[1] for r in got}[8] == 4
    assert E.near_duplicates(df.where(F.lit(False))).collect() == []
    with pytest.raises(ValueError):
        E.near_duplicates(df.drop("label"))
