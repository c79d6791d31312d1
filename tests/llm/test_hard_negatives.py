"""Hard negatives against a search over all pairs, and the tree's bounds."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bayeslake.llm import catalog, hard_negatives as G

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<double>"


def plain(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, integer vector); all pairs."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))                                 # noqa: E731
    for i, label, q in rows:
        if not anchor(i):
            continue
        ranked = sorted(((-dot(q, v), j, lab) for j, lab, v in rows if j != i))
        for p, j in [(-s, j) for s, j, lab in ranked if lab == label][:positives]:
            found = [(-s, k) for s, k, lab in ranked if lab != label and low * p <= 100 * -s <= high * p][:negatives]
            out += [(i, j, r, k, p, s) for r, (s, k) in enumerate(found, 1)]
    return sorted(out)


def got_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_sql_over_all_pairs(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert got_of(catalog.op12_hard_negatives(spark, SF)) == sorted(con.execute(catalog.ORACLE["op12_hard_negatives"]).fetchall())


@pytest.mark.parametrize("kind", ["clusters", "ties", "negative"])
def test_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 240
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(6, 5)) * 3, n // 6, axis=0) + rng.normal(size=(n, 5)) * 0.2
    elif kind == "ties":
        x = rng.integers(0, 3, (n, 3)) / 4.0
        x[100:180] = x[0]                                # a third of the rows are copies
    else:
        x = rng.normal(size=(n, 2))
    labels = rng.integers(0, 4, n)
    rows = [(int(i), int(labels[i]), [math.floor(256 * v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame([(i, lab, [float(v) for v in x[i]]) for i, lab, _ in rows], SCHEMA).repartition(5)
    got = got_of(G.mine(df, F.col("vec_id") % 5 == 0))
    want = plain(rows, lambda i: i % 5 == 0)
    assert got == want and (want or kind == "negative")


def test_tree_never_rules_out_an_answer():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(900, 8)) * 300)
    x[300:600] = x[7]
    tree = G.Tree(x[:200], G.LEAF_ROWS * G.ARITY * 5)
    leaves = tree.leaves(x)
    tree.set_ranges({int(k): tree.measures(x[leaves == k], int(k)) for k in np.unique(leaves)})
    assert len(np.unique(leaves)) > 16
    q = x[::9]
    walk, seen = tree.bounds(q), set()
    item = next(walk)
    while item is not None:
        leaf, at, least, greatest = item
        rows = x[leaves // G.ARITY == [b for b in tree.branches][0]] if leaf is None else x[leaves == leaf]
        if leaf is not None:
            s = q[at] @ rows.T
            assert (s.min(1) >= least).all() and (s.max(1) <= greatest).all()
            seen.add(leaf)
        try:
            item = walk.send(at if leaf is None else None)
        except StopIteration:
            item = None
    assert seen == set(np.unique(leaves).tolist())
    block = G.Block(np.arange(900), np.zeros(900), x)
    exact = q @ x.T
    kept = block.scores(q, lambda least, greatest: greatest >= np.partition(exact, 890, axis=1)[:, 890])
    top = exact >= np.partition(exact, 890, axis=1)[:, 890:891]
    assert (kept[top] == exact[top]).all() and np.isneginf(kept).any()


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.0]), (2, 2, [0.5, 0.0]), (3, 2, [0.4]), (4, 3, []),
            (5, None, [1.0, 1.0]), (6, 1, None), (7, 2, [None, 1.0]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (None, 2, [1.0, 1.0]),
            (10, 2, [1e300, 1.0]), (11, 2, [0.5, 0.5]), (11, 1, [0.7, 0.5])]
    df = spark.createDataFrame([r + ("x",) for r in rows], SCHEMA + ", score string")
    used = [(0, 1, [256, 0]), (1, 1, [230, 25]), (2, 2, [128, 0]), (3, 2, [102, 0]), (4, 3, [0, 0]), (11, 1, [179, 128])]
    assert got_of(G.mine(df, F.col("vec_id") % 2 == 0)) == plain(used, lambda i: i % 2 == 0) != []
    assert G.mine(df.limit(0), F.lit(True)).collect() == []
    assert G.mine(df, F.lit(False)).collect() == []
    assert G.mine(df, F.lit(None).cast("boolean")).columns == [c.split()[0] for c in G.RESULT.split(", ")]
