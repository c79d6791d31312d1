"""Many classes, many continuous edges and wide moments: the scalable paths against the plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import bayeslake.operators.fit as FIT
import bayeslake.operators.moments as M
import bayeslake.operators.predict as P
from bayeslake import candidate_scores, fit, node_factor, predict
from bayeslake.functions import vectorized as V


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def sparse_table(spark, cont=0):
    rng = np.random.default_rng(cont)
    rows = []
    for i in range(600):
        a = int(rng.integers(0, 12))
        k = int(a * 3 + rng.integers(0, 4)) * 2 + 1          # a configuration sees few classes; odd values only
        x = [float(k % 7 + rng.normal()) if rng.random() > 0.1 else None for _ in range(cont)]
        rows.append((a if rng.random() > 0.05 else None, int(rng.integers(0, 2)), k, *x))
    return spark.createDataFrame(rows, "a int, b int, k int" + "".join(f", x{j} double" for j in range(cont)))


def dense_arg_max(scored):
    best = F.array_max(F.transform(F.arrays_zip("candidates", "scores"),
                                   lambda e: F.struct(e["scores"].alias("s"), (-e["candidates"]).alias("nk"))))
    return scored.withColumn("best", best).select("a", "b", "k", (-F.col("best.nk")).alias("prediction"), F.col("best.s").alias("score"))


@pytest.mark.parametrize("cont", [0, 2, 12])
@pytest.mark.parametrize("default", [0.0, 1e-9, 0.5])
def test_observed_classes_equal_the_dense_scores(spark, cont, default):
    df = sparse_table(spark, cont)
    m = fit(df, [("a", "k"), ("b", "k")] + [(f"x{j}", "k") for j in range(cont)])
    new = df.unionByName(df.limit(5).withColumn("a", F.lit(99)))          # an unseen configuration too
    got = predict(m, new, "k", default_prob=default).select("a", "b", "k", "prediction", "score")
    want = dense_arg_max(candidate_scores(m, new, "k", default_prob=default))

    def rows(d):
        return sorted((tuple(r[:4]) + (round(r.score, 9) if math.isfinite(r.score) else r.score,) for r in d.collect()), key=repr)
    assert rows(got) == rows(want)


def test_scored_rows_are_not_exchanged_for_many_classes(spark):
    df = sparse_table(spark)
    m = fit(df, [("a", "k"), ("b", "k")])
    assert m.domain_size("k") == df.select("k").distinct().count()
    big = spark.range(20000).select((F.col("id") % 12).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"), "id")
    plan = executed(predict(m, big, "k", default_prob=1e-5))
    scored = [line for line in plan.split("\n") if "hashpartitioning(a#" in line and "Exchange" in line]
    assert not scored and "BroadcastHashJoin" in plan
    assert "collect_list" not in plan or "posexplode(__c" not in plan


def test_every_class_under_a_zero_factor_gives_the_lowest(spark):
    """A root outside the training domain makes every score 0: the lowest class wins."""
    df = sparse_table(spark)
    m = fit(df, [("a", "k")])
    new = spark.createDataFrame([(1, 7), (None, 0)], "a int, b int")       # b = 7 was never seen
    got = predict(m, new, "k", default_prob=1e-5).orderBy(F.desc_nulls_last("a")).collect()
    want = dense_arg_max(candidate_scores(m, new.withColumn("k", F.lit(0)), "k", default_prob=1e-5)).orderBy(
        F.desc_nulls_last("a")).collect()
    assert [(r.prediction, r.score) for r in got] == [(r.prediction, r.score) for r in want]


def test_class_tiles_equal_the_array_path(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(i % 40), *[float(i % 40 % 5 + rng.normal()) if rng.random() > 0.05 else None for _ in range(9)]) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"x{j} double" for j in range(9)))
    m = fit(df, [(f"x{j}", "k") for j in range(9)])

    def rows_of(d):
        return sorted((r.k, r.prediction, round(r.score, 8)) for r in d.select("k", "prediction", "score").collect())
    whole = rows_of(predict(m, df, "k"))
    monkeypatch.setattr(P, "MAX_UDF_CELLS", 90)              # ten classes a tile
    monkeypatch.setattr(P, "TILE_CELLS", 900)
    scored = predict(m, df, "k")
    assert rows_of(scored) == whole
    plan = executed(scored)
    assert "FlatMapCoGroupsInArrow" in plan


# ---- summaries ---------------------------------------------------------------------------
def edge_table(spark, n=400, width=20):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, width)) + 1e6                     # far from zero: nothing may cancel
    x[:, 1] += x[:, 0]
    rows = [(int(i % 3) if i % 11 else None, *[float(v) if rng.random() > 0.1 else (None if rng.random() > 0.5 else float("nan"))
                                               for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "d int, " + ", ".join(f"x{j} double" for j in range(width))).repartition(6)


EDGES = [(f"x{j}", "x19") for j in range(17)] + [("d", "x19"), ("x0", "x18"), ("x1", "x18"), ("x19", "d2")]


@pytest.mark.parametrize("edges", [EDGES[:17], EDGES[:18], EDGES[:20]])
def test_edge_summaries_equal_the_aggregates(spark, monkeypatch, edges):
    df = edge_table(spark)

    def params():
        m = fit(df, edges)
        return {(r["kind"], r["node"], r["config"], r["item"], r["stat"]): r["value"] for r in m.params().collect()}
    assert FIT.uses_summaries(FIT.Network.from_schema(df.schema, edges))
    got = params()
    monkeypatch.setattr(FIT, "LONG_EDGES_MIN", 10**6)
    want = params()
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-7, abs=1e-7), k


def test_summaries_merge_to_the_same_moments_in_any_cut(spark, monkeypatch):
    df = edge_table(spark).select("d", "x0", "x1")
    X = df.select("d", F.nullif("x0", F.lit(float("nan"))).alias("x0"), "x1")
    for parts, fan in ((1, 512), (7, 512), (7, 2)):
        monkeypatch.setattr(M, "MERGE_FAN", fan)
        got = M.merge(M.summarise(X.repartition(parts), ["x0", "x1"], [(("d",), [0, 1])], 1, [(0, 1)])).collect()
        want = {r.d: r for r in X.groupBy("d").agg(*[f(F.nanvl(c, F.lit(None))).alias(f"{n}{c}") for c in ("x0", "x1")
                                                     for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))]).collect()}
        for r in got:
            if r.gid == 0:
                w = want[r.key[0]]
                assert r.n == w[f"nx{r.j}"] and r.a == pytest.approx(w[f"mx{r.j}"], rel=1e-12)
                assert math.sqrt(r.c / (r.n - 1)) == pytest.approx(w[f"sx{r.j}"], rel=1e-9)
        assert sorted({r.gid for r in got}) == [-1, 0, 1]


def test_wide_fit_neither_explodes_rows_nor_grows_its_plan(spark):
    df = spark.range(50).select(F.col("id").cast("int").alias("y"), *[F.rand(i).alias(f"x{i}") for i in range(40)])
    net = FIT.Network.from_schema(df.schema, [(f"x{i}", "y") for i in range(40)])
    plan = FIT.summary_stats(df, net)[0]._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "Generate" not in plan and "MapInArrow" in plan


def test_wide_z_scores_equal_the_narrow_ones(spark, monkeypatch):
    import bayeslake.sources.tables as T
    df = edge_table(spark).select(*[f"x{j}" for j in range(5)])
    narrow = sorted(map(repr, rows_sorted(T.standardize(df))))
    monkeypatch.setattr(T, "WIDE_COLUMNS", 2)
    assert sorted(map(repr, rows_sorted(T.standardize(df)))) == narrow


def rows_sorted(d):
    return [tuple("nan" if v is not None and math.isnan(v) else None if v is None else round(v, 5) for v in r) for r in d.collect()]


# ---- kernels -------------------------------------------------------------------------------
@pytest.mark.parametrize("dpar", [True, False])
def test_wide_pairs_equal_the_unrolled_terms(spark, monkeypatch, dpar):
    df = edge_table(spark)
    edges = EDGES[:18] if dpar else EDGES[:17]
    m = fit(df, edges)
    rows = lambda d: sorted(repr((r.d, r.x0, None if r.log_factor is None else round(r.log_factor, 6))) for r in d.collect())
    new = df.unionByName(df.limit(3).withColumn("d", F.lit(77)))
    wide = rows(node_factor(m, new, "x19", default_prob=1e-3))
    monkeypatch.setattr(P, "WIDE_FAN_IN", 100)
    assert rows(node_factor(m, new, "x19", default_prob=1e-3)) == wide


def test_pair_kernel_with_missing_and_degenerate_parameters():
    nan = np.nan
    x = np.array([[1.0, 2.0], [nan, 2.0], [1.0, 2.0], [1.0, 2.0], [1.0, 2.0]])
    y = np.array([1.0, 1.0, nan, 1.0, 1.0])
    rho = np.array([[0.1, 0.2], [0.1, 0.2], [0.1, 0.2], [1.5, 0.2], [nan, 0.2]])
    got = V.pair_log_density_sums(x, y, np.zeros(2), np.ones(2), np.zeros(5), np.ones(5), rho)

    def one(a, b, r):
        return -math.log(2 * math.pi) - 0.5 * math.log(1 - r * r) - (a * a + b * b - 2 * r * a * b) / (2 * (1 - r * r))
    assert got[0] == pytest.approx(one(1, 1, .1) + one(2, 1, .2)) and got[1] == pytest.approx(one(2, 1, .2))
    assert got[2] == 0 and got[3] == got[4] == -math.inf
    assert V.pair_log_density_sums(x[:1], y[:1], np.zeros(2), np.array([0.0, 1.0]), np.zeros(1), np.ones(1), rho[:1])[0] == -math.inf


@pytest.mark.parametrize("spread", [1.0, 1e5])
def test_class_densities_by_products_equal_the_terms(spread):
    rng = np.random.default_rng(0)
    mean, sd = rng.normal(size=(6, 11)) * spread + 1e4, rng.random((6, 11)) + 0.5
    r, c = 1 / sd, -np.log(sd)
    r[2, 3], c[2, 3] = 0.0, -np.inf
    x = mean[rng.integers(0, 6, 80)] + rng.normal(size=(80, 11))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[5, 5] = np.inf
    for rows in (x, x[:5], x[6:], x[:0]):
        t = -0.5 * ((rows[:, None] - mean) * r) ** 2 + c
        with np.errstate(invalid="ignore"):
            want = np.where(np.isnan(rows[:, None]), 0.0, t).sum(axis=2)
        assert np.allclose(V.class_log_density_sums(rows, mean, r, c), want, rtol=1e-9, atol=1e-6, equal_nan=True)
