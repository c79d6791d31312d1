
import math

import pytest
from pyspark.sql import functions as F

from bayeslake import candidate_scores, fit, node_factor, predict, predict_with_labels
from bayeslake.functions.density import NEG_INF


def _scores(m, df, output, **kw):
    return {(r["d"], r["c"]): [math.exp(s) for s in r["scores"]]
            for r in candidate_scores(m, df, output, **kw).collect()}


def test_h1_label_factor_ratios(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    q = spark.createDataFrame([(0, None, 2.0), (1, None, 4.0)], "d int, label int, c double")
    s = _scores(m, q, "label")
    # class-independent factors (roots d and c) cancel in the ratio
    assert s[(0, 2.0)][0] / s[(0, 2.0)][1] == pytest.approx(0.2419707245 / 0.0095612586, rel=1e-8)
    assert s[(1, 4.0)][0] / s[(1, 4.0)][1] == pytest.approx(7.4335975737e-07 / 0.0808757648, rel=1e-8)
    p = {(r["d"], r["c"]): r["prediction"] for r in predict(m, q, "label").collect()}
    assert p == {(0, 2.0): 0, (1, 4.0): 1}


def test_h1_label_factor_values(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    q = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 4.0)], "d int, label int, c double")
    f = {(r["d"], r["label"]): math.exp(r["log_factor"]) for r in node_factor(m, q, "label").collect()}
    assert f[(0, 0)] == pytest.approx(0.2419707245, rel=1e-8)
    assert f[(0, 1)] == pytest.approx(0.0095612586, rel=1e-8)
    assert f[(1, 0)] == pytest.approx(7.4335975737e-07, rel=1e-8)
    assert f[(1, 1)] == pytest.approx(0.0808757648, rel=1e-8)


def test_h2_joint_density(spark, h2):
    m = fit(h2.select("x", "y"), [("x", "y")])
    q = spark.createDataFrame([(4.0, 5.0)], "x double, y double")
    (r,) = node_factor(m, q, "y").collect()
    assert math.exp(r["log_factor"]) == pytest.approx(0.0646838538, rel=1e-8)


def test_unseen_root_is_zero_and_unseen_family_is_default(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    q = spark.createDataFrame([(7, 0, 2.0)], "d int, label int, c double")
    (root,) = node_factor(m, q, "d").collect()
    assert root["log_factor"] == NEG_INF
    (fam,) = node_factor(m, q, "label", default_prob=1e-5).collect()
    assert fam["log_factor"] == pytest.approx(math.log(1e-5))   # default alone, no density


def test_all_zero_picks_lowest_class(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    # unseen d: root factor 0 for every class -> lowest candidate (Q6)
    q = spark.createDataFrame([(9, None, 6.0)], "d int, label int, c double")
    (r,) = predict(m, q, "label").collect()
    assert r["prediction"] == 0 and r["score"] == NEG_INF


def test_exact_tie_picks_lowest_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, label int")
    m = fit(df, [("a", "label")])
    q = spark.createDataFrame([(0,), (1,)], "a int")
    assert [r["prediction"] for r in predict(m, q, "label").collect()] == [0, 0]


def test_zero_sd_class_density_is_zero(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0)], "label int, x double")
    m = fit(df, [("x", "label")])
    q = spark.createDataFrame([(1, 3.0), (1, 3.5)], "label int, x double")
    f = [r["log_factor"] for r in node_factor(m, q, "label").collect()]
    assert f == [NEG_INF, NEG_INF]     # Q8: sd 0 in a class density -> factor 0


def test_degenerate_rho_gives_zero_factor(spark):
    rows = [(0, 0.0, 0.0), (0, 1.0, 0.01), (1, 10.0, 100.0), (1, 20.0, 200.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    m = fit(df, [("k", "y"), ("x", "y")])
    bad = {tuple(r["config"]) for r in m.coef.collect() if abs(r["rho"]) >= 1}
    q = spark.createDataFrame([(k, 1.0, 1.0) for (k,) in bad], "k int, x double, y double")
    assert all(r["log_factor"] == NEG_INF for r in node_factor(m, q, "y").collect())


def test_unseen_configuration_uses_default(spark, h2):
    m = fit(h2, [("k", "y"), ("x", "y")])
    q = spark.createDataFrame([(5, 1.0, 2.0)], "k int, x double, y double")
    (r,) = node_factor(m, q, "y", default_prob=0.25).collect()
    assert r["log_factor"] == pytest.approx(math.log(0.25))


def test_nulls_at_scoring(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    q = spark.createDataFrame([(None, 0, 2.0), (0, 0, None)], "d int, label int, c double")
    f = {r["d"]: r["log_factor"] for r in node_factor(m, q, "label", default_prob=0.5).collect()}
    assert f[None] == pytest.approx(math.log(0.5))            # null parent: unseen family
    assert f[0] == pytest.approx(math.log(0.5))               # null continuous: marginalised, p = 0.5


def test_output_child_and_candidates_scored(spark):
    rows = [(0, 0, 0), (0, 0, 1), (1, 1, 1), (1, 1, 1), (0, 1, 0)]
    df = spark.createDataFrame(rows, "a int, label int, t int")
    m = fit(df, [("a", "label"), ("label", "t")])
    q = spark.createDataFrame([(0, None, 0), (1, None, 1)], "a int, label int, t int")
    p = [r["prediction"] for r in predict(m, q, "label").orderBy("a").collect()]
    assert p == [0, 1]
    # 'scored': candidates 0..K-1 with K distinct values (NULL included) of the scored table
    s = candidate_scores(m, q, "label", candidates="scored").collect()
    assert [list(r["candidates"]) for r in s] == [[0], [0]]


def test_output_must_be_discrete(spark, h2):
    m = fit(h2, [("k", "y"), ("x", "y")])
    with pytest.raises(ValueError):
        predict(m, h2, "y")


def test_invariant_to_partitioning(spark):
    rows = [(i % 3, (i * 5) % 4, float(i % 13), (i * 3) % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, x double, label int")
    edges = [("a", "label"), ("b", "label"), ("x", "label")]
    m1 = fit(df.repartition(1), edges)
    m2 = fit(df.repartition(7), edges)
    p1 = sorted(tuple(r) for r in predict(m1, df, "label").select("a", "b", "x", "prediction").collect())
    p2 = sorted(tuple(r) for r in predict(m2, df.repartition(5), "label")
                .select("a", "b", "x", "prediction").collect())
    assert p1 == p2


def test_wide_fan_in_matches_narrow_path(spark):
    import bayeslake.operators.predict as P
    rows = [tuple(float((i * (j + 3)) % 7) for j in range(10)) + (i % 3,) for i in range(90)]
    cols = [f"f{j}" for j in range(10)] + ["label"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols[:-1]) + ", label int")
    m = fit(df, [(c, "label") for c in cols[:-1]])
    wide = sorted(tuple(r) for r in predict(m, df, "label").select(*cols[:-1], "score").collect())
    old = P.WIDE_FAN_IN
    P.WIDE_FAN_IN = 100
    try:
        narrow = sorted(tuple(r) for r in predict(m, df, "label").select(*cols[:-1], "score").collect())
    finally:
        P.WIDE_FAN_IN = old
    assert [r[-1] for r in wide] == pytest.approx([r[-1] for r in narrow], rel=1e-12)


def test_predict_with_labels_shape(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    out = predict_with_labels(m, h1, "label")
    assert out.columns == ["label", "prediction"]
    assert dict(out.dtypes) == {"label": "double", "prediction": "double"}
    assert out.count() == 8


def test_plan_has_no_shuffle_for_small_model(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    plan = predict(m, h1, "label")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert F is not None


def _both_paths(fn):
    """Run ``fn`` with the flat per-candidate path and with the array path."""
    import bayeslake.operators.predict as P
    flat = fn()
    old = P.MAX_FLAT_CANDIDATES
    P.MAX_FLAT_CANDIDATES = 0
    try:
        arr = fn()
    finally:
        P.MAX_FLAT_CANDIDATES = old
    return flat, arr


@pytest.mark.parametrize("case", ["hybrid", "child", "root", "degenerate"])
def test_flat_path_matches_array_path(spark, case):
    if case == "hybrid":      # discrete parent + continuous parents of the output
        rows = [(i % 3, float(i % 7), float((i * 3) % 5), i % 4) for i in range(120)]
        df = spark.createDataFrame(rows, "a int, x double, y double, label int")
        edges = [("a", "label"), ("x", "label"), ("y", "label")]
    elif case == "child":     # output with a discrete child that has a continuous parent
        rows = [(i % 2, i % 3, (i * 7) % 2, float(i % 5)) for i in range(90)]
        df = spark.createDataFrame(rows, "a int, label int, t int, x double")
        edges = [("a", "label"), ("label", "t"), ("x", "t")]
    elif case == "root":      # output without parents, continuous roots beside it
        rows = [(i % 3, float(i % 11), float(i % 4)) for i in range(60)]
        df = spark.createDataFrame(rows, "label int, x double, y double")
        edges = [("x", "y")]
    else:                     # one-row class (sd 0), nulls, unseen families
        rows = [(0, 1.0, 0), (0, 2.0, 0), (1, 5.0, 1), (0, 3.0, 2), (1, None, 0), (None, 4.0, 1)]
        df = spark.createDataFrame(rows, "a int, x double, label int")
        edges = [("a", "label"), ("x", "label")]
    m = fit(df, edges)
    q = df.union(df.limit(3).withColumn("a" if "a" in df.columns else "x",
                                        F.lit(9).cast(df.schema[0].dataType)))
    cols = [c for c in df.columns if c != "label"]

    def run():
        p = sorted(((tuple(r[:-2]), r[-2], r[-1]) for r in predict(m, q, "label", default_prob=1e-3)
                    .select(*cols, "prediction", "score").collect()), key=repr)
        s = sorted(((tuple(r[:-2]), list(r[-2]), list(r[-1])) for r in candidate_scores(m, q, "label")
                    .select(*cols, "candidates", "scores").collect()), key=repr)
        return p, s
    (pf, sf), (pa, sa) = _both_paths(run)
    assert [r[1] for r in pf] == [r[1] for r in pa]
    assert [r[2] for r in pf] == pytest.approx([r[2] for r in pa], rel=1e-12)
    assert [r[1] for r in sf] == [r[1] for r in sa]
    for a, b in zip(sf, sa):
        assert a[2] == pytest.approx(b[2], rel=1e-12)


def test_flat_path_is_codegen_only(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    plan = predict(m, h1, "label")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "greatest" in plan


def test_vectorized_class_sums_match_formula():
    import numpy as np
    from bayeslake.functions.vectorized import class_log_density_sums
    x = np.array([[1.0, np.nan, 3.0], [0.5, 2.0, -1.0]])
    mean = np.array([[0.0, 1.0, 2.0], [1.0, 1.0, 1.0]])
    sd = np.array([[1.0, 2.0, 0.5], [2.0, 1.0, 0.0]])          # last: degenerate
    r = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
    c = np.where(sd > 0, -np.log(np.where(sd > 0, sd, 1.0)) - 0.5 * math.log(2 * math.pi), -np.inf)
    got = class_log_density_sums(x, mean, r, c)

    def phi(v, m, s):
        return -0.5 * ((v - m) / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)
    assert got[0, 0] == pytest.approx(phi(1.0, 0.0, 1.0) + phi(3.0, 2.0, 0.5), rel=1e-12)   # NaN skipped
    assert got[0, 1] == -math.inf                                                           # sd 0, value present
    assert got[1, 0] == pytest.approx(phi(0.5, 0, 1) + phi(2.0, 1, 2) + phi(-1.0, 2, 0.5), rel=1e-12)


def test_wide_output_uses_one_vectorized_stage(spark):
    rows = [tuple(float((i * (j + 3)) % 7) for j in range(10)) + (i % 3,) for i in range(60)]
    cols = [f"f{j}" for j in range(10)] + ["label"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols[:-1]) + ", label int")
    m = fit(df, [(c, "label") for c in cols[:-1]])
    plan = predict(m, df, "label")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" in plan      # K=3 candidates: array path
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_wide_non_output_node_paths_agree(spark):
    import bayeslake.operators.predict as P
    rows = [tuple(float((i * (j + 3)) % 7) if (i + j) % 13 else None for j in range(10))
            + (i % 3, (i * 5) % 2) for i in range(120)]
    cols = [f"f{j}" for j in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", a int, label int")
    m = fit(df, [(c, "a") for c in cols] + [("a", "label")])
    q = df.union(df.limit(4).withColumn("a", F.lit(7)))          # unseen class of a

    def run():
        f = sorted((repr(tuple(r[:-1])), r[-1]) for r in node_factor(m, q, "a", default_prob=1e-4)
                   .select(*cols, "a", "log_factor").collect())
        p = sorted((repr(tuple(r[:-2])), r[-2], r[-1]) for r in predict(m, q, "label")
                   .select(*cols, "a", "prediction", "score").collect())
        return f, p
    vec = run()
    P.VECTORIZE_ROW_DENSITIES = False
    try:
        fold = run()
        old = P.WIDE_FAN_IN
        P.WIDE_FAN_IN = 100
        try:
            narrow = run()
        finally:
            P.WIDE_FAN_IN = old
    finally:
        P.VECTORIZE_ROW_DENSITIES = True
    for other in (fold, narrow):
        assert [k for k, _ in vec[0]] == [k for k, _ in other[0]]
        assert [v for _, v in vec[0]] == pytest.approx([v for _, v in other[0]], rel=1e-12)
        assert [r[1] for r in vec[1]] == [r[1] for r in other[1]]
        assert [r[2] for r in vec[1]] == pytest.approx([r[2] for r in other[1]], rel=1e-12)


def test_no_candidate_domain_is_refused(spark, monkeypatch):
    """Beyond the flat path's size the array path gives the same answer."""
    import bayeslake.operators.predict as P
    rows = [(i % 3, i % 3 + (i * 37 % 19) / 7.0, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "label int, x double, d int")
    m = fit(df, [("x", "label"), ("d", "label")])
    flat = predict(m, df, "label").collect()
    monkeypatch.setattr(P, "MAX_FLAT_CANDIDATES", 1)
    arrays = predict(m, df, "label").collect()
    scored = predict(m, df, "label", candidates="scored").collect()
    key = lambda r: (r.label, r.x, r.d)
    for a, b, c in zip(sorted(flat, key=key), sorted(arrays, key=key), sorted(scored, key=key)):
        assert a.prediction == b.prediction == c.prediction
        assert a.score == pytest.approx(b.score) and a.score == pytest.approx(c.score)
