"""Hand-checked parameters (FIXTURES.md H1, H2) and fit invariants."""

import math

import pytest
from pyspark.sql import functions as F

from bayeslake import fit
from bayeslake.plans.dag import NetworkError

APPROX = dict(rel=1e-9, abs=1e-12)


def _cpt(m, node):
    return {(tuple(r["config"]), r["value"]): r["p"]
            for r in m.cpt.filter(F.col("node") == node).collect()}


def _gauss(m, node, scope):
    return {(tuple(r["config"]), r["dim"]): (r["mean"], r["sd"])
            for r in m.gauss.filter((F.col("node") == node) & (F.col("scope") == scope)).collect()}


def test_h1_cpt_and_class_moments(h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    cpt = _cpt(m, "label")
    assert cpt[((0,), 0)] == pytest.approx(0.5)
    assert cpt[((0,), 1)] == pytest.approx(0.5)
    assert cpt[((1,), 0)] == pytest.approx(0.25)
    assert cpt[((1,), 1)] == pytest.approx(0.75)
    cm = _gauss(m, "label", "class")
    assert cm[((0,), "c")] == pytest.approx((1.5, 0.5))
    assert cm[((1,), "c")][0] == pytest.approx(6.2)
    assert cm[((1,), "c")][1] == pytest.approx(1.9235384062, rel=1e-9)
    root = _cpt(m, "d")
    assert root[((), 0)] == pytest.approx(0.5) and root[((), 1)] == pytest.approx(0.5)


def test_h2_config_moments_and_coefficients(h2):
    m = fit(h2, [("k", "y"), ("x", "y")])
    g = _gauss(m, "y", "config")
    assert g[((0,), "y")][0] == pytest.approx(3.3333333333)
    assert g[((0,), "y")][1] == pytest.approx(1.5275252317)
    assert g[((1,), "y")][0] == pytest.approx(5.6666666667)
    root = _gauss(m, "x", "root")
    assert root[((), "x")] == pytest.approx((3.5, 1.8708286934))
    rho = {tuple(r["config"]): r["rho"] for r in m.coef.collect()}
    assert rho[(0,)] == pytest.approx(0.9039783574, rel=1e-9)
    assert rho[(1,)] == pytest.approx(0.9039783574, rel=1e-9)


def test_h2_without_discrete_parent(h2):
    m = fit(h2.select("x", "y"), [("x", "y")])
    assert _gauss(m, "y", "root")[((), "y")] == pytest.approx((4.5, 1.8708286934))
    (r,) = m.coef.collect()
    assert r["rho"] == pytest.approx(0.7380952381, rel=1e-9)


def test_key_collision_stays_separate(spark):
    # (1, 11) and (11, 1) would collide as concatenated strings ("111")
    df = spark.createDataFrame([(1, 11, 0), (11, 1, 1), (1, 11, 0)], "a int, b int, label int")
    m = fit(df, [("a", "label"), ("b", "label")])
    cpt = _cpt(m, "label")
    assert cpt[((1, 11), 0)] == 1.0
    assert cpt[((11, 1), 1)] == 1.0
    assert len(cpt) == 2


def test_cpt_rows_sum_to_one_per_config(spark):
    rows = [(i % 3, i % 2, (i * 7) % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, x int")
    m = fit(df, [("a", "x"), ("b", "x")])
    sums = m.cpt.filter(F.col("node") == "x").groupBy("config").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    n = m.cpt.filter(F.col("node") == "x").agg(F.sum("n")).first()[0]
    assert n == 200


def test_one_row_group_and_constant_column(spark):
    # class 1 has one row: its class sd is 0 (Q7); constant c gives sd 0 too
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 2.0, 5.0), (1, 3.0, 5.0)], "label int, x double, c double")
    m = fit(df, [("x", "label"), ("c", "label")])
    cm = _gauss(m, "label", "class")
    assert cm[((1,), "x")] == (3.0, 0.0)
    assert cm[((0,), "c")] == (5.0, 0.0)
    one = fit(spark.createDataFrame([(1.0,)], "y double"), [])
    assert _gauss(one, "y", "root")[((), "y")] == (1.0, 1.0)   # F4: sd of one row -> 1


def test_rho_can_leave_unit_interval(spark):
    # F8: covariance over all rows, sd within the configuration
    rows = [(0, 0.0, 0.0), (0, 1.0, 0.01), (1, 10.0, 100.0), (1, 20.0, 200.0)]
    m = fit(spark.createDataFrame(rows, "k int, x double, y double"), [("k", "y"), ("x", "y")])
    rhos = [r["rho"] for r in m.coef.collect()]
    assert any(abs(r) > 1 for r in rhos)


def test_column_one_is_not_special(spark):
    # position 1 continuous with parents is fitted like any other column
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.5)], "x double, y double")
    m = fit(df, [("x", "y")])
    assert m.coef.count() == 1


def test_two_children_of_one_parent(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0), (2.0, 3.0, 7.0), (3.0, 5.0, 4.0)], "x double, y double, z double")
    m = fit(df, [("x", "y"), ("x", "z")])
    keys = {(r["parent"], r["child"]) for r in m.coef.collect()}
    assert keys == {("x", "y"), ("x", "z")}


@pytest.mark.parametrize("edges", [
    [("a", "b"), ("b", "a")],          # cycle
    [("a", "a")],                      # self-loop
    [("a", "nope")],                   # unknown name
    [("a", "b"), ("a", "b")],          # duplicate
])
def test_invalid_dag(spark, edges):
    df = spark.createDataFrame([(0, 1)], "a int, b int")
    with pytest.raises(NetworkError):
        fit(df, edges)


def test_string_column_rejected(spark):
    df = spark.createDataFrame([("u", 1)], "s string, b int")
    with pytest.raises(NetworkError):
        fit(df, [("s", "b")])


def test_nulls_in_parent_child_continuous(spark):
    rows = [(0, 0, 1.0), (None, 0, 2.0), (0, None, 3.0), (0, 1, None), (1, 1, 4.0)]
    m = fit(spark.createDataFrame(rows, "d int, label int, c double"), [("d", "label"), ("c", "label")])
    cpt = _cpt(m, "label")
    # null parent rows are dropped; the null child stays in the denominator of d=0
    assert cpt[((0,), 0)] == pytest.approx(1 / 3)
    assert cpt[((0,), 1)] == pytest.approx(1 / 3)
    assert all(k[0] != (None,) for k in cpt)
    assert not math.isnan(_gauss(m, "label", "class")[((1,), "c")][0])


def test_chunked_scans_match_single_scan(spark):
    rows = [(i % 3, i % 2, i % 5, (i * 7) % 4, float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, c int, x int, y double")
    edges = [("a", "x"), ("b", "x"), ("c", "y"), ("a", "c"), ("y", "x")]
    one = fit(df, edges, max_sets_per_scan=8)
    many = fit(df, edges, max_sets_per_scan=1)
    key = lambda r: (r["node"], tuple(r["config"]), r["value"])
    a = sorted((key(r), r["p"]) for r in one.cpt.collect())
    b = sorted((key(r), r["p"]) for r in many.cpt.collect())
    assert a == b
    ga = sorted((r["node"], r["scope"], tuple(r["config"]), r["dim"], r["mean"], r["sd"]) for r in one.gauss.collect())
    gb = sorted((r["node"], r["scope"], tuple(r["config"]), r["dim"], r["mean"], r["sd"]) for r in many.gauss.collect())
    assert ga == gb


@pytest.mark.parametrize("shape", ["fan_in", "mixed"])
def test_long_form_moments_equal_wide_form(spark, shape):
    import bayeslake.operators.fit as FIT
    rows = [(i % 3, (i * 7) % 2, float(i % 11), float((i * 5) % 13) if i % 9 else None, float(i % 4) * 0.5)
            for i in range(150)]
    df = spark.createDataFrame(rows, "a int, label int, x double, y double, z double")
    if shape == "fan_in":
        edges = [("a", "label"), ("x", "label"), ("y", "label"), ("z", "label")]
    else:       # config moments, class moments, a continuous edge kept wide
        edges = [("a", "label"), ("x", "label"), ("label", "y"), ("a", "y"), ("x", "z")]

    def params():
        m = FIT.fit(df, edges)
        return sorted((r["kind"], r["node"], r["config"], r["item"], r["stat"], round(r["value"], 9))
                      for r in m.params().collect())
    wide = params()
    old = FIT.LONG_MOMENTS_MIN
    FIT.LONG_MOMENTS_MIN = 1
    try:
        long = params()
    finally:
        FIT.LONG_MOMENTS_MIN = old
    assert long == wide
