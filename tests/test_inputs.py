"""Encoding, z-score, splits, CSV, metrics (H3) and the model table round trip."""

import pytest
from pyspark.sql import functions as F

from bayeslake import (accuracy, confusion, csv_round_trip, encode_codes, fit, per_label, split_key,
                       standardize)
from bayeslake.operators.fit import Model
from bayeslake.session import scratch_path


def test_encode_codes_dense_from_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "s string")
    out = encode_codes(df, {"s": "code"}).collect()
    m = {r["s"]: r["code"] for r in out}
    assert m == {"a": 0, "b": 1, "c": 2, None: None}


def test_encode_codes_many_partitions(spark):
    vals = [f"v{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in vals * 2], "s string").repartition(6)
    out = encode_codes(df, ["s"]).distinct().collect()
    assert sorted(r["s"] for r in out) == list(range(500))


def test_encode_codes_columns_share_a_scan_but_not_codes(spark):
    # two string columns with overlapping values and an int column; many
    # range partitions: each column is ranked on its own domain
    rows = [(f"v{i % 37:03d}", f"v{(i * 7) % 11 + 30:03d}", (i * 13) % 17 - 5) for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, k int").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = encode_codes(df, {"a": "ca", "b": "cb", "k": "ck"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for src, dst in (("a", "ca"), ("b", "cb"), ("k", "ck")):
        dom = sorted({r[src] for r in out})
        assert {r[src]: r[dst] for r in out} == {v: i for i, v in enumerate(dom)}


def test_standardize_keeps_names_and_order(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "k int, x double, c double")
    z = standardize(df)
    assert z.columns == ["k", "x", "c"]
    rows = z.orderBy("k").collect()
    assert rows[0]["x"] == pytest.approx(-0.70710678) and rows[1]["x"] == pytest.approx(0.70710678)
    assert rows[0]["c"] is None          # zero sd: NULL, not an ANSI error (Q25)


def test_split_key_partitions_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "key")
    tr, te = split_key(df, "key")
    assert tr.count() == 80 and te.count() == 20


def test_csv_round_trip_infers_types(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 3.0, "b")], "i int, d double, s string")
    back = csv_round_trip(df)
    assert dict(back.dtypes) == {"i": "int", "d": "double", "s": "string"}
    assert sorted(tuple(r) for r in back.collect()) == [(1, 2.5, "a"), (2, 3.0, "b")]


def test_h3_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "label int, prediction int")
    assert accuracy(df).first()["accuracy"] == pytest.approx(0.75)
    m = {r["label"]: r for r in per_label(df).collect()}
    assert m[0]["precision"] == pytest.approx(1.0)
    assert m[0]["recall"] == pytest.approx(0.6666666667)
    assert m[0]["f1"] == pytest.approx(0.8)
    assert m[1]["precision"] == pytest.approx(0.5) and m[1]["recall"] == pytest.approx(1.0)
    assert confusion(df).count() == 3


def test_model_save_load(spark, h1):
    m = fit(h1, [("d", "label"), ("c", "label")])
    path = scratch_path(spark, "model")
    m.save(path)
    m2 = Model.load(spark, path)
    assert m2.network == m.network or m2.network.edges() == m.network.edges()
    a = sorted((r["node"], tuple(r["config"]), r["value"], r["p"]) for r in m.cpt.collect())
    b = sorted((r["node"], tuple(r["config"]), r["value"], r["p"]) for r in m2.cpt.collect())
    assert a == b
    assert m2.sizes == m.sizes
    assert m.params().filter(F.col("kind") == "cpt").count() == 3 * m.cpt.count()


def test_config_grid_of_empty_and_null_columns(spark):
    from bayeslake.plans.catalog import config_grid
    df = spark.createDataFrame([(1, "x", None), (2, "y", None), (2, None, None)], "a int, b string, c int")
    got = [tuple(r) for r in config_grid(df, ["a", "b"]).orderBy("idx").collect()]
    assert got == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)]
    assert config_grid(df, ["a", "c"]).count() == 0 and config_grid(df, ["c"]).count() == 0
    assert config_grid(df.limit(0), ["a", "b"]).count() == 0
    plan = config_grid(df, ["a", "b"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Range" in plan


def test_config_grid_refuses_an_index_beyond_a_long(spark, monkeypatch):
    import pytest
    from bayeslake.plans import catalog
    monkeypatch.setattr(catalog, "domain_sizes", lambda df, cols: {c: 10**7 for c in cols})
    with pytest.raises(ValueError, match="more than a long"):
        catalog.config_grid(spark.range(1), ["a", "b", "c"])


def test_domain_sizes_count_in_two_levels_without_expanding_by_column(spark):
    from bayeslake.sources.tables import distinct_values, domain_sizes
    df = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (None, 1, None)], "a int, b int, s string")
    assert domain_sizes(df, ["a", "b", "s"]) == {"a": 2, "b": 1, "s": 1}
    assert domain_sizes(df.limit(0), ["a", "s"]) == {"a": 0, "s": 0}
    plan = distinct_values(df, ["a", "b"])._jdf.queryExecution().toString()
    assert "Expand" not in plan
