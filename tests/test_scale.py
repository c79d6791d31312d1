"""Scale behaviour: size-checked broadcast with a shuffle fallback, a hot key
holding most rows, and plans without a shuffle of the scored rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bayeslake import fit, predict
from bayeslake.operators.predict import frequent_keys, lookup_join


def _rows(n=600):
    # key 0 holds more than a third of all rows
    out = []
    for i in range(n):
        a = 0 if i % 3 != 2 else (i % 7) + 1
        b = (i * 5) % 4
        label = (a + b + (i % 5 == 0)) % 3
        out.append((a, b, label))
    return out


def _brute_force(rows):
    """CPT of label | a, b and roots, then arg-max by hand."""
    n = len(rows)
    ca, cb = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
    fam = Counter((r[0], r[1], r[2]) for r in rows)
    tot = Counter((r[0], r[1]) for r in rows)
    cands = sorted({r[2] for r in rows})
    preds = []
    for a, b, _ in rows:
        best = None
        for k in cands:
            p = fam[(a, b, k)] / tot[(a, b)] if fam[(a, b, k)] else 0.0
            s = math.log(ca[a] / n) + math.log(cb[b] / n) + (math.log(p) if p > 0 else -math.inf)
            if best is None or s > best[0]:
                best = (s, k)
        preds.append(best[1])
    return Counter(zip(rows, preds))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_hot_key_broadcast_and_shuffle_paths_agree(spark, limit):
    rows = _rows()
    df = spark.createDataFrame(rows, "a int, b int, label int").repartition(4)
    m = fit(df, [("a", "label"), ("b", "label")])
    p = predict(m, df, "label", max_broadcast_bytes=limit)
    got = Counter(((r["a"], r["b"], r["label"]), r["prediction"]) for r in p.collect())
    assert got == _brute_force(rows)
    plan = p._jdf.queryExecution().executedPlan().toString()
    if limit == 0:
        # the scored side meets every parameter table in a shuffle join (one-row
        # parameters are subqueries, not joins)
        assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") >= 3
    else:
        assert "SortMergeJoin" not in plan


def test_fit_is_one_scan_per_chunk(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "a int, b int, label int")
    from bayeslake.operators.fit import prepare_frame, shared_scan_stats
    from bayeslake.plans.dag import Network
    net = Network.from_schema(df.schema, [("a", "label"), ("b", "label")])
    stats, where = shared_scan_stats(prepare_frame(df, net), net)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1           # 4 groupings, one scan
    assert len(where) == 4


def test_hot_key_counts_are_whole(spark):
    rows = _rows(900)
    df = spark.createDataFrame(rows, "a int, b int, label int").repartition(6)
    m = fit(df, [("a", "label"), ("b", "label")])
    got = {r["value"]: r["n"] for r in m.cpt.filter(F.col("node") == "a").collect()}
    assert got == dict(Counter(r[0] for r in rows))
    assert got[0] > len(rows) / 3
    by_cfg = defaultdict(int)
    for r in m.cpt.filter(F.col("node") == "label").collect():
        by_cfg[tuple(r["config"])] += r["n"]
    assert sum(by_cfg.values()) == len(rows)


def _partition_rows(df):
    return Counter(r["p"] for r in df.select(F.spark_partition_id().alias("p")).collect())


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("hot", ["7", "cast(null as int)"])
def test_lookup_over_the_limit_spreads_a_hot_key(spark, adaptive, hot):
    n, limit = 60_000, 64 * 1500
    df = spark.range(n, numPartitions=8).selectExpr(
        "id", f"cast(if(id % 3 = 0, {hot}, id % 3000) as int) a", "cast(if(id % 3 = 0, 1, id % 2) as int) b")
    table = spark.range(6000).selectExpr("cast(id div 2 as int) a", "cast(id % 2 as int) b", "id * 0.5 v")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = lookup_join(df, table, ["a", "b"], 6000, 1, limit)
        rows = _partition_rows(out)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["id"], r["v"]) for r in out.collect())
        want = sorted((r["id"], r["v"]) for r in df.join(table, ["a", "b"], "left").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert sum(rows.values()) == n and got == want
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    if adaptive == "false":   # with it, small partitions are put together on purpose
        assert max(rows.values()) <= 2 * n / len(rows), rows


def test_every_frequent_configuration_is_found(spark):
    df = spark.range(20_000, numPartitions=4).selectExpr("cast(if(id % 2 = 0, id % 20, id) as int) a")
    found = {r["__heavy"] for r in frequent_keys(df, ["a"], 1000).collect()}
    heavy = {r["h"] for r in df.groupBy(F.xxhash64(F.col("a").cast("long")).alias("h")).count()
             .where("count > 20000 / 48").collect()}
    assert heavy and heavy <= found and len(found) <= 32
    assert len(frequent_keys(df, ["a"], 3).collect()) <= 3
    assert frequent_keys(df.where("a < 0"), ["a"], 10).collect() == []


def test_predictions_agree_over_the_limit(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "a int, b int, label int").repartition(4)
    m = fit(df, [("a", "label"), ("b", "label")])
    p = predict(m, df, "label", max_broadcast_bytes=100)   # every table over it, some keys broadcast
    assert Counter(((r["a"], r["b"], r["label"]), r["prediction"]) for r in p.collect()) == _brute_force(rows)


def _wide_family(spark, path):
    """Ten roots, a child of all of them, one of two of them, one of that child, and a
    column without edges; with NULLs and repeated rows."""
    rng = random.Random(7)
    roots = [f"b{j}" for j in range(10)]
    cols = roots + ["all", "two", "next", "alone"]
    rows = [tuple(rng.randrange(2) if rng.random() > 0.04 else None for _ in cols) for _ in range(150)]
    spark.createDataFrame(rows * 3, ", ".join(f"`{c}` int" for c in cols)).write.parquet(path)
    edges = [(r, "all") for r in roots] + [("b0", "two"), ("b1", "two"), ("two", "next")]
    return spark.read.parquet(path), edges, cols, rows * 3


def test_columns_of_a_large_family_are_counted_with_it(spark, tmp_path):
    from bayeslake.operators.fit import ROLLED_SCAN, prepare_frame, shared_scan_stats
    df, edges, cols, rows = _wide_family(spark, str(tmp_path / "t"))
    parents = {c: [p for p, x in edges if x == c] for c in cols}
    want = Counter()
    for r in rows:
        v = dict(zip(cols, r))
        for c in cols:
            config = tuple(v[p] for p in parents[c])
            if v[c] is not None and None not in config:
                want[c, config, v[c]] += 1
    total = Counter()
    for r in rows:
        v = dict(zip(cols, r))
        for c in cols:
            total[c, tuple(v[p] for p in parents[c])] += 1
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    lazy = fit(df, edges, persist=False)
    for m in (fit(df, edges), lazy):
        got = m.cpt.collect()
        assert {(r.node, tuple(r.config), r.value): r.n for r in got} == want and len(got) == len(want)
        assert all(r.n_config == total[r.node, tuple(r.config)] and r.p == r.n / r.n_config for r in got)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    # the roots are summed from the families that hold them, and the reads do not grow with the nodes
    _, where = shared_scan_stats(prepare_frame(df, lazy.network), lazy.network)
    assert all(where[f"b{j}",][0] == ROLLED_SCAN for j in range(10)) and where["alone",][0] != ROLLED_SCAN
    assert lazy.cpt.select("*")._jdf.queryExecution().executedPlan().toString().count("FileScan") == 4


def test_a_row_counted_by_one_family_alone_is_not_multiplied(spark):
    from bayeslake.operators.fit import prepare_frame, shared_scan_stats
    from bayeslake.plans.dag import Network
    df = spark.createDataFrame([tuple(range(12))], ", ".join(f"b{j} int" for j in range(12)))
    net = Network.from_schema(df.schema, [(f"b{j}", "b11") for j in range(11)])
    stats, _ = shared_scan_stats(prepare_frame(df, net), net)
    assert "Generate" not in stats._jdf.queryExecution().executedPlan().toString()
    assert stats.count() == 1


def test_the_method_limit_is_set_back_after_an_error(spark):
    from bayeslake.session import compiled_in_parts
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    with pytest.raises(KeyError):
        with compiled_in_parts(spark):
            assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
            raise KeyError
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
