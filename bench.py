"""Benchmark: fit and predict seconds for the headline networks.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. Each phase is closed by an action: fit materialises
its parameter tables (checkpoint), predict ends in a ``noop`` write.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from bayeslake import fit, node_factor, predict  # noqa: E402
from bayeslake.plans import catalog as C  # noqa: E402
from bayeslake.session import get_spark  # noqa: E402
from bayeslake.sources.tables import split_key  # noqa: E402


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def timed(times, name, fn):
    t0 = time.perf_counter()
    out = fn()
    times[name] = round(time.perf_counter() - t0, 3)
    return out


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    times: dict[str, float] = {}

    # warm-up: JVM start, parquet footers, codegen caches
    spark.read.parquet(f"{sf}/lineitem.parquet").select(F.sum("l_quantity")).collect()

    # lineitem with integer codes (two small code tables, broadcast back)
    li = timed(times, "encode_lineitem", lambda: C.lineitem_coded(spark, sf))
    train, test = split_key(li, "l_orderkey")

    # G2: hybrid fan-in on lineitem (the worksheet shape)
    cols, edges, out = C.G2
    m2 = timed(times, "g2_fit", lambda: fit(train.select(*cols), edges))
    timed(times, "g2_predict", lambda: noop(predict(m2, test, out)))

    # G1: discrete-only CPT scoring
    cols, edges, out = C.G1
    m1 = timed(times, "g1_fit", lambda: fit(train.select(*cols), edges))
    timed(times, "g1_predict", lambda: noop(predict(m1, test, out)))

    # G3: continuous child with mixed parents (per-configuration coefficients)
    cols, edges, _ = C.G3
    m3 = timed(times, "g3_fit", lambda: fit(train.select(*cols), edges))
    timed(times, "g3_factor", lambda: noop(node_factor(m3, test, "l_extendedprice")))

    # G6: 64-feature fan-in, 10 classes
    emb = C.embeddings_wide(spark, sf)
    tr6, te6 = split_key(emb, "vec_id")
    cols, edges, out = C.G6
    m6 = timed(times, "g6_fit", lambda: fit(tr6.select(*cols), edges))
    timed(times, "g6_predict", lambda: noop(predict(m6, te6, out)))

    # the reference's largest grid point, 100k rows x 250 features x 20 classes, replicated
    # from the embeddings; generating the rows is part of both phases
    copies = max(1, 100_000 // max(1, emb.count()))
    grid = (emb.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
            .selectExpr(*[f"f{i % 64} * (1 + {i // 64}) + copy % 7 * 0.01 AS x{i}" for i in range(250)],
                        "CAST(label * 2 + copy % 2 AS INT) AS y"))
    gcols = [f"x{i}" for i in range(250)] + ["y"]
    mg = timed(times, "grid_fit", lambda: fit(grid.select(*gcols), [(c, "y") for c in gcols[:-1]]))
    timed(times, "grid_predict", lambda: noop(predict(mg, grid, "y")))

    # a thousand classes over the whole table
    many = (C.read_table(spark, sf, "lineitem")
            .selectExpr("l_orderkey", "CAST(l_linenumber AS INT) AS line", "CAST(l_partkey % 1000 AS INT) AS bucket"))
    mm = timed(times, "classes_fit", lambda: fit(many.select("line", "bucket"), [("line", "bucket")]))
    timed(times, "classes_predict", lambda: noop(predict(mm, many, "bucket", default_prob=1e-9)))

    # end-to-end harness (CSV -> z-score -> random split -> fit -> predict -> metrics)
    timed(times, "worksheet_evaluate", lambda: C.worksheet_evaluate(spark, sf).collect())

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
