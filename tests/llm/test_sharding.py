"""Jump hashing against the published loop, growth, slots and odd rows."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from bayeslake.llm import catalog, sharding as S

SF = "/root/testdata/sf0.01"


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_hash_equals_the_published_loop(spark):
    keys = [0, 1, 2, 256, -1, -2, 10**18, -(1 << 63), (1 << 63) - 1, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 10, 40, 41, 129):
        got = dict(df.select("k", S.jump_hash("k", n).alias("s")).collect())
        assert got == {k: jump(k, n) for k in keys}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in catalog.op10_jump_sharding(spark, SF).collect()}
    assert len(got) == len(docs)
    slots = {}
    for d in docs:
        r, b = got[d.doc_id], (d.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(b) + 16, zlib.crc32(b), "key")
        assert (r.shard, r.grown_shard) == (jump(d.doc_id, 40), jump(d.doc_id, 41))
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())          # by id


def test_plan_is_native_and_odd_rows(spark):
    rows = [(None, None, 1), (5, "a", 2), (5, "a", 3), (5, "a", 4), (-7, "é", 5), (8, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    out = S.assign_shards(df, 2)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter([None, 5, 5, 5, -7, 8])
    assert {r["size"] for r in got if r.doc_id is None} == {16} and [r["size"] for r in got if r.doc_id == -7] == [18]
    for s in (0, 1):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert S.assign_shards(df.where(F.lit(False)), 2).collect() == []


def test_write_shards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("shard_id"))
    S.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(100))
    assert all(jump(r.doc_id, 4) == r["_shard_id"] and r.shard_id == 1 for r in back.collect())
