"""Line de-duplication against a dictionary, runs across tasks, bitmaps, odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayeslake.llm import catalog, line_dedup as L

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(BLANKS).translate(str.maketrans(L.UPPER, L.LOWER))


def brute(rows, min_chars, min_docs):
    held = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in catalog.op8_line_dedup(spark, SF).collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs, 40, 5)]
    assert sorted(got) == sorted(want) and any(r[2] for r in got)


@pytest.mark.parametrize("run_rows,partitions", [(200_000, 1), (200_000, 7), (3, 2), (1, 40)])
def test_hot_lines_and_odd_rows(spark, monkeypatch, run_rows, partitions):
    rng = random.Random(partitions)
    lines = ["shared LINE one", " shared line one\t", "shared line two", "short", "rare line " + "x" * 9, "", "École École École"]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for d in range(80)]
    rows += [(3, rows[3][1]), (200, "shared line one"), (200, "shared line two\nshared line one"), (None, "shared line one"),
             (300, None), (301, "")]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, keep int").repartition(4)
    monkeypatch.setattr(L, "RUN_ROWS", run_rows)
    monkeypatch.setattr(L, "shuffle_partitions", lambda s: partitions)
    got = L.dedup_lines(df, min_chars=10, min_docs=5)
    assert got.columns == ["doc_id", "text", "keep", "n_lines", "n_dropped"]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=order) == \
        sorted(brute(rows, 10, 5), key=order)


def test_empty_table_and_clashing_counts(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_lines int")
    with pytest.raises(ValueError):
        L.dedup_lines(df)
    assert L.dedup_lines(df, counts=("a", "b")).collect() == []
    assert L.dedup_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).where(F.col("text").isNull()).count() == 1


def test_bitmap_round_trip():
    drop = np.array([0, 9, 4])
    bits = L.unpack_bitmap(L.pack_bitmap(drop), 12)
    assert np.flatnonzero(~bits).tolist() == [0, 4, 9] and len(bits) == 12
