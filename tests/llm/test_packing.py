"""Best-fit packing against the plain sequential algorithm and whole-table invariants."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from bayeslake.llm import catalog, packing as P  # noqa: E402

SF = "/root/testdata/sf0.01"
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def sequential(lengths, capacity):
    """Best-fit decreasing one piece at a time; the sorted fill of each bin."""
    free, bins = [], []                      # free: sorted (room, bin)
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, (x, -1))
        if at == len(free):
            bins.append([x])
            room, b = capacity - x, len(bins) - 1
        else:
            room, b = free.pop(at)
            bins[b].append(x)
            room -= x
        if room:
            bisect.insort(free, (room, b))
    return bins


def expand(placements):
    bins = {}
    for length, lo, hi, first, per, at in placements:
        for k in range(hi - lo):
            bins.setdefault(first + k // per, []).append((at + k % per * length, length))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_histogram_equals_sequential(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100, 1024])
    lengths = [min(capacity, 1 + int(rng.expovariate(5 / capacity))) for _ in range(rng.randrange(1, 1500))]
    lengths += [capacity // 3 + 1] * rng.randrange(200)
    bins = expand(P.best_fit_decreasing(Counter(lengths), capacity))
    want = sequential(lengths, capacity)
    assert sorted(bins) == list(range(len(want)))
    # bins of one remaining capacity are interchangeable: fills and pieces must agree
    assert Counter(sum(x for _, x in b) for b in bins.values()) == Counter(map(sum, want))
    assert Counter(x for b in bins.values() for _, x in b) == Counter(lengths)
    for b in bins.values():
        end = 0
        for at, x in sorted(b):
            assert at == end
            end += x
        assert end <= capacity


def test_tightest_bin():
    bins = P.OpenBins(10)
    for room in (3, 7, 10):
        bins.push(room, 0, 1)
    assert [bins.tightest(n) for n in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    bins.pop(10)
    assert bins.tightest(8) is None


def check_rows(got, docs, capacity, end):
    tok = Tokenizer.from_file(BYTE)
    want = []
    for key, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        cuts = P.cut_points(len(ids), capacity)
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:] + [len(ids)])):
            want.append((key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    rows = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(rows, key=order) == sorted(want, key=order)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end_at = 0
        for at, n in sorted(s):
            assert at == end_at
            end_at += n
        assert end_at <= capacity
    assert len(seqs) == len(sequential([x[3] for x in want], capacity))


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_rows(catalog.op2_best_fit_packing(spark, SF).collect(), docs, 1024, 2)


def test_odd_rows_sequences_and_empty_table(spark):
    docs = [(1, None), (2, ""), (2, ""), (None, "a b c"), (5, "word " * 300), (6, "x"), (6, "x"), (7, "one two " * 9)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(3)
    packed = P.pack_documents(df, BYTE, capacity=32, end_id=2)
    rows = packed.collect()
    check_rows(rows, docs, 32, 2)
    seq = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in P.sequences(packed, 32).collect()}
    for r in rows:
        assert (seq[r.sequence_id][r.offset:r.offset + r.length] == np.frombuffer(bytes(r.ids), "<u4")).all()
    assert P.pack_documents(df.where(F.lit(False)), BYTE, capacity=32, end_id=2).collect() == []
    # without an end id an empty document has no piece
    assert {r.doc_id for r in P.pack_documents(df, BYTE, capacity=32).collect()} == {None, 5, 6, 7}
