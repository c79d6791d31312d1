"""Best-fit-decreasing packing of documents into fixed-length sequences.

Best-fit decreasing looks at one thing of a piece: its length. Pieces of one
length are interchangeable, so the sequential algorithm over all pieces is
carried out exactly on the histogram of lengths (at most ``capacity`` rows,
however large the corpus): a segment tree over remaining capacities finds the
tightest open bin, and a run of equal pieces goes into a run of equal bins at
once. The result is a table of placements (length, a range of ranks, a range
of bins, the place in the bin) whose size depends on the capacity alone. Each
piece then finds its own placement from its rank among the pieces of its
length; ranks are local counts plus a per-task offset, so no length, however
common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, ship_package, stored
from .tokenizing import encoder

_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long, ids binary")


# ---- best-fit decreasing on the histogram ------------------------------------------------
class OpenBins:
    """Open bins by remaining capacity, with a segment tree that says which
    capacities have any: the tightest one of at least ``need`` is found in
    logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.size, dtype=bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, capacity: int) -> None:
        at = self.size + capacity
        self.tree[at] = bool(self.runs[capacity])
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def push(self, capacity: int, first: int, n: int) -> None:
        if capacity > 0 and n > 0:
            self.runs[capacity].append((first, n))
            self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, need_: int) -> int | None:
        """Smallest capacity >= need_ with an open bin."""
        at = self.size + need_
        if self.tree[at]:
            return need_
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:      # the nearest subtree to the right
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, rank_from, rank_to, first_bin, per_bin, offset).

    The piece of that length with rank k in [rank_from, rank_to) goes to bin
    ``first_bin + (k - rank_from) // per_bin`` at
    ``offset + (k - rank_from) % per_bin * length``. Exactly the bins that
    best-fit decreasing fills when it takes the pieces one by one: a bin that
    has just been filled and still fits is the tightest, so it is filled on.
    """
    bins, out, opened = OpenBins(capacity), [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0

        def place(n, first, per_bin, offset):
            nonlocal left, rank
            out.append((length, rank, rank + n, first, per_bin, offset))
            left, rank = left - n, rank + n

        while left:
            room = bins.tightest(length)
            fresh = room is None
            if fresh:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins.pop(room)
            fits, offset = room // length, capacity - room
            full = min(n, left // fits)
            if full:
                place(full * fits, first, fits, offset)
                bins.push(room - fits * length, first, full)
            if full < n and left:
                part = left
                place(part, first + full, part, offset)
                bins.push(room - part * length, first + full, 1)
                full += 1
            bins.push(room, first + full, n - full)
    return out


# ---- pieces -----------------------------------------------------------------------------
def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: whole pieces of ``capacity``, the first
    one shorter if the length does not divide."""
    head = n % capacity
    return ([0] if head else []) + list(range(head, n, capacity))


def _pieces(path: str, end_id: int | None, capacity: int, keep_ids: bool):
    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        seen: Counter = Counter()                      # at most ``capacity`` keys
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(keys), 256):
                text = ["" if t is None else t for t in texts.slice(at, 256).to_pylist()]
                cols = [[] for _ in range(8)]
                for key, b in zip(keys.slice(at, 256).to_pylist(), enc.encode(text)):
                    b += end
                    starts = cut_points(len(b) // 4, capacity)
                    for piece, (lo, hi) in enumerate(zip(starts, starts[1:] + [len(b) // 4])):
                        ids = b[4 * lo:4 * hi]
                        row = (key, piece, lo, hi - lo, zlib.crc32(ids), part, seen[hi - lo],
                               ids if keep_ids else None)
                        seen[hi - lo] += 1
                        for c, v in zip(cols, row):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                                                           pa.int32(), pa.int64(), pa.binary()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank", "ids"])
    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int | None = None,
                   id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids,
    sequence_id, offset.

    Only documents of more than ``capacity`` ids are cut. ``ids`` (with
    ``keep_ids``) are little-endian uint32 bytes. A NULL text counts as
    empty; a document without any id (empty and no ``end_id``) has no piece;
    repeated rows are packed as often as they come; an empty table gives no
    row; other columns are ignored. Sequence ids run from 0 without gaps.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(tokenizer, end_id, capacity, keep_ids), _PIECES), "pieces")

    # pieces of each length in each writing task, and how many come before them
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))

    # at most ``capacity`` rows reach the driver; the placements depend on the
    # capacity, not on the number of documents
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.createDataFrame(
        best_fit_decreasing(histogram, capacity),
        "length long, rank_from long, rank_to long, first_bin long, per_bin long, at long")

    p = pieces if keep_ids else pieces.drop("ids")
    ranked = p.join(before, ["part", "length"]).withColumn("rank", F.col("_before") + F.col("local_rank"))
    k = F.col("rank") - F.col("rank_from")
    return (ranked.join(F.broadcast(placed), "length")
            .where((k >= 0) & (F.col("rank") < F.col("rank_to")))
            .select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []),
                    (F.col("first_bin") + F.expr("(rank - rank_from) div per_bin")).alias("sequence_id"),
                    (F.col("at") + k % F.col("per_bin") * F.col("length")).alias("offset")))


def sequences(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_ids, ids (little-endian
    uint32 bytes in place order) and doc_ids. A sequence has at most
    ``capacity`` pieces, so no group is large."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.expr("aggregate(p, 0L, (s, x) -> s + octet_length(x.ids) div 4)").alias("n_ids"),
                    F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids"),
                    F.col("p.doc_id").alias("doc_ids")))
