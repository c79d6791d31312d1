"""Corpus-wide line de-duplication by sorted line hashes.

Keys of lines (128-bit hashes, never text) are range-partitioned and sorted by
(hash, document descending, position). A task streams its sorted rows once:
the first document of a run of equal hashes is the one that keeps the line.
A boundary of the range partitioning may fall inside a run, so a line that a
third of all documents share is spread over as many tasks as its rows need;
only the first and last run of a task can go on elsewhere, and these are
settled from one summary row each. What comes back is one compressed bitmap
of kept lines for each document that loses any, and the bitmaps are applied
in one pass over the texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, fresh, need, ship_package, shuffle_partitions, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one run that a task holds; a longer run is settled like one at a boundary.
RUN_ROWS = 200_000

_STREAMED = ("kind int, h1 long, h2 long, doc_id long, th long, pos int, part int, run int, "
             "n_docs long, last_doc long")
_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()),
                    ("th", pa.int64()), ("pos", pa.int32()), ("part", pa.int32()), ("run", pa.int32()),
                    ("n_docs", pa.int64()), ("last_doc", pa.int64())])
DROP, OPEN, RUN = 0, 1, 2       # a line to drop; a line of an unsettled run; summary of an unsettled run


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, th, pos) of every line whose key has ``min_chars``
    code points: the line without blanks at its ends, A-Z in lower case."""
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER)
    keyed = lines.select("doc_id", "th", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
                        "doc_id", "th", "pos")


def _stream(min_docs: int):
    """Stream sorted rows: settle the runs that lie inside the task."""
    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []          # rows of the current run: h1, h2, doc_id, th, pos
        state = {"run": 0, "docs": 0, "last": None, "key": None, "rows": 0, "open": True}

        def table(kind, a, run_no=0, n_docs=0, last=None):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), *[pa.array(a[:, j]) for j in range(4)],
                 pa.array(a[:, 4].astype(np.int32)), pa.array(np.full(n, part, np.int32)),
                 pa.array(np.full(n, run_no, np.int32)), pa.array(np.full(n, n_docs, np.int64)),
                 pa.array([last] * n, pa.int64())], schema=_ARROW)

        def close(last_run=False):
            """End of the current run."""
            if state["key"] is None:
                return
            rows = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
            if state["open"] or last_run:
                if len(rows):
                    yield table(OPEN, rows, state["run"])
                first = np.array([[*state["key"], state["first"], 0, 0]], np.int64)
                yield table(RUN, first, state["run"], state["docs"], state["last"])
            elif state["docs"] >= min_docs:
                drop = rows[rows[:, 2] != state["first"]]
                if len(drop):
                    yield table(DROP, drop)
            held.clear()
            state.update(run=state["run"] + 1, docs=0, last=None, rows=0, open=False)

        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            cut = np.flatnonzero((a[1:, 0] != a[:-1, 0]) | (a[1:, 1] != a[:-1, 1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(a)]):
                key = (int(a[lo, 0]), int(a[lo, 1]))
                if key != state["key"]:
                    yield from close()
                    state.update(key=key, first=int(a[lo, 2]))
                docs = a[lo:hi, 2]
                state["docs"] += int((docs[1:] != docs[:-1]).sum()) + (state["last"] != int(docs[0]))
                state["last"] = int(docs[-1])
                held.append(a[lo:hi])
                state["rows"] += hi - lo
                if state["open"] or state["rows"] > RUN_ROWS:
                    state["open"] = True
                    yield table(OPEN, np.concatenate(held), state["run"])
                    held.clear()
        yield from close(last_run=True)
    return run


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                  min_docs: int = 5, partitions: int | None = None) -> DataFrame:
    """(doc_id, th, pos) of every line to drop; th is the text's xxhash64."""
    spark = docs.sparkSession
    order = [F.col("h1").asc(), F.col("h2").asc(), F.col("doc_id").desc(), F.col("th").asc(), F.col("pos").asc()]
    # range partitioning reads its input twice, first for a sample: the keys are computed once
    keys = stored(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    streamed = stored(keys.repartitionByRange(partitions or shuffle_partitions(spark), *order)
                      .sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _STREAMED), "line-runs")
    # two runs a task at most, besides those of over RUN_ROWS rows
    runs = streamed.where(F.col("kind") == RUN)
    by_key = Window.partitionBy("h1", "h2").orderBy("part", "run")
    again = F.coalesce((F.lag("last_doc").over(by_key) == F.col("doc_id")).cast("long"), F.lit(0))
    whole = Window.partitionBy("h1", "h2")
    # the lines of a run are joined by the task's run, so a common line stays spread over its tasks
    settled = (runs.withColumn("n", F.col("n_docs") - again)
               .select("part", "run", F.sum("n").over(whole).alias("n"), F.max("doc_id").over(whole).alias("keeper"))
               .where(F.col("n") >= min_docs).select("part", "run", "keeper"))
    opened = (streamed.where(F.col("kind") == OPEN).join(settled, ["part", "run"])
              .where(F.col("doc_id") != F.col("keeper")))
    return (streamed.where(F.col("kind") == DROP).select("doc_id", "th", "pos")
            .unionByName(opened.select("doc_id", "th", "pos")))


# ---- bitmaps ----------------------------------------------------------------------------
def pack_bitmap(positions) -> bytes:
    """Compressed bitmap with the bits of the dropped lines clear."""
    positions = np.asarray(positions)
    bits = np.ones(int(positions.max()) // 8 * 8 + 8, np.uint8)     # whole bytes; later lines are all kept
    bits[positions] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
    return np.concatenate([bits, np.ones(n_lines - len(bits), np.uint8)]).astype(bool)


def _bitmaps(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1),
             pa.array([pack_bitmap(p) for p in batch.column(2).to_pylist()], pa.binary())],
            names=["doc_id", "th", "keep"])


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, th, keep): a bitmap for every document that loses a line. A
    group is the dropped lines of one document, no more than its text has."""
    ship_package(docs.sparkSession)
    return (dropped_lines(docs, **options).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("pos"))
            .mapInArrow(_bitmaps, "doc_id long, th long, keep binary"))


def _apply(text_at: int, keep_at: int, lines_at: int, dropped_at: int):
    def run(batches):
        for batch in batches:
            keep = batch.column(keep_at)
            n_lines, n_dropped = batch.column(lines_at).to_pylist(), [0] * batch.num_rows
            text = batch.column(text_at).to_pylist() if keep.null_count < len(keep) else None
            for i, b in enumerate(keep.to_pylist() if text is not None else []):
                if b is not None:
                    lines = text[i].split("\n")
                    bits = unpack_bitmap(b, len(lines))
                    text[i] = "\n".join([x for x, k in zip(lines, bits.tolist()) if k])
                    n_dropped[i] = len(lines) - int(bits.sum())
            cols = list(batch.columns)
            if text is not None:
                cols[text_at] = pa.array(text, cols[text_at].type)
            cols[lines_at] = pa.array(n_lines, pa.int64())
            cols[dropped_at] = pa.array(n_dropped, pa.int64())
            out = [c for j, c in enumerate(cols) if j != keep_at]
            yield pa.RecordBatch.from_arrays(out, names=[x for j, x in enumerate(batch.schema.names) if j != keep_at])
    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text_col``, and two long
    columns: lines before, lines dropped.

    Lines whose key (see ``line_keys``) has at least ``min_chars`` code
    points and lies in at least ``min_docs`` documents stay only in the
    largest id that holds them. Empty texts have one empty line; a NULL text
    counts as one empty line and stays NULL. Rows with a NULL id neither
    lose lines nor count as documents; rows that share an id are one
    document. All other columns are passed on; ``counts`` must not be among
    them.
    """
    need(docs, id_col, text_col)
    if set(counts) & set(docs.columns):
        raise ValueError(f"{counts} clash with columns of the table; choose other names in counts=")
    keep, th = fresh(docs, "keep_bits", "text_hash")
    marks = (keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
             .select(F.col("doc_id").alias(f"{th}_id"), F.col("th").alias(f"{th}_b"), F.col("keep").alias(keep)))
    marked = (docs.withColumn(th, F.xxhash64(F.col(text_col)))
              .join(marks, (F.col(id_col) == F.col(f"{th}_id")) & (F.col(th) == F.col(f"{th}_b")), "left")
              .select(*[F.col(f"`{c}`") for c in docs.columns], F.col(keep),
                      F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("long").alias(counts[0]),
                      F.lit(0).cast("long").alias(counts[1])))
    n = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(counts[0], T.LongType()),
                           T.StructField(counts[1], T.LongType())])
    return marked.mapInArrow(_apply(docs.columns.index(text_col), n, n + 1, n + 2), schema)
