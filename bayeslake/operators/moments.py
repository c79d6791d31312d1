"""Mergeable moment summaries of many continuous columns, and of many column pairs.

Each task folds its rows into one summary per group: for every column the
number, mean and sum of squared deviations of its values; for every edge x -> y
the number of rows with both, their two means and the sum of products of
deviations (a blocked Gram matrix, centred by batch). Summaries of one group
merge exactly by sums of deviations from the merged mean, so nothing cancels
however far the data lie from zero. The work per row is numpy over Arrow batches; a
row is never spread over (column, group) pairs, and the plan has the same size
whatever the number of columns and edges.

A task's summaries of one group cost 24 bytes a column. Where the groups are so
many that a task's summaries exceed ``FLUSH_CELLS`` they are passed on and begun anew.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.density import col
from ..session import kept

#: Group number of the edges' summaries; groupings of columns count from 0.
EDGES = -1
#: Cells (groups x columns) that a task folds together, and rows folded at a time.
FLUSH_CELLS = 1 << 21
FOLD_ROWS = 1 << 14
#: Summaries of one group that a task merges at once; above it a level is put between.
MERGE_FAN = 512

SUMMARY = "gid int, key array<int>, part int, n binary, a binary, b binary, c binary"
LONG = "gid int, key array<int>, j int, n double, a double, b double, c double"


def merged(order: np.ndarray, starts: np.ndarray, n, a, b, c):
    """Merge the rows of each run: counts, the two means (the same one twice for a single
    column), and the sums of products of deviations from the run's mean."""
    n, a, b, c = n[order], a[order], b[order], c[order]
    total = np.add.reduceat(n, starts)
    sizes = np.diff(np.append(starts, len(order)))
    with np.errstate(divide="ignore", invalid="ignore"):
        ma, mb = (np.add.reduceat(np.where(n > 0, n * x, 0.0), starts) / total for x in (a, b))
        da, db = (np.where(n > 0, x - np.repeat(m, sizes, axis=0), 0.0) for x, m in ((a, ma), (b, mb)))
    return total, ma, mb, np.add.reduceat(c + n * da * db, starts)


def grouped(keys: np.ndarray):
    """(order, starts of the runs of equal keys) of key rows."""
    if not keys.shape[1]:
        return np.arange(len(keys)), np.zeros(1, np.int64)
    order = np.lexsort(keys.T[::-1])
    k = keys[order]
    return order, np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(axis=1)))


class Fold:
    """A task's summaries under one grouping."""

    def __init__(self, gid: int, width: int):
        self.gid, self.width, self.parts, self.cells = gid, width, [], 0

    def add(self, keys, n, a, b, c):
        self.parts.append((keys, n, a, b, c))
        self.cells += n.size
        if self.cells > FLUSH_CELLS:
            self.compact()

    def compact(self):
        keys, *values = (np.concatenate(x) for x in zip(*self.parts))
        order, starts = grouped(keys)
        self.parts = [(keys[order][starts], *merged(order, starts, *values))]
        self.cells = self.parts[0][1].size

    def rows(self):
        """Merged summaries, ready to be passed on; the fold is empty after it."""
        if not self.parts:
            return []
        self.compact()
        (keys, n, a, b, c), self.parts, self.cells = self.parts[0], [], 0
        return [(self.gid, key, n[i], a[i], b[i], c[i]) for i, key in enumerate(keys.tolist())]

    def total(self):
        """The summary of all groups together."""
        self.compact()
        keys, *values = self.parts[0]
        return merged(np.arange(len(keys)), np.zeros(1, np.int64), *values)


NULL_KEY = np.iinfo(np.int64).min


def values_of(batch, names) -> np.ndarray:
    """Columns as a matrix, NaN where NULL."""
    out = np.empty((batch.num_rows, len(names)))
    for j, c in enumerate(names):
        out[:, j] = batch.column(c).to_numpy(zero_copy_only=False)
    return out


def keys_of(batch, names) -> np.ndarray:
    """Key columns as whole numbers, NULL_KEY where NULL."""
    out = np.empty((batch.num_rows, len(names)), np.int64)
    for j, c in enumerate(names):
        column = batch.column(c).cast(pa.int64())
        out[:, j] = column.fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False)
    return out


def by_group(x: np.ndarray, order, starts):
    """(n, mean, sum of squared deviations) of each column in each run of rows; NaN counts as missing."""
    x = x[order]
    there = ~np.isnan(x)
    n = np.add.reduceat(there.astype(float), starts)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.add.reduceat(np.where(there, x, 0.0), starts) / n
        d = np.where(there, x - np.repeat(mean, np.diff(np.append(starts, len(x))), axis=0), 0.0)
        return n, mean, np.add.reduceat(d * d, starts)


def by_edge(x: np.ndarray, blocks, n_edges: int):
    """(n, mean of x, mean of y, sum of products of deviations) of each edge over the rows
    with both. ``blocks``: (parent columns, child columns, edge numbers parents x children)."""
    there = ~np.isnan(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        z = np.where(there, x - centre, 0.0)
        m = there.astype(float)
        n, a, b, c = (np.zeros(n_edges) for _ in range(4))
        for parents, children, edges in blocks:
            k = m[:, parents].T @ m[:, children]
            sx, sy = z[:, parents].T @ m[:, children], m[:, parents].T @ z[:, children]
            n[edges] = k
            a[edges] = sx / k + centre[parents][:, None]
            b[edges] = sy / k + centre[children][None]
            c[edges] = np.where(k > 0, z[:, parents].T @ z[:, children] - sx * sy / np.maximum(k, 1), 0.0)
    return n, a, b, c


def summarise(X: DataFrame, columns: list[str], groupings: list[tuple[tuple[str, ...], list[int]]],
              roots: int | None, edges: list[tuple[int, int]]) -> DataFrame:
    """Summaries of the tasks.

    ``columns``: the continuous columns; ``groupings``: key columns and the places of the
    columns wanted under that key, grouping ``i`` having gid ``i``; ``roots``: a gid for all
    columns without a key, whose summaries are merged upwards from the widest grouping's
    (each row is in one of its groups, NULL keys included); ``edges``: pairs of places.
    """
    key_columns = sorted({c for k, _ in groupings for c in k})
    wide = max(range(len(groupings)), key=lambda i: len(groupings[i][1]), default=None)
    covered = set(groupings[wide][1]) if wide is not None else set()
    rest = [j for j in range(len(columns)) if j not in covered]
    of_child: dict[int, list[tuple[int, int]]] = {}
    for e, (x, y) in enumerate(edges):
        of_child.setdefault(y, []).append((x, e))
    same: dict[tuple, list[int]] = {}
    for y, xs in of_child.items():
        same.setdefault(tuple(x for x, _ in xs), []).append(y)
    blocks = [(np.array(xs), np.array(ys), np.array([[e for _, e in of_child[y]] for y in ys]).T) for xs, ys in same.items()]

    def run(batches):
        part = TaskContext.get().partitionId()
        folds = [Fold(g, len(js)) for g, (_, js) in enumerate(groupings)]
        root, pairs = Fold(roots, len(columns)), Fold(EDGES, len(edges))

        def rows_out():
            out = []
            if roots is not None:
                whole = [np.zeros(len(columns)) for _ in range(4)]
                whole[1][:] = whole[2][:] = np.nan
                if wide is not None and folds[wide].parts:
                    for w, v in zip(whole, folds[wide].total()):
                        w[groupings[wide][1]] = v[0]
                if rest and root.parts:
                    for w, v in zip(whole, root.total()):
                        w[rest] = v[0]
                out.append((roots, [], *whole))
            root.parts, root.cells = [], 0
            for f in (*folds, pairs):
                out += f.rows()
            kinds = [pa.int32(), pa.list_(pa.int32()), pa.int32()] + [pa.binary()] * 4
            columns_out = [[r[0] for r in out], [[None if v == NULL_KEY else v for v in r[1]] for r in out], [part] * len(out)]
            columns_out += [[r[k].astype("<f8").tobytes() for r in out] for k in range(2, 6)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_out, kinds)],
                                              names=["gid", "key", "part", "n", "a", "b", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, FOLD_ROWS):
                rows = batch.slice(at, FOLD_ROWS)
                x, keys = values_of(rows, columns), keys_of(rows, key_columns)
                for f, (key, js) in zip(folds, groupings):
                    k = keys[:, [key_columns.index(c) for c in key]]
                    order, starts = grouped(k)
                    n, mean, m2 = by_group(x[:, js], order, starts)
                    f.add(k[order][starts], n, mean, mean, m2)
                none = np.zeros((1, 0), np.int64)
                if roots is not None and rest:
                    n, mean, m2 = by_group(x[:, rest], np.arange(len(x)), np.zeros(1, np.int64))
                    root.add(none, n, mean, mean, m2)
                if edges:
                    pairs.add(none, *(v[None] for v in by_edge(x, blocks, len(edges))))
                if sum(f.cells for f in folds) > FLUSH_CELLS:
                    yield rows_out()
        yield rows_out()
    return X.select(*[col(c) for c in dict.fromkeys([*columns, *key_columns])]).mapInArrow(run, SUMMARY)


def merge(summary: DataFrame) -> DataFrame:
    """LONG rows (gid, key, j, n, a, b, c) of the groups: j is the place within the
    grouping's columns, or the edge; a and b the means, c the sum of products of deviations."""
    def stacked(t):
        return [np.stack([np.frombuffer(v.as_py(), "<f8") for v in t.column(k)]) for k in "nabc"]

    def level(key, t):
        n, a, b, c = merged(np.arange(t.num_rows), np.zeros(1, np.int64), *stacked(t))
        gid, group, part = (k.as_py() for k in key)
        return pa.table({"gid": pa.array([gid], pa.int32()), "key": pa.array([group], pa.list_(pa.int32())),
                         "part": pa.array([part], pa.int32()),
                         **{k: [v[0].tobytes()] for k, v in zip("nabc", (n, a, b, c))}})

    def last(key, t):
        values = merged(np.arange(t.num_rows), np.zeros(1, np.int64), *stacked(t))
        gid, group = (k.as_py() for k in key)
        m = values[0].shape[1]
        there = values[0][0] > 0
        return pa.table({"gid": pa.array([gid] * m, pa.int32()), "key": pa.array([group] * m, pa.list_(pa.int32())),
                         "j": pa.array(range(m), pa.int32()), "n": values[0][0],
                         **{k: pa.array(v[0], mask=~there) for k, v in zip("abc", values[1:])}})
    parts = summary.agg(F.max("part")).first()[0] or 0
    if parts >= MERGE_FAN:
        summary = (summary.withColumn("part", F.col("part") % F.lit(int((parts + 1) ** 0.5)))
                   .groupBy("gid", "key", "part").applyInArrow(level, SUMMARY))
    return summary.groupBy("gid", "key").applyInArrow(last, LONG)


def column_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(j, n, mean, sd): moments of the columns over all rows; NULL and NaN are missing."""
    X = df.select(*[F.nullif(col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])
    long = merge(kept(summarise(X, columns, [], 0, [])))
    return long.select("j", "n", F.col("a").alias("mean"), sample_sd(F.col("n"), F.col("c")).alias("sd"))


def sample_sd(n, m2):
    """Sample standard deviation; NULL for fewer than two values."""
    return F.when(n > 1, F.sqrt(m2 / (n - 1)))


# Workers need no copy of this package: what they run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
