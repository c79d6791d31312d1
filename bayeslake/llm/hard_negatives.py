"""Hard negatives by a GNAT-style multiway hyperplane tree.

A node of the tree has several split points; a row belongs to the subtree of its
nearest one, and each split point keeps the range of its distances to the rows
of every sibling subtree. What an anchor asks for is a window of inner products,
which with the range of a subtree's norms is an annulus of distances around it;
by the triangle inequality a sibling whose range cannot meet the annulus holds
no answer. Leaves are compared exactly, in integers.

The two upper levels are split by points of a bounded sample (``SAMPLE_ROWS``)
and index every row; the third level is built where a leaf's block is searched.
Rows of a leaf are dealt into blocks by a hash, so copies of one vector are
spread. Anchors go only to the leaves that they can't rule out; a block meets a
bounded group of anchor blocks at a time; the best of each are ranked by Spark.

Search goes twice through the tree: the anchors' positives (best inner products
of the own label: first the anchor's own leaf, whose worst kept score then rules
out others), and the negatives in the windows that the positives give.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, ship_package, stored

#: Rows from which split points are chosen, split points of a node, rows that a leaf should
#: have before its node is split further.
SAMPLE_ROWS = 4096
ARITY = 16
LEAF_ROWS = 2048
#: Rows of a block, anchors of an anchor block, anchor blocks that a block meets at a time,
#: and anchors whose products with a block are held at a time.
BLOCK_ROWS = 16384
QUERY_ROWS = 16384
QUERY_BLOCKS = 4
STEP_QUERIES = 256
#: Squared norms below this make all inner products exact in doubles.
MAX_SQUARE = 2.0 ** 53
#: Slack of the distance bounds, far above their rounding.
SLACK = 1e-6
NOTHING = -2.0 ** 60


# ---- rows ------------------------------------------------------------------------------------
def points(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float, anchor) -> DataFrame:
    """id, label, q array<long>, anchor: the rows that take part, one for each id."""
    v = F.col(vector_col)
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * F.lit(float(scale))) + 1, 2))
    sound = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
             & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                        & (F.abs(x.cast("double")) < F.lit(float("inf")))))
    got = (rows.where(sound).where(square < MAX_SQUARE)
           .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                   scaled.alias("q"), anchor.alias("anchor")))
    return (got.groupBy("id").agg(F.min(F.struct("label", "q", "anchor")).alias("r"))
            .select("id", "r.label", "r.q", F.coalesce("r.anchor", F.lit(False)).alias("anchor")))


def matrix(column, dims: int) -> np.ndarray:
    """Integer vectors as rows of doubles, short ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(d, 0))


# ---- the tree ----------------------------------------------------------------------------------
def spread_points(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` different rows far from each other: each next one is the farthest from those chosen."""
    if not len(x):
        return x
    chosen, d = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < k and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class Tree:
    """Two levels of split points; leaf = branch * ARITY + place within the branch."""

    def __init__(self, sample: np.ndarray, n_rows: int):
        self.top = spread_points(sample, ARITY)
        branch = distances(sample, self.top).argmin(1) if len(sample) else np.zeros(0, int)
        below = max(1, min(ARITY, n_rows // (ARITY * LEAF_ROWS)))
        self.sub = [spread_points(sample[branch == b], below) for b in range(len(self.top))]
        self.low, self.high, self.norms = None, None, None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        branch = distances(x, self.top).argmin(1)
        out = branch * ARITY
        for b in np.unique(branch):
            at = branch == b
            out[at] += distances(x[at], self.sub[b]).argmin(1)
        return out

    def measures(self, x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest norm, distance to each upper split point and to each of the branch's."""
        d = np.concatenate([np.sqrt((x * x).sum(1))[:, None], distances(x, self.top), distances(x, self.sub[leaf // ARITY])], 1)
        return d.min(0), d.max(0)

    def set_ranges(self, ranges: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """leaf -> least and greatest measures over all its rows."""
        m = len(self.top)
        self.leaf_ids = sorted(ranges)
        self.ranges = ranges
        self.branches = {}
        for leaf in self.leaf_ids:
            lo, hi = ranges[leaf]
            old = self.branches.get(leaf // ARITY)
            lo, hi = lo[:1 + m], hi[:1 + m]
            self.branches[leaf // ARITY] = (lo, hi) if old is None else (np.minimum(old[0], lo), np.maximum(old[1], hi))

    def bounds(self, x: np.ndarray):
        """Yields (leaf, anchors, least and greatest possible inner product with its rows); an
        anchor reaches a branch's leaves only through ``keep`` of the branch, sent back."""
        norm = np.sqrt((x * x).sum(1))
        top = distances(x, self.top)
        for b, (lo, hi) in self.branches.items():
            keep = yield None, np.arange(len(x)), *products(norm, top, lo[0], hi[0], lo[1:], hi[1:])
            if keep is None or not len(keep):
                continue
            sub = distances(x[keep], self.sub[b])
            m = len(self.top)
            for leaf in self.leaf_ids:
                if leaf // ARITY == b:
                    lo2, hi2 = self.ranges[leaf]
                    yield leaf, keep, *products(norm[keep], sub, lo2[0], hi2[0], lo2[1 + m:], hi2[1 + m:])


def products(norm, d, least_norm, greatest_norm, low, high):
    """Least and greatest inner product of anchors (norms, distances to split points) with the
    rows of a subtree (ranges of norms and of distances from the split points)."""
    near = np.maximum(np.maximum(low[None] - d, d - high[None]).max(1), 0) * (1 - SLACK) - SLACK
    far = (d + high[None]).min(1) * (1 + SLACK) + SLACK
    near = np.maximum(near, 0)
    slack = SLACK * (norm ** 2 + greatest_norm ** 2) + SLACK
    return ((norm ** 2 + least_norm ** 2 - far ** 2) / 2 - slack, (norm ** 2 + greatest_norm ** 2 - near ** 2) / 2 + slack)


# ---- routing anchors -----------------------------------------------------------------------------
ROUTED = "leaf int, qb int, n int, ids binary, labels binary, vectors binary, asks binary"


def route(anchors: DataFrame, tree: Tree, wanted, n_asks: int, dims: int) -> DataFrame:
    """Rows (leaf, qb, ...) with the anchors of a block that can't rule the leaf out.

    ``anchors``: id, label, vector, own leaf, qb, asks array<long>; ``wanted(asks, own,
    leaf, least, greatest)`` tells which anchors may have an answer between the bounds.
    """
    def run(t):
        qb = t.column("qb")[0].as_py()
        x = np.frombuffer(b"".join(t.column("vector").to_pylist()), "<i4").reshape(-1, dims).astype(float) \
            if dims else np.zeros((t.num_rows, 0))
        ids, labels, own = (t.column(k).to_numpy() for k in ("id", "label", "leaf"))
        asks = np.array(t.column("asks").to_pylist(), np.int64).reshape(len(ids), n_asks)
        out = []
        walk = tree.bounds(x)
        item = next(walk, None)
        while item is not None:
            leaf, at, least, greatest = item
            keep = at[wanted(asks[at], own[at], leaf, least, greatest)]
            if leaf is not None and len(keep):
                out.append((leaf, qb, len(keep), ids[keep].astype("<i8").tobytes(), labels[keep].astype("<i8").tobytes(),
                            x[keep].astype("<i4").tobytes(), asks[keep].astype("<i8").tobytes()))
            try:
                item = walk.send(keep if leaf is None else None)
            except StopIteration:
                item = None
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = ["leaf", "qb", "n", "ids", "labels", "vectors", "asks"]
        columns = list(zip(*out)) or [[] for _ in names]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return anchors.groupBy("qb").applyInArrow(run, ROUTED)


# ---- searching blocks ------------------------------------------------------------------------------
class Block:
    """Rows of a leaf, by their nearest of a third level of split points."""

    def __init__(self, ids, labels, x):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.points = spread_points(self.x, ARITY)
        d = distances(self.x, self.points)
        near = d.argmin(1)
        norm = np.sqrt((self.x * self.x).sum(1))
        self.parts = []
        for j in range(len(self.points)):
            at = np.flatnonzero(near == j)
            if len(at):
                self.parts.append((at, norm[at].min(), norm[at].max(), d[at].min(0), d[at].max(0)))

    def scores(self, q: np.ndarray, wanted) -> np.ndarray:
        """Inner products of anchors with the rows; -inf where the part is ruled out."""
        out = np.full((len(q), len(self.ids)), -np.inf)
        norm, d = np.sqrt((q * q).sum(1)), distances(q, self.points)
        for at, least_norm, greatest_norm, low, high in self.parts:
            keep = np.flatnonzero(wanted(*products(norm, d, least_norm, greatest_norm, low, high)))
            if len(keep):
                out[np.ix_(keep, at)] = q[keep] @ self.x[at].T
        return out


def best(scores: np.ndarray, k: int):
    """(row, column) of the ``k`` highest finite scores of each row, the first columns of equal ones."""
    rows, columns = [], []
    n = scores.shape[1]
    edge = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    for i in np.flatnonzero(scores.max(1) > -np.inf):
        at = np.flatnonzero((scores[i] >= edge[i]) & (scores[i] > -np.inf))
        if len(at) > k:
            at = at[np.argsort(-scores[i, at], kind="stable")[:k]]
        rows.append(np.full(len(at), i))
        columns.append(at)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, int), np.zeros(0, int))


def positives_of(block: Block, ids, labels, x, asks, k: int):
    """The best ``k`` other rows of the own label at or above the anchor's bound, asks[:, 0]."""
    s = block.scores(x, lambda least, greatest: greatest >= asks[:, 0])
    s[(block.labels[None] != labels[:, None]) | (block.ids[None] == ids[:, None]) | (s < asks[:, :1])] = -np.inf
    r, c = best(s, k)
    yield ids[r], np.zeros(len(r), np.int64), np.zeros(len(r), np.int64), block.ids[c], s[r, c]


def negatives_of(block: Block, ids, labels, x, asks, k: int, low: int, high: int):
    """For each window of an anchor (asks: positive ids, then their scores) the best ``k`` rows of other labels."""
    n = asks.shape[1] // 2
    scores = asks[:, n:].astype(float)
    s = block.scores(x, lambda least, greatest: in_windows(scores, least, greatest, low, high))
    s[block.labels[None] == labels[:, None]] = -np.inf
    for j in range(n):
        p = scores[:, j:j + 1]
        r, c = best(np.where((low * p <= 100 * s) & (100 * s <= high * p) & (p > NOTHING), s, -np.inf), k)
        yield ids[r], asks[r, j], asks[r, n + j], block.ids[c], s[r, c]


def in_windows(scores, least, greatest, low: int, high: int):
    """Whether [least, greatest] meets any of an anchor's windows."""
    return ((low * scores <= 100 * greatest[:, None]) & (100 * least[:, None] <= high * scores) & (scores > NOTHING)).any(1)


FOUND = "anchor long, positive long, positive_score long, found long, score long"


def search(blocks: DataFrame, routed: DataFrame, chunks: list[int], n_query_blocks: int, find, n_asks: int, dims: int) -> DataFrame:
    """Every block meets the anchors that were routed to its leaf, a few anchor blocks at a time."""
    groups = -(-n_query_blocks // QUERY_BLOCKS)
    left = blocks.select("leaf", "chunk", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qg"), "ids", "labels", "vectors")
    many = F.array(*[F.lit(c) for c in chunks])
    right = (routed.withColumn("qg", F.floor(F.col("qb") / QUERY_BLOCKS).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), many[F.col("leaf")] - 1))))

    def run(a, b):
        out = []
        if a.num_rows and b.num_rows:
            block = Block(*decode(a, 0, dims))
            for i in range(b.num_rows):
                ids, labels, x = decode(b, i, dims)
                asks = np.frombuffer(b.column("asks")[i].as_py(), "<i8").reshape(len(ids), n_asks)
                for at in range(0, len(ids), STEP_QUERIES):
                    s = slice(at, at + STEP_QUERIES)
                    out += find(block, ids[s], labels[s], x[s], asks[s])
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] or [np.zeros(0, np.int64)] * 5
        return pa.table(columns, names=["anchor", "positive", "positive_score", "found", "score"])
    return (left.groupBy("leaf", "chunk", "qg").cogroup(right.groupBy("leaf", "chunk", "qg")).applyInArrow(run, FOUND))


def decode(t, i: int, dims: int):
    ids, labels = (np.frombuffer(t.column(k)[i].as_py(), "<i8") for k in ("ids", "labels"))
    return ids, labels, np.frombuffer(t.column("vectors")[i].as_py(), "<i4").reshape(len(ids), dims).astype(float)


def build(assigned: DataFrame, tree: Tree, chunks: list[int], dims: int) -> DataFrame:
    """The leaves' blocks, each with the ranges of its rows."""
    many = F.array(*[F.lit(max(1, c)) for c in chunks])

    def run(t):
        leaf, chunk = t.column("leaf")[0].as_py(), t.column("chunk")[0].as_py()
        raw = b"".join(t.column("vector").to_pylist())
        x = np.frombuffer(raw, "<i4").reshape(t.num_rows, dims).astype(float)
        lo, hi = tree.measures(x, leaf)
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                         "ids": [t.column("id").to_numpy().astype("<i8").tobytes()],
                         "labels": [t.column("label").to_numpy().astype("<i8").tobytes()], "vectors": [raw],
                         "low": [lo.tolist()], "high": [hi.tolist()]})
    return (assigned.select("id", "label", "vector", "leaf",
                            F.pmod(F.xxhash64("id"), many[F.col("leaf")]).cast("int").alias("chunk"))
            .groupBy("leaf", "chunk").applyInArrow(
                run, "leaf int, chunk int, ids binary, labels binary, vectors binary, low array<double>, high array<double>"))


# ---- operator ------------------------------------------------------------------------------------------
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchor, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are taken as floor(``scale`` * x); a score is the integer inner product with
    the anchor, higher first, ties by smaller id. For each row where ``anchor`` holds and
    each of its first ``positives`` other rows of its label, the first ``negatives`` rows of
    other labels with low/100 * positive score <= score <= high/100 * positive score.

    Rows with a NULL id, label, vector or component, a component that is not finite, or a
    squared norm from 2^53 on (no exact inner products) take no part. Of several rows with
    one id the least (label, vector) counts. Short vectors are filled up with zeros. Other
    columns are ignored, whatever their names; an empty table, or one without anchors, gives no row.
    """
    need(rows, id_col, label_col, vector_col)
    spark = rows.sparkSession
    ship_package(spark)
    pts = stored(points(rows, id_col, label_col, vector_col, scale, anchor), "gnat-points")
    n_rows, dims, n_anchors = pts.agg(F.count(F.lit(1)), F.max(F.size("q")), F.sum(F.col("anchor").cast("long"))).first()
    if not n_rows or not n_anchors:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in RESULT.split(", "))])
    sample = pts.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("q").toArrow()      # SAMPLE_ROWS vectors
    tree = Tree(matrix(sample.column("q"), dims), n_rows)

    def place(batches):
        for b in batches:
            x = matrix(b.column(2), dims)
            flat = x.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r.tobytes() for r in flat], pa.binary()), b.column(3),
                 pa.array(tree.leaves(x) if len(x) else [], pa.int32())], names=["id", "label", "vector", "anchor", "leaf"])
    assigned = stored(pts.select("id", "label", "q", "anchor").mapInArrow(
        place, "id long, label long, vector binary, anchor boolean, leaf int"), "gnat-leaves")
    chunks = [0] * (ARITY * ARITY)
    for leaf, n in assigned.groupBy("leaf").count().collect():                # at most ARITY^2 rows
        chunks[leaf] = -(-n // BLOCK_ROWS)
    blocks = stored(build(assigned, tree, chunks, dims), "gnat-blocks")
    ranges: dict[int, tuple[list, list]] = {}
    for r in (blocks.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
              .groupBy("leaf", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).orderBy("leaf", "i").collect()):
        got = ranges.setdefault(r["leaf"], ([], []))
        got[0].append(r["low"]), got[1].append(r["high"])
    tree.set_ranges({leaf: (np.array(lo), np.array(hi)) for leaf, (lo, hi) in ranges.items()})

    n_blocks = -(-n_anchors // QUERY_ROWS)
    asking = assigned.where("anchor").select("id", "label", "vector", "leaf",
                                             F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("qb"))

    # positives: the own leaf, then every leaf that may hold one as good as the worst kept
    def near(block, ids, labels, x, asks):
        return positives_of(block, ids, labels, x, asks, positives)
    first = asking.withColumn("asks", F.array(F.lit(int(NOTHING)).cast("long")))
    at_home = search(blocks, route(first, tree, lambda asks, own, leaf, least, greatest:
                                   (own // ARITY == own // ARITY) if leaf is None else own == leaf, 1, dims),
                     chunks, n_blocks, near, 1, dims)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "found")
    at_home = stored(at_home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).drop("rank"), "gnat-near")
    bound = (at_home.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
             .select(F.col("anchor").alias("id"), F.when(F.col("n") == positives, F.col("s")).alias("s")))
    second = asking.join(bound, "id", "left").withColumn(
        "asks", F.array(F.coalesce("s", F.lit(int(NOTHING)).cast("long")))).drop("s")
    elsewhere = search(blocks, route(second, tree, lambda asks, own, leaf, least, greatest:
                                     (greatest >= asks[:, 0]) & (True if leaf is None else own != leaf), 1, dims),
                       chunks, n_blocks, near, 1, dims)
    kept = stored(at_home.unionByName(elsewhere).withColumn("rank", F.row_number().over(order))
                  .where(F.col("rank") <= positives).select("anchor", "rank", "found", "score"), "gnat-positives")

    # negatives: the windows of all of an anchor's positives at once
    places = F.sequence(F.lit(1), F.lit(positives))
    asks = (kept.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("found", "score")))).alias("p"))
            .select(F.col("anchor").alias("id"), F.concat(
                F.transform(places, lambda k: F.coalesce(F.col("p")[k]["found"], F.lit(0))),
                F.transform(places, lambda k: F.coalesce(F.col("p")[k]["score"], F.lit(int(NOTHING))))).alias("asks")))

    def wanted(asks, own, leaf, least, greatest):
        return in_windows(asks[:, positives:].astype(float), least, greatest, low, high)
    found = search(blocks, route(asking.join(asks, "id"), tree, wanted, 2 * positives, dims), chunks, n_blocks,
                   lambda *a: negatives_of(*a, negatives, low, high), 2 * positives, dims)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "found")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
