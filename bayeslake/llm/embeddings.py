"""Embedding near-duplicates: int8 tile products with error bounds.

Vectors of one label are compared with each other, in tiles. Each unit vector
u is stored as int8 codes: u = s*q + e, with the length of e known exactly.
For two vectors

    |u.v - (s_u q_u).(s_v q_v)| <= |s_u q_u| |e_v| + |e_u| |s_v q_v| + |e_u| |e_v|

so a tile product of the codes (integers, exact in float32) says which pairs
may reach the threshold; only for those are the full vectors fetched and the
cosine taken in double precision. Equal vectors are one vector with a count.
Every pair of tiles is a row of its own key, so a label that holds most of the
table is spread like any other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, ship_package, stored
from .components import components

#: Vectors in a tile, on average; an int8 tile of 64 dimensions takes 64 KB.
TILE = 1024
#: Pairs whose cosine is taken at a time.
EXACT_PAIRS = 1 << 14
#: Room for rounding in the bound (float64 sums of unit vectors).
SLACK = 1e-9

_TILES = ("label {label}, dim int, tile int, tiles int, reps array<bigint>, copies array<bigint>, codes binary, "
          "scale array<double>, norm array<double>, err array<double>, full binary")


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaling by a power of two first keeps squares of huge and tiny values finite."""
    e = np.frexp(np.abs(x).max(axis=1))[1]
    x = np.ldexp(x, -e[:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantise(u: np.ndarray):
    """int8 codes of unit rows, with scale, length of the decoded row and length of the error."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((u - back) ** 2).sum(axis=1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    ex, ey = (np.frexp(np.abs(z).max(axis=1))[1] for z in (x, y))
    x, y = np.ldexp(x, -ex[:, None]), np.ldexp(y, -ey[:, None])
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _build_tile(label_type):
    def run(table: pa.Table) -> pa.Table:
        flat = table.column("vector").combine_chunks()
        n = table.num_rows
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        q, scale, norm, err = quantise(unit_rows(x))
        first = {c: table.column(c)[0].as_py() for c in ("label", "dim", "tile", "tiles")}
        return pa.table({
            "label": pa.array([first["label"]], label_type), "dim": pa.array([first["dim"]], pa.int32()),
            "tile": pa.array([first["tile"]], pa.int32()), "tiles": pa.array([first["tiles"]], pa.int32()),
            "reps": [table.column("rep").to_pylist()], "copies": [table.column("copies").to_pylist()],
            "codes": pa.array([q.tobytes()], pa.binary()), "scale": [scale.tolist()], "norm": [norm.tolist()],
            "err": [err.tolist()], "full": pa.array([x.astype("<f8").tobytes()], pa.binary())})
    return run


def possible_pairs(a, b, same: bool, threshold: float) -> np.ndarray:
    """Mask of the pairs whose cosine may reach the threshold. a, b: codes
    (float32 rows), scale, norm, err; same: the two tiles are one."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    about = (qa @ qb.T).astype(np.float64) * sa[:, None] * sb[None, :]
    bound = na[:, None] * eb[None, :] + ea[:, None] * (nb + eb)[None, :] + SLACK
    mask = about + bound >= threshold
    return np.triu(mask, 1) if same else mask


def _candidates(threshold: float):
    def run(batches):
        for batch in batches:
            rows = {c: batch.column(j) for j, c in enumerate(batch.schema.names)}
            keep, masks = [], []
            for i in range(batch.num_rows):
                dim, ta, tb = (rows[c][i].as_py() for c in ("dim", "a", "b"))
                sides = []
                for s in "ab":
                    q = np.frombuffer(rows[f"codes_{s}"][i].as_py(), np.int8).reshape(-1, dim).astype(np.float32)
                    sides.append((q, *[rows[f"{c}_{s}"][i].values.to_numpy(zero_copy_only=False)
                                       for c in ("scale", "norm", "err")]))
                mask = possible_pairs(*sides, ta == tb, threshold)
                if mask.any():
                    keep.append(i)
                    masks.append(zlib.compress(np.packbits(mask).tobytes(), 1))
            take = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[take.column(batch.schema.names.index(c)) for c in ("label", "dim", "a", "b")],
                 pa.array(masks, pa.binary())], names=["label", "dim", "a", "b", "mask"])
    return run


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between positions i and j: each linked position's id and the
    least id that it reaches through these links."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            break
        label = new
    on = np.unique(np.concatenate([i, j]))
    return ids[on], label[on]


def _links(threshold: float):
    def run(batches):
        for batch in batches:
            rows = {c: batch.column(j) for j, c in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                dim, same = rows["dim"][r].as_py(), rows["a"][r].as_py() == rows["b"][r].as_py()
                full, reps, copies = [], [], []
                for s in "ab":
                    full.append(np.frombuffer(rows[f"full_{s}"][r].as_py(), "<f8").reshape(-1, dim))
                    reps.append(rows[f"reps_{s}"][r].values.to_numpy(zero_copy_only=False))
                    copies.append(rows[f"copies_{s}"][r].values.to_numpy(zero_copy_only=False))
                n, m = len(reps[0]), len(reps[1])
                bits = np.unpackbits(np.frombuffer(zlib.decompress(rows["mask"][r].as_py()), np.uint8))[:n * m]
                i, j = np.divmod(np.flatnonzero(bits), m)
                ok = np.zeros(len(i), bool)
                for at in range(0, len(i), EXACT_PAIRS):
                    part = slice(at, at + EXACT_PAIRS)
                    ok[part] = cosines(full[0][i[part]], full[1][j[part]]) >= threshold
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                ids = np.concatenate([reps[0], reps[1]]) if not same else reps[0]
                n_of = np.concatenate([copies[0], copies[1]]) if not same else copies[0]
                j = j if same else j + n
                links = np.bincount(i, n_of[j], len(ids)) + np.bincount(j, n_of[i], len(ids))
                own, root = forest(ids, i, j)
                count = dict(zip(ids.tolist(), links.astype(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([count[x] for x in own.tolist()], pa.int64()),
                     pa.array(root, pa.int64())], names=["rep", "links", "root"])
    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of one label and one dimension are linked when the cosine of the
    two in double precision is at least ``threshold``. A vector that is NULL,
    empty, zero or holds a NULL or non-finite component, and a row with a
    NULL label or id, links with nothing and is its own component. Each row
    counts as a vector of its own, equal ones link. Other columns are
    ignored; an empty table gives no row.
    """
    need(vectors, id_col, vector_col, label_col)
    ship_package(vectors.sparkSession)
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"),
                          F.col(label_col).alias("label"))
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
            & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    label_type = vectors.schema[label_col].dataType
    keyed = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn(
        "h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector", "label"))

    # equal vectors once, with their number
    distinct = stored(keyed.where("fine").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("vector").alias("vector")), "vectors")
    sized = distinct.withColumn("dim", F.size("vector"))
    tiles = (sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
             .select("label", "dim", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    placed = (sized.join(tiles, ["label", "dim"])
              .withColumn("tile", F.pmod(F.xxhash64("h1", "h2"), F.col("tiles")).cast("int"))
              .select("label", "dim", "tile", "tiles", "rep", "copies", "vector"))
    arrow_label = _arrow_type(label_type)
    built = stored(placed.groupBy("label", "dim", "tile", "tiles").applyInArrow(
        _build_tile(arrow_label), _TILES.format(label=label_type.simpleString())), "tiles")

    def side(name, other, columns):
        return [F.col("label"), F.col("dim"), F.col("tile").alias(name), F.explode(other).alias("ab"[name == "a"]),
                *[F.col(c).alias(f"{c}_{name}") for c in columns]]
    codes = ("codes", "scale", "norm", "err")
    left = built.select(*side("a", F.sequence("tile", F.col("tiles") - 1), codes))
    right = built.select(*side("b", F.sequence(F.lit(0), F.col("tile")), codes))
    on = ["label", "dim", "a", "b"]
    key = f"label {label_type.simpleString()}, dim int, a int, b int"
    # tile pairs are dealt out by their own key, whichever label they belong to
    cand = stored(left.join(right, on).mapInArrow(_candidates(threshold), f"{key}, mask binary"), "tile-pairs")
    full = ("reps", "copies", "full")
    fa, fb = (built.select("label", "dim", F.col("tile").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in full]) for s in "ab")
    links = stored(cand.join(fa, ["label", "dim", "a"]).join(fb, ["label", "dim", "b"])
                   .mapInArrow(_links(threshold), "rep long, links long, root long"), "vector-links")

    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(links, "rep", "root").select(F.col("id").alias("rep"), "component")
    found = (distinct.select("h1", "h2", "rep", "copies").join(counted, "rep", "left").join(comp, "rep", "left")
             .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("fine")))
    out = keyed.select("vec_id", "fine", "h1", "h2").join(found, ["fine", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _arrow_type(spark_type):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(spark_type)
