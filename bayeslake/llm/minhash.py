"""Near-duplicate texts by ProbMinHash over weighted word shingles.

A text is the set of its five-word shingles, each weighted by how often it
occurs. Every shingle is a Poisson process of arrivals whose rate is its
weight; an arrival falls into a random register, and a register keeps the
shingle that arrives first. A shingle stops when its next arrival is later
than every register's. Two texts agree in a register with the probability
Jaccard similarity

    J(A, B) = sum over shared i of 1 / sum_j max(a_j / a_i, b_j / b_i)

(Ertl, "ProbMinHash - A Class of Locality-Sensitive Hash Algorithms for the
(Probability) Jaccard Similarity", 2020). Bands of registers give buckets;
pairs from buckets are verified exactly, and the classes are the connected
components of the verified links.

Pairs are not enumerated inside a bucket. Every member is first compared with
the bucket's least member, which joins most of any large group in a number of
pairs linear in its size. In a bucket that then still spans several classes,
the members outside its largest class meet all members, block against block;
two members of the largest class are never compared again. Blocks hold registers only,
and what comes out of two of them is the list of their pairs of different classes
whose registers agree often enough. Only the texts in such lists are fetched, and
verified list by list, closest pairs first; a link makes two classes one, so only
links come out, fewer than members. A pair that shares several buckets is looked at
in the first of them. No pair that may be
similar is left unverified unless its texts are in one class already.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, need, ship_package, stored
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Registers of a signature. With 32 bands of 5 a pair of similarity 0.8 meets in a
#: bucket with probability 1 - 3e-6, a pair of 0.2 with 0.01.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Standard deviations below the threshold at which an estimate from the registers
#: rules a pair out (5.2: one in ten million pairs at the threshold).
DEVIATIONS = 5.2
#: Members of a block of a bucket that is settled, and bytes of their texts, on average.
BLOCK = 1024
BLOCK_BYTES = 1 << 23
#: Texts whose registers are filled at a time, and words whose hashes a worker remembers.
TEXTS = 256
MEMO_WORDS = 150_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64


# ---- shingles ---------------------------------------------------------------------------
class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their numbers. Words are compared
    in lower case; a text of fewer words is one shingle, one without words none."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for j in range(min(size, len(h))):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[j:j + n])
    found, count = np.unique(out, return_counts=True)
    return found, count.astype(np.float64)


def probability_jaccard(a, b) -> float:
    """Exact J of two weighted sets (hashes sorted, weights)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    every = np.union1d(ha, hb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)] = wa
    y[np.searchsorted(every, hb)] = wb
    shared = (x > 0) & (y > 0)
    if not shared.any():
        return 0.0
    # max(x_j / x_i, y_j / y_i) is the first exactly where x_j / y_j >= x_i / y_i
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio, shared = x[order], y[order], ratio[order], shared[order]
    above = np.cumsum(x[::-1])[::-1]
    below = np.concatenate([[0.0], np.cumsum(y)])
    at = np.searchsorted(ratio, ratio, "left")
    total = above[at] / x.clip(1e-300) + below[at] / y.clip(1e-300)
    return float((1 / total[shared]).sum())


# ---- registers ----------------------------------------------------------------------------
def _arrivals(h: np.ndarray, first: int, n: int):
    """Arrivals first .. first + n - 1 of each element: gaps of rate 1, and registers."""
    t = np.arange(first, first + n, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    r = mix(h[:, None] + t[None, :])
    gap = -np.log1p(-(r >> _U(11)).astype(np.float64) * 2.0 ** -53)
    register = (mix(r ^ _U(0xD1B54A32D192ED03)) >> _U(32)) * _U(REGISTERS) >> _U(32)
    return gap, register.astype(np.int64)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of REGISTERS element hashes per weighted set (an empty set: zeros)."""
    out = np.zeros((len(sets), REGISTERS), np.uint64)
    size = np.array([len(h) for h, _ in sets])
    # small sets need many arrivals of each element to fill the registers
    step = np.where(size > 0, 2 ** np.ceil(np.log2(np.maximum(1.0, 3 * REGISTERS / np.maximum(size, 1)))), 0).astype(int)
    for s in np.unique(step[step > 0]):
        group = np.flatnonzero(step == s)
        h = np.concatenate([sets[i][0] for i in group])
        rate = 1 / np.concatenate([sets[i][1] for i in group])
        doc = np.repeat(np.arange(len(group)), size[group])
        best = np.full(len(group) * REGISTERS, np.inf)
        who = np.zeros(len(group) * REGISTERS, np.uint64)
        clock, at = np.zeros(len(h)), 0
        while len(h):
            gap, register = _arrivals(h, at, int(s))
            gap[:, 0] += clock
            time = np.cumsum(gap, axis=1)
            clock, at = time[:, -1], at + int(s)
            cell = (doc[:, None] * REGISTERS + register).ravel()
            when = (time * rate[:, None]).ravel()
            np.minimum.at(best, cell, when)
            won = np.flatnonzero(best[cell] == when)
            who[cell[won]] = h[won // int(s)]
            # early termination: the next arrival of an element is later than its last one
            latest = best.reshape(-1, REGISTERS).max(axis=1)
            on = clock * rate < latest[doc]
            h, rate, doc, clock = h[on], rate[on], doc[on], clock[on]
        out[group] = who.reshape(-1, REGISTERS)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys; a key belongs to one band."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _signatures(batches):
    for batch in batches:
        keys, h1, h2 = batch.column(0), batch.column(2), batch.column(3)
        for at in range(0, batch.num_rows, TEXTS):
            sets = [shingles(t) for t in batch.column(1).slice(at, TEXTS).to_pylist()]
            has = [i for i, s in enumerate(sets) if len(s[0])]
            sig = signatures([sets[i] for i in has])
            take = pa.array(has, pa.int64())
            n = len(has)
            yield pa.RecordBatch.from_arrays(
                [c.slice(at, TEXTS).take(take) for c in (keys, h1, h2)]
                + [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()),
                                            pa.array(band_keys(sig).ravel(), pa.int64())),
                   pa.array([row.tobytes() for row in sig.astype("<u2")], pa.binary())],
                names=["doc_id", "h1", "h2", "bands", "sig"])


# ---- comparing --------------------------------------------------------------------------
def lowest_estimate(similarity: float) -> float:
    return similarity - DEVIATIONS * (similarity * (1 - similarity) / REGISTERS) ** 0.5


def _verify(similarity: float):
    def run(batches):
        last, of_last = None, None          # pairs come sorted by their first text
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for i in range(len(a)):
                if a[i] != last or of_last is None:
                    last, of_last = a[i], shingles(batch.column(2)[i].as_py())
                s = probability_jaccard(of_last, shingles(batch.column(3)[i].as_py()))
                ok.append(s >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())],
                                             names=["a", "b", "similar"])
    return run


def _near(similarity: float):
    """Pairs whose registers agree often enough to be verified."""
    low = lowest_estimate(similarity)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(j).to_pylist()), "<u2").reshape(-1, REGISTERS) for j in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= low)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
    return run


def similar_texts(a, b, similarity: float) -> bool:
    """a, b: (hashes, weights, set of hashes or None where some weight is not 1)."""
    if a[2] is None or b[2] is None:
        return probability_jaccard(a[:2], b[:2]) >= similarity - 1e-12
    small, large = sorted((len(a[2]), len(b[2])))
    if small < (similarity - 1e-12) * large:
        return False
    both = len(a[2] & b[2])                     # with weights of 1, J is shared / all
    return both >= (similarity - 1e-12) * (small + large - both)


CANDIDATES = "key long, x int, y int, a array<bigint>, ca array<bigint>, b array<bigint>, cb array<bigint>, pairs binary"
_CANDIDATES = pa.schema([("key", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), *[(c, pa.list_(pa.int64())) for c in
                         ("a", "ca", "b", "cb")], ("pairs", pa.binary())])


def _candidates(similarity: float):
    """For two blocks of a bucket the texts (ids, classes) and pairs, closest first, that are to be verified."""
    low = lowest_estimate(similarity)

    def pairs(sig, comp, bands, band, same):
        x, y, e = [], [], []
        for c in np.unique(comp[0]):
            rows, cols = np.flatnonzero(comp[0] == c), np.flatnonzero(comp[1] != c)
            if not len(cols):
                continue
            for r in rows:
                near = cols[cols > r] if same else cols
                est = (sig[1][near] == sig[0][r]).mean(axis=1)
                near, est = near[est >= low], est[est >= low]
                first = (bands[1][near] == bands[0][r]).argmax(axis=1) == band
                x.append(np.full(first.sum(), r))
                y.append(near[first])
                e.append(est[first])
        if not x:
            return np.zeros((2, 0), np.int64)
        order = np.argsort(-np.concatenate(e), kind="stable")
        return np.stack([np.concatenate(x)[order], np.concatenate(y)[order]])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, x, y, band = (batch.column(j)[i].as_py() for j in range(4))
                sides = [batch.column(j)[i].values for j in (4, 5)]
                ids, comp = ([s.field(f).to_numpy(zero_copy_only=False) for s in sides] for f in ("rep", "comp"))
                sig = [np.frombuffer(b"".join(s.field("sig").to_pylist()), "<u2").reshape(-1, REGISTERS) for s in sides]
                bands = [s.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS) for s in sides]
                found = pairs(sig, comp, bands, band, x == y)
                if not found.shape[1]:
                    continue
                used, place = zip(*(np.unique(side, return_inverse=True) for side in found))
                columns = [key, x, y]
                for side in (0, 1):
                    columns += [ids[side][used[side]], comp[side][used[side]]]
                columns.append(np.stack(place).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _CANDIDATES)], schema=_CANDIDATES)
    return run


def _settle(similarity: float):
    """Links that join the classes of a list of candidates."""
    def links(a, ca, b, cb, pairs, texts):
        sets: dict[int, tuple] = {}
        up: dict[int, int] = {}

        def top(c):
            while c in up:
                c = up[c]
            return c

        def of(rep):
            if rep not in sets:
                h, w = shingles(texts[rep].as_py())
                sets[rep] = (h, w, set(h.tolist()) if (w == 1).all() else None)
            return sets[rep]

        for i, j in zip(*np.frombuffer(pairs, "<i4").reshape(2, -1).tolist()):
            c, d = top(ca[i]), top(cb[j])
            if c != d and similar_texts(of(a[i]), of(b[j]), similarity):
                up[max(c, d)] = min(c, d)
                yield a[i], b[j]

    def run(batches):
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                a, ca, b, cb, pairs = (batch.column(j)[i].as_py() for j in range(5))
                held = batch.column(5)[i].values
                found += links(a, ca, b, cb, pairs, dict(zip(held.field("rep").to_pylist(), held.field("text"))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
    return run


def _open_links(inside: DataFrame, reps: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between classes of the open buckets ``inside``: key, band, rep, comp, size, outside."""
    def blocks(side):
        n = F.greatest(F.sum(F.when(side, 1).otherwise(0)) / BLOCK, F.sum(F.when(side, F.col("size")).otherwise(0)) / BLOCK_BYTES)
        return F.greatest(F.ceil(n), F.lit(1)).cast("int")
    outside, rep = F.col("outside"), F.xxhash64("rep")
    deal = inside.groupBy("key").agg(blocks(outside).alias("outer"), blocks(~outside).alias("inner"))
    # blocks of the members outside the largest class come first
    block = F.when(outside, F.pmod(rep, F.col("outer"))).otherwise(F.col("outer") + F.pmod(rep, F.col("inner"))).cast("int")
    block = stored(inside.join(deal, "key").withColumn("block", block).join(reps.select("rep", "sig", "bands"), "rep")
                   .groupBy("key", "band", "outer", "inner", "block")
                   .agg(F.collect_list(F.struct("rep", "comp", "sig", "bands")).alias("m")), "blocks")
    left = block.where("block < outer").select(
        "key", "band", F.col("block").alias("x"),
        F.explode(F.sequence("block", F.col("outer") + F.col("inner") - 1)).alias("y"), F.col("m").alias("mx"))
    right = block.select("key", F.explode(F.sequence(F.lit(0), F.least("block", F.col("outer") - 1))).alias("x"),
                         F.col("block").alias("y"), F.col("m").alias("my"))
    place = ["key", "x", "y"]
    found = stored(left.join(right, place).select(*place, "band", "mx", "my").mapInArrow(_candidates(similarity), CANDIDATES),
                   "candidates")
    asked = found.select(*place, F.explode(F.array_distinct(F.concat("a", "b"))).alias("rep"))
    held = asked.join(texts.select("rep", "text"), "rep").groupBy(*place).agg(F.collect_list(F.struct("rep", "text")).alias("texts"))
    return (found.join(held, place).select("a", "ca", "b", "cb", "pairs", "texts")
            .mapInArrow(_settle(similarity), "a long, b long"))


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, kept.

    Texts whose probability Jaccard over weighted shingles is at least
    ``similarity`` are linked, and so are equal texts; ``class_id`` is the
    least id reachable and ``kept`` says that the document is it. A text
    that is NULL or has no word, and a row with a NULL id, is linked with
    nothing and kept. Rows that share an id are one document. Other columns
    are ignored; an empty table gives no row.
    """
    need(docs, id_col, text_col)
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2"))
    signed = stored(rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
                    .mapInArrow(_signatures, "doc_id long, h1 long, h2 long, bands array<bigint>, sig binary"), "signatures")
    reps = stored(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
                                                 F.first("sig").alias("sig")), "texts")
    sigs = reps.select("rep", "sig")

    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    members = stored(banded.join(buckets.select("key", "least"), "key").select("key", "band", "rep", "least"), "buckets")
    # the texts of bucket members, the only ones that are shuffled whole
    used = reps.join(members.select("rep").distinct(), "rep").select("rep", F.col("rep").alias("doc_id"), "h1", "h2")
    texts = stored(rows.join(used, ["doc_id", "h1", "h2"]).select("rep", "text").dropDuplicates(["rep"])
                   .withColumn("size", F.octet_length("text")), "bucket-texts")

    # every member against the least one of its bucket
    pairs = members.where("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = (pairs.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
             .join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
             .select("a", "b", "sa", "sb").mapInArrow(_near(similarity), "a long, b long"))
    links = _test(stored(pairs, "pairs"), texts, similarity).where("similar").select("a", "b")
    labels = components(links, "a", "b")

    # buckets that still span several classes
    placed = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    spans = stored(sizes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "comp")).alias("most"))
                   .where("classes > 1").select("key", F.col("most.comp").alias("main")), "open-buckets")
    if not spans.isEmpty():
        inside = (placed.join(spans, "key").join(texts.select("rep", "size"), "rep")
                  .select("key", "band", "rep", "comp", "size", (F.col("comp") != F.col("main")).alias("outside")))
        more = _open_links(stored(inside, "open-members"), reps, texts, similarity)
        labels = components(links.unionByName(more), "a", "b")

    # rows that share an id may stand for several texts
    alias = signed.select("doc_id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"])
    named = alias.select("doc_id", "h1", "h2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    classes = named.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    out = rows.select("doc_id").join(classes, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"),
                      F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def _test(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified pairs (a, b, similar)."""
    both = (pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb"))
    return stored(both.mapInArrow(_verify(similarity), "a long, b long, similar boolean"), "verified")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of texts, all columns kept: the one with
    the least id. A text that is NULL or has no word stays.

    Where ids repeat or are NULL, rows are told apart by their id and text: a
    row goes only if another row stays for its own text, NULL ids come
    last, and of rows equal in both one stays (any, where other columns differ). An empty
    table gives no row; columns with clashing names are left alone.
    """
    need(docs, id_col, text_col)
    repeated = docs.groupBy(F.col(id_col)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if repeated.isEmpty() and docs.where(F.col(id_col).isNull()).isEmpty():
        return _without_copies(docs, id_col, text_col, options)
    number, h1, h2 = fresh(docs, "number", "h1", "h2")
    marked = docs.withColumns({h1: F.xxhash64(F.col(text_col)), h2: F.xxhash64(F.lit(1), F.col(text_col))})
    # one number for each id and text, ascending with the id; ranges depend on a sample, so they are written
    numbers = stored(marked.select(F.col(id_col).alias("i"), F.col(h1).alias("a"), F.col(h2).alias("b")).distinct()
                     .repartitionByRange(F.col("i").asc_nulls_last(), "a", "b")
                     .sortWithinPartitions(F.col("i").asc_nulls_last(), "a", "b")
                     .withColumn(number, F.monotonically_increasing_id()), "text-numbers")
    same = F.col(id_col).eqNullSafe(F.col("i")) & (F.col(h1) == F.col("a")) & (F.col(h2) == F.col("b"))
    numbered = stored(marked.join(numbers, same).select(*docs.columns, number), "numbered")
    left = _without_copies(numbered, number, text_col, options)
    has_word = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    return left.where(has_word).dropDuplicates([number]).unionByName(left.where(~has_word)).select(*docs.columns)


def _without_copies(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """``docs`` without the rows that are not kept, for ids that tell the rows' texts apart."""
    (gone,) = fresh(docs, "gone_id")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")
