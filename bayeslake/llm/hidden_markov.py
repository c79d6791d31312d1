"""Hidden Markov language model: Baum-Welch over all training documents.

Tokens are the words of a text, A-Z in lower case, and one end. Every word is
counted over the whole training side. The latent states emit classes, and a
class emits its words in proportion to their counts:

* a word with at least one in ``2 ** FREQUENT_BITS`` of all training tokens has
  a class of its own (up to hash collisions): there can be no more of them;
* other words share a class with those of the same last three bytes, hashed;
* the end is a class, and one symbol stands for every word not seen in training.

So the latent model has a bounded size, whatever the vocabulary, while each
word's probability follows its count. For every state the probabilities of all
known words, the end and the unknown symbol sum to 1; a state gives the unknown
symbol the share of its tokens that were seen once.

Spark's part: tasks cut their documents into blocks with a dictionary each; the
dictionaries' rows meet by word, which gives the counts, and return to their
blocks; each round of Baum-Welch is one pass over the blocks whose expected
counts are added up in a tree by slices of the classes.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, pack, ship_package, stored, unpack

END = b"\n"
STATES = 8
ROUNDS = 5
SEED = 11
#: Tokens of a block, tokens whose forward values are held at a time, tokens of a segment.
BLOCK_TOKENS = 1 << 21
BATCH_TOKENS = 1 << 18
SEGMENT = 2048
FREQUENT_BITS = 14
OWN_CLASSES = 1 << 16
ENDING_CLASSES = 1 << 13
#: Class ids: unknown words, the end, frequent words, words by their ending.
UNKNOWN_CLASS, END_CLASS, FIRST_OWN = 0, 1, 2
FIRST_ENDING = FIRST_OWN + OWN_CLASSES
CLASSES = FIRST_ENDING + ENDING_CLASSES
#: Weight, in tokens, of the classes' overall shares in each state's emissions.
PRIOR_TOKENS = 20.0
#: Classes of a slice of expected counts; slice -1 has the start, transition and likelihood sums.
SLICE = 1 << 12


# ---- blocks of tokens ----------------------------------------------------------------------
BLOCK_SCHEMA = ("block long, n_train long, doc_ids array<long>, held array<boolean>, lengths array<int>, "
                "tokens binary, words array<binary>, counts array<int>")


def token_blocks(docs: DataFrame, id_col: str, text_col: str, is_held) -> DataFrame:
    """One row per block: its documents in order, their token numbers, and its dictionary."""
    limit = BLOCK_TOKENS

    def run(batches):
        first, seq = TaskContext.get().partitionId() << 32, itertools.count()
        ids, held, parts = [], [], []
        words: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        size = 0

        def block():
            nonlocal words, size
            lengths = np.array([len(p) for p in parts], np.int64)
            tokens = np.concatenate(parts)
            train = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(tokens[train], minlength=len(words))
            row = pa.RecordBatch.from_arrays(
                [pa.array([first + next(seq)], pa.int64()), pa.array([int(train.sum())], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([lengths.tolist()], pa.list_(pa.int32())), pa.array([pack(tokens)], pa.binary()),
                 pa.array([list(words)], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int32()))],
                names=["block", "n_train", "doc_ids", "held", "lengths", "tokens", "words", "counts"])
            ids.clear(), held.clear(), parts.clear()
            words, size = defaultdict(itertools.count().__next__), 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for i, h, text in zip(*[rows.column(k).to_pylist() for k in range(3)]):
                    found = (text or b"").lower().split()       # bytes: A-Z only, and exactly the six blanks
                    found.append(END)
                    parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                    ids.append(i)
                    held.append(h)
                    size += len(found)
                    if size >= limit:
                        yield block()
        if parts:
            yield block()
    return docs.select(F.col(id_col).cast("long"), is_held, F.col(text_col).cast("binary")).mapInArrow(run, BLOCK_SCHEMA)


def class_of(word, count, n_train: int):
    """Class of a word from its count: the same in every block."""
    own = F.lit(FIRST_OWN) + F.pmod(F.xxhash64(word), F.lit(OWN_CLASSES)).cast("int")
    ending = F.lit(FIRST_ENDING) + F.pmod(F.xxhash64(F.substring(word, -3, 3)), F.lit(ENDING_CLASSES)).cast("int")
    return (F.when(count == 0, F.lit(UNKNOWN_CLASS)).when(word == F.expr("X'0A'"), F.lit(END_CLASS))
            .when(count * (1 << FREQUENT_BITS) >= n_train, own).otherwise(ending))


ENCODED_SCHEMA = ("block long, doc_ids array<long>, held array<boolean>, lengths array<int>, classes binary, "
                  "n_known array<long>, log_counts array<double>, log_shares array<double>, class_ids array<int>, class_tokens array<long>, "
                  "class_once array<long>, new_words long")


def encode_blocks(blocks: DataFrame, n_train: int) -> DataFrame:
    """The blocks with classes instead of words. The dictionaries' rows meet by word,
    which has at most one row a block, and go back to their blocks with its count;
    one block tells each word, so that totals over words count it once."""
    word = Window.partitionBy("word")
    counted = (blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w"))
               .select("block", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
               .select("block", "local", "word", F.sum("n").over(word).alias("c"),
                       (F.min("block").over(word) == F.col("block")).alias("tells"))
               .select("block", "local", "c", class_of(F.col("word"), F.col("c"), n_train).alias("class"), "tells"))

    def run(left, right):
        row = {k: left.column(k)[0].as_py() for k in ("block", "doc_ids", "held", "lengths")}
        tokens = unpack(left.column("tokens")[0].as_py())
        order = np.argsort(right.column("local").to_numpy())
        c, cls, tells = (right.column(k).to_numpy()[order] for k in ("c", "class", "tells"))
        starts = np.concatenate([[0], np.cumsum(row["lengths"])[:-1]]).astype(np.int64)
        known = np.add.reduceat((c > 0).astype(np.int64)[tokens], starts)
        logs = np.add.reduceat(np.log10(c + 0.5)[tokens], starts)
        shares = np.add.reduceat(np.log10(np.maximum(c, 1))[tokens], starts)
        mine = tells & (c > 0)
        ids = np.unique(cls[mine])
        at = np.searchsorted(ids, cls[mine])
        total = np.bincount(at, c[mine], len(ids)).astype(np.int64)
        once = np.bincount(at, (c[mine] == 1).astype(float), len(ids)).astype(np.int64)
        return pa.table({
            "block": pa.array([row["block"]], pa.int64()), "doc_ids": pa.array([row["doc_ids"]], pa.list_(pa.int64())),
            "held": pa.array([row["held"]], pa.list_(pa.bool_())), "lengths": pa.array([row["lengths"]], pa.list_(pa.int32())),
            "classes": pa.array([pack(cls[tokens])], pa.binary()),
            "n_known": pa.array([known.tolist()], pa.list_(pa.int64())),
            "log_counts": pa.array([logs.tolist()], pa.list_(pa.float64())),
            "log_shares": pa.array([shares.tolist()], pa.list_(pa.float64())),
            "class_ids": pa.array([ids.tolist()], pa.list_(pa.int32())),
            "class_tokens": pa.array([total.tolist()], pa.list_(pa.int64())),
            "class_once": pa.array([once.tolist()], pa.list_(pa.int64())),
            "new_words": pa.array([int(mine.sum())], pa.int64())})
    return (blocks.select("block", "doc_ids", "held", "lengths", "tokens").groupBy("block")
            .cogroup(counted.groupBy("block")).applyInArrow(run, ENCODED_SCHEMA))


# ---- the latent model ----------------------------------------------------------------------
@dataclass
class Model:
    start: np.ndarray          # (K,)
    move: np.ndarray           # (K, K)
    emit: np.ndarray           # (classes, K)
    tokens: np.ndarray         # (classes,) training tokens
    n_train: int
    n_words: int               # distinct training tokens, the end included
    log_likelihood: float = -math.inf


def _emissions(expected: np.ndarray, tokens: np.ndarray, once: np.ndarray) -> np.ndarray:
    """(classes, K) emission probabilities; each column sums to 1."""
    total = max(1.0, float(tokens.sum()))
    per_state = expected.sum(axis=0)
    unknown = (expected * (once / np.maximum(tokens, 1))[:, None]).sum(axis=0) + 0.5
    out = (expected + PRIOR_TOKENS * (tokens / total)[:, None]) / (per_state + PRIOR_TOKENS + unknown)
    out[UNKNOWN_CLASS] = 0
    out[UNKNOWN_CLASS] = 1 - out.sum(axis=0)           # unknown / the same denominator, and all where nothing is known
    return np.maximum(out, 0)


def first_model(tokens: np.ndarray, once: np.ndarray, n_words: int, states: int) -> Model:
    """Every state near the overall shares; seeded noise tells the states apart."""
    rng = np.random.default_rng(SEED)
    noise = rng.dirichlet(np.full(states, 2.0), len(tokens))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, _emissions(noise * tokens[:, None], tokens, once),
                 tokens, int(tokens.sum()), n_words)


class Sequences:
    """Segments of a batch, longest first, laid out step by step."""

    def __init__(self, sizes: np.ndarray, starts: np.ndarray, classes: np.ndarray):
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.active = np.bincount(place)                       # segments longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.classes = np.empty(len(place), classes.dtype)
        self.classes[self.at[place] + np.repeat(np.arange(len(sizes)), sizes)] = classes[np.repeat(starts, sizes) + place]
        self.steps = len(self.active)
        self.last = self.at[sizes - 1] + np.arange(len(sizes))


class Segments:
    """Documents cut into segments of at most SEGMENT tokens that can be worked side by side.

    What enters a segment, the state probabilities before its first token, and what
    follows it, the likelihood of the rest of the document by state, are exact: they
    come from the segments' transfer matrices, multiplied along each document. So the
    recursions' steps are bounded, however long a text is.
    """

    def __init__(self, lengths: np.ndarray, classes: np.ndarray, docs: np.ndarray, model: Model):
        self.classes, self.model = classes, model
        n = -(-lengths[docs] // SEGMENT)
        self.first = np.cumsum(n) - n
        self.doc = np.repeat(docs, n)
        self.rank = np.arange(n.sum()) - np.repeat(self.first, n)
        starts = np.cumsum(lengths) - lengths
        self.starts = starts[self.doc] + self.rank * SEGMENT
        self.sizes = np.minimum(SEGMENT, lengths[self.doc] - self.rank * SEGMENT)
        states = len(model.start)
        self.before = np.tile(model.start, (len(self.doc), 1))       # of the first token's state
        self.left = np.zeros((len(self.doc), states))                # of the last state of the segment before
        self.after = np.ones((len(self.doc), states))                # likelihood of what follows, up to a factor
        self._enter(np.flatnonzero(np.repeat(n > 1, n)))

    def _enter(self, long: np.ndarray) -> None:
        if not len(long):
            return
        model, whole = self.model, np.empty((len(self.doc), len(self.model.start), len(self.model.start)))
        for some, seq in self.batches(long):
            whole[some] = transfers(seq, model)
        ranks = self.rank[long]
        for r in range(1, int(ranks.max()) + 1):
            at = long[ranks == r]
            v = np.einsum("ni,nij->nj", self.before[at - 1], whole[at - 1])
            self.left[at] = v / v.sum(axis=1, keepdims=True)
            self.before[at] = self.left[at] @ model.move
        for r in range(int(ranks.max()), 0, -1):
            at = long[ranks == r]
            v = np.einsum("nij,nj->ni", whole[at], self.after[at]) @ model.move.T
            self.after[at - 1] = v / v.max(axis=1, keepdims=True)

    def batches(self, some: np.ndarray | None = None):
        """(segments, Sequences) of about BATCH_TOKENS tokens, segments of like size together."""
        some = np.arange(len(self.doc)) if some is None else some
        some = some[np.argsort(-self.sizes[some], kind="stable")]
        ends, at = np.cumsum(self.sizes[some]), 0
        while at < len(some):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_TOKENS, "right")))
            yield some[at:stop], Sequences(self.sizes[some[at:stop]], self.starts[some[at:stop]], self.classes)
            at = stop


def transfers(seq: Sequences, model: Model) -> np.ndarray:
    """Per segment the product of its emissions and the moves between them, up to a factor."""
    k = len(model.start)
    emit = np.take(model.emit, seq.classes, axis=0)
    out = np.tile(np.eye(k), (seq.active[0], 1, 1))
    for t in range(seq.steps):
        n, lo = seq.active[t], seq.at[t]
        m = out[:n]
        if t:
            m = (m.reshape(n * k, k) @ model.move).reshape(n, k, k)
        m = m * emit[lo:lo + n, None, :]
        if t % 8 == 7:                                         # emissions are above 1e-30
            m /= m.sum(axis=(1, 2), keepdims=True)
        out[:n] = m
    return out / out.sum(axis=(1, 2), keepdims=True)


def forward(seq: Sequences, model: Model, before: np.ndarray):
    """Scaled forward values: (values, scales, emissions), step by step."""
    emit = np.take(model.emit, seq.classes, axis=0)
    alphas, scales, a = np.empty_like(emit), np.empty((len(emit), 1)), None
    ones = np.ones((emit.shape[1], 1))
    for t in range(seq.steps):
        lo, hi = seq.at[t], seq.at[t + 1]
        a = np.multiply(before if t == 0 else a[:hi - lo] @ model.move, emit[lo:hi], out=alphas[lo:hi])
        a /= np.matmul(a, ones, out=scales[lo:hi])
    return alphas, scales, emit


def log_likelihoods(lengths: np.ndarray, classes: np.ndarray, model: Model) -> np.ndarray:
    """ln P of each document's classes, by the scaled forward recursion over the whole text."""
    segments = Segments(lengths, classes, np.arange(len(lengths)), model)
    out = np.zeros(len(lengths))
    for some, seq in segments.batches():
        _, scales, _ = forward(seq, model, segments.before[some])
        row = np.arange(len(scales)) - np.repeat(seq.at[:-1], seq.active)
        out += np.bincount(segments.doc[some][row], np.log(scales[:, 0]), len(out))
    return out


def expect(lengths: np.ndarray, classes: np.ndarray, docs: np.ndarray, model: Model, counts: np.ndarray,
           moves: np.ndarray, starts: np.ndarray) -> float:
    """Add the expected counts of the documents ``docs``; returns their ln likelihood."""
    segments, total = Segments(lengths, classes, docs, model), 0.0
    for some, seq in segments.batches():
        alphas, scales, emit = forward(seq, model, segments.before[some])
        total += float(np.log(scales).sum())
        betas = np.ones_like(alphas)
        after = segments.after[some]
        betas[seq.last] = after / (alphas[seq.last] * after).sum(axis=1, keepdims=True)
        emit /= scales
        ahead = emit                                            # becomes emission x backward value / scale
        back = np.ascontiguousarray(model.move.T)
        for t in range(seq.steps - 1, -1, -1):
            lo, hi = seq.at[t], seq.at[t + 1]
            if t + 1 < seq.steps:
                n = seq.active[t + 1]
                np.matmul(ahead[hi:hi + n], back, out=betas[lo:lo + n])
            ahead[lo:hi] *= betas[lo:hi]
        row = np.arange(seq.at[1], len(alphas))
        here = alphas[row - np.repeat(seq.active[:-1], seq.active[1:])].T @ ahead[seq.at[1]:]
        later = segments.rank[some] > 0                         # meets the segment before
        here += segments.left[some][later].T @ ahead[:seq.at[1]][later]
        moves += here * model.move
        alphas *= betas                                         # expected states
        starts += alphas[:seq.at[1]][~later].sum(axis=0)
        for k, weights in enumerate(np.ascontiguousarray(alphas.T)):
            counts[:, k] += np.bincount(seq.classes, weights, len(counts))
    return total


def _block(batch, i):
    lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
    held = np.array(batch.column("held")[i].as_py(), bool)
    return lengths, held, unpack(batch.column("classes")[i].as_py())


def written(s: int, x: np.ndarray) -> bytes:
    """Class counts as four-byte numbers, the sums of slice -1 as eight."""
    return x.astype("<f8" if s < 0 else "<f4").tobytes()


def _add(rows: DataFrame, *keys: str) -> DataFrame:
    def run(key, t):
        total = sum(np.frombuffer(x.as_py(), "<f4").astype(float) if key[0].as_py() >= 0 else np.frombuffer(x.as_py(), "<f8")
                    for x in t.column("sums"))
        return pa.table({**{k: [v.as_py()] for k, v in zip(keys, key)}, "sums": [written(key[0].as_py(), total)]},
                        schema=pa.schema([pa.field(k, pa.int32()) for k in keys] + [pa.field("sums", pa.binary())]))
    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", sums binary")


def one_round(encoded: DataFrame, model: Model, once: np.ndarray, n_blocks: int) -> Model:
    """One round of Baum-Welch over every training document."""
    states = len(model.start)
    fan = max(1, math.isqrt(n_blocks))

    def run(batches):
        counts, moves, starts = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros(states)
        total = 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, held, classes = _block(batch, i)
                total += expect(lengths, classes, np.flatnonzero(~held), model, counts, moves, starts)
        group = TaskContext.get().partitionId() % fan
        slices = [(-1, np.concatenate([[total], starts, moves.ravel()]))]
        slices += [(s, counts[s * SLICE:(s + 1) * SLICE].ravel()) for s in range(-(-len(counts) // SLICE))]
        slices = [(s, x) for s, x in slices if s < 0 or x.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in slices], pa.int32()), pa.array([group] * len(slices), pa.int32()),
             pa.array([written(s, x) for s, x in slices], pa.binary())], names=["slice", "part", "sums"])
    sums = encoded.select("lengths", "held", "classes").mapInArrow(run, "slice int, part int, sums binary")
    sums = _add(_add(sums, "slice", "part").drop("part"), "slice")
    got = {r["slice"]: np.frombuffer(r["sums"], "<f8" if r["slice"] < 0 else "<f4").astype(float) for r in sums.collect()}        # classes x states numbers
    expected = np.zeros_like(model.emit)
    for s, x in got.items():
        if s >= 0:
            expected[s * SLICE:(s + 1) * SLICE] = x.reshape(-1, states)
    total = got.get(-1, np.zeros(1 + states + states * states))
    starts, moves = total[1:1 + states] + 1.0, total[1 + states:].reshape(states, states) + 1.0
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True),
                 _emissions(expected, model.tokens, once), model.tokens, model.n_train, model.n_words, float(total[0]))


def train(encoded: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, n_blocks: int = 1) -> Model:
    """Fit the latent states on all training documents of ``encoded``."""
    per_class = (encoded.select(F.explode(F.arrays_zip("class_ids", "class_tokens", "class_once")).alias("x"))
                 .groupBy("x.class_ids").agg(F.sum("x.class_tokens"), F.sum("x.class_once")).collect())
    tokens, once = np.zeros(CLASSES), np.zeros(CLASSES)            # at most CLASSES rows
    for c, n, s in per_class:
        tokens[c], once[c] = n, s
    words = encoded.agg(F.sum("new_words")).first()[0] or 0
    model = first_model(tokens, once, words, states)
    for _ in range(rounds if tokens.any() else 0):
        model = one_round(encoded, model, once, n_blocks)
    return model


SCORE_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")


def score_blocks(encoded: DataFrame, model: Model) -> DataFrame:
    """log10 probability of every document, by single words and by the model."""
    base = math.log10(model.n_train + 0.5 * (model.n_words + 1))
    with np.errstate(divide="ignore"):
        inside = np.where(model.tokens > 0, np.log10(np.maximum(model.tokens, 1)), 0.0)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, held, classes = _block(batch, i)
                logs = np.array(batch.column("log_counts")[i].as_py())
                exact = np.array(batch.column("log_shares")[i].as_py())
                starts = np.cumsum(lengths) - lengths
                score = exact - np.add.reduceat(inside[classes], starts)
                score += log_likelihoods(lengths, classes, model) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(held), pa.array(lengths),
                     batch.column("n_known")[i].values, pa.array(np.full(len(lengths), model.n_train)),
                     pa.array(logs - lengths * base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return encoded.select("doc_ids", "held", "lengths", "classes", "n_known", "log_counts", "log_shares") \
        .mapInArrow(run, SCORE_SCHEMA)


# ---- operator --------------------------------------------------------------------------------
def held_out_by_id(id_col: str = "doc_id"):
    """True where crc32 of the id's text leaves 1 when divided by 5; a NULL id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 1


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None,
                    states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Fits on all documents that are not ``held_out`` and scores all, by the exact
    likelihood of the whole text. A NULL or empty text is its end alone; each
    repeated row is a document of its own; ties cannot matter; other columns are
    ignored, whatever their names; an empty table gives no row. Where nothing is
    trained on, every token is the unknown symbol and the scores are 0.
    """
    need(docs, id_col, text_col)
    ship_package(docs.sparkSession)
    held = held_out_by_id(id_col) if held_out is None else F.coalesce(held_out, F.lit(False))
    blocks = stored(token_blocks(docs, id_col, text_col, held), "hmm-blocks")
    n_blocks, n_train = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    encoded = stored(encode_blocks(blocks, n_train), "hmm-classes")
    model = train(encoded, states=states, rounds=rounds, n_blocks=n_blocks)
    return score_blocks(encoded, model)
