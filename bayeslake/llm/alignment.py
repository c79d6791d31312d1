"""Alignment of two tokenizers by galloping intersection of their token ends.

A text's two tokenisations end their tokens at byte offsets; the offsets where
both end one cut the text into groups, and tokens of one group are linked. The
shorter list of ends drives an exponential, then binary search into the longer;
the common places slice the groups, and differences of ranks give their sizes.

Both tokenizers always end a token before a space or line break that follows a
character which is not white space. So texts are cut there into parts, equal
parts are aligned once per block of documents, and a text's alignment is its
parts' alignments in order. Many parts are searched side by side.

How many documents hold a pair of ids linked is counted over the whole corpus:
tasks make blocks with a dictionary of their pairs each, the dictionaries' rows
meet by pair, and the counts return to their blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, pack, ragged, ship_package, stored, unpack
from .tokenizing import Encoder, byte_letters

MARK = "▁"
#: Text parts of a block; distinct parts, or characters of them, aligned at a time; pieces
#: of parts that a worker remembers for tokenizer A.
BLOCK_PARTS = 1 << 20
STEP_PARTS = 16384
STEP_CHARS = 1 << 20
MEMO_PIECES = 100_000
#: Groups with more links than this are counted by distinct ids instead of listed.
LISTED_LINKS = 4096
PART = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def gallop(values: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each value the first place in ends[low:high], an ascending run, that is
    not below it: from ``low`` the steps double until they pass the value, then the
    last step is halved. All values go side by side, those that have passed drop out."""
    low, probe = low.copy(), low.copy()
    step, going = 1, np.arange(len(values))
    while len(going):
        going = going[probe[going] < high[going]]
        going = going[ends[probe[going]] < values[going]]
        low[going] = probe[going] + 1
        probe[going] += step
        step *= 2
    stop, going = np.minimum(probe, high), np.arange(len(values))
    while len(going):
        going = going[low[going] < stop[going]]
        middle = (low[going] + stop[going]) // 2
        below = ends[middle] < values[going]
        low[going[below]] = middle[below] + 1
        stop[going[~below]] = middle[~below]
    return low


def common_ends(ends: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (i, j) of the offsets where a token of both sides ends, for many parts.
    ends[side]: ascending offsets of all parts' tokens, n[side]: tokens per part. In
    each part the shorter list drives the search into the longer one."""
    first = [np.cumsum(k) - k for k in n]
    both = np.concatenate(ends)
    base = len(ends[0])
    found = []
    for side, other in ((0, 1), (1, 0)):
        drives = n[side] <= n[other] if side == 0 else n[side] < n[other]
        at = ragged(first[side][drives], n[side][drives])
        low = np.repeat(first[other][drives], n[side][drives]) + base * other
        high = low + np.repeat(n[other][drives], n[side][drives])
        place = gallop(ends[side][at], low, high, both)
        hit = place < high
        hit[hit] = both[place[hit]] == ends[side][at][hit]
        pair = at[hit], place[hit] - base * other
        found.append(pair if side == 0 else pair[::-1])
    i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(i)
    return i[order], j[order]


class Aligned:
    """Alignments of parts: per part n_a, n_b, n_groups and its groups as text, each ended
    by ';'; and per link its part, its pair of ids as a number and how often it occurs."""

    def __init__(self):
        self.counts, self.texts, self.bad = [], [], []
        self.owner, self.codes, self.times = [], [], []

    def columns(self):
        n_a, n_b, n_groups = np.concatenate(self.counts, axis=1) if self.counts else np.zeros((3, 0), np.int64)
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.bad, self.owner, self.codes, self.times)]
        return n_a, n_b, n_groups, *cat


class Aligner:
    """Aligns text parts by a tokenizers file (A) and a SentencePiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.encoder = Encoder(path_a)
        self.encoder.tokenizer.encode_special_tokens = True      # their strings in a text are plain text
        letter = {c: b for b, c in byte_letters().items()}
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=False)
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            if all(c in letter for c in t):
                bytes_a[i] = bytes(letter[c] for c in t)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_b = []
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(MARK, " ").encode())
        self.bytes = bytes_a, bytes_b
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in self.bytes]
        #: An id and what follows it: ',' within a run, '|' after the A ids, ';' after the B ids.
        self.n_ids = max(map(len, self.bytes))
        self.written = [f"{i}{c}" for c in ",|;" for i in range(self.n_ids)]
        self.mark = self.model.piece_to_id(MARK)

    def _encode_a(self, parts: list[str]) -> list[np.ndarray]:
        e = self.encoder
        if len(e.memo) > MEMO_PIECES:
            e.memo, e.old = {}, {}
        return [array("I", b) for b in e.encode(parts)]

    def _encode_b(self, parts: list[str]) -> list[list[int]]:
        # the model puts a mark before a text: it stands for the part's leading space, or goes again before a line break
        out = []
        for p, ids in zip(parts, self.model.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)):
            if p == " ":
                ids = [self.mark]
            elif p[0] != " ":
                ids = ids[1:] if ids[:1] == [self.mark] else [self.model.unk_id()]
            out.append(ids)
        return out

    def align(self, parts: list[str]) -> Aligned:
        out, step, chars = Aligned(), [], 0
        at = 0
        for p in parts:
            step.append(p)
            chars += len(p)
            if len(step) == STEP_PARTS or chars > STEP_CHARS:
                self._step(step, at, out)
                at, step, chars = at + len(step), [], 0
        if step:
            self._step(step, at, out)
        return out

    def _step(self, parts: list[str], first: int, out: Aligned) -> None:
        encoded = [self._encode_a(parts), self._encode_b(parts)]
        # a part whose tokens' bytes are not its own has none
        raw = [p.encode() for p in parts]
        n, ids = self._flat(encoded)
        bad = np.zeros(len(parts), bool)
        size, whole = np.array(list(map(len, raw))), b"".join(raw)
        for side in (0, 1):
            stops = np.concatenate([[0], np.cumsum(self.sizes[side][ids[side]])])[np.cumsum(n[side])]
            if len(parts) and (not np.array_equal(stops, np.cumsum(size))
                               or b"".join(map(self.bytes[side].__getitem__, ids[side].tolist())) != whole):
                bad |= np.array([b"".join(map(self.bytes[side].__getitem__, x)) != r for x, r in zip(encoded[side], raw)], bool)
        if bad.any():
            encoded = [[[] if b else x for x, b in zip(both, bad)] for both in encoded]
            n, ids = self._flat(encoded)
        ends = [np.cumsum(s[i]) for s, i in zip(self.sizes, ids)]
        i, j = common_ends(ends, n)
        # ranks of the common ends slice the tokens into groups; their differences are the sizes
        a0, b0 = (np.concatenate([[0], x[:-1] + 1]) if len(x) else x for x in (i, j))
        size_a, size_b = i + 1 - a0, j + 1 - b0
        part = np.repeat(np.arange(len(parts)), n[0])[i]
        out.counts.append(np.stack([n[0], n[1], np.bincount(part, minlength=len(parts))]).astype(np.int64))
        out.bad.append(bad)
        self._write(ids, a0, size_a, b0, size_b, n, out)
        links = size_a * size_b
        listed = links <= LISTED_LINKS
        group = np.flatnonzero(listed)
        rank = np.arange(int(links[group].sum())) - np.repeat(np.cumsum(links[group]) - links[group], links[group])
        group = np.repeat(group, links[group])
        out.owner.append(first + part[group])
        out.codes.append(ids[0][a0[group] + rank // size_b[group]] << 32 | ids[1][b0[group] + rank % size_b[group]])
        out.times.append(np.ones(len(group), np.int64))
        for g in np.flatnonzero(~listed):               # very long groups: distinct ids and how often each occurs
            (x, m), (y, k) = (np.unique(v, return_counts=True) for v in
                              (ids[0][a0[g]:a0[g] + size_a[g]], ids[1][b0[g]:b0[g] + size_b[g]]))
            out.owner.append(np.full(len(x) * len(y), first + part[g]))
            out.codes.append((x[:, None] << 32 | y[None]).ravel())
            out.times.append((m[:, None] * k[None]).ravel())

    @staticmethod
    def _flat(encoded):
        n = [np.array(list(map(len, x)), np.int64) for x in encoded]
        return n, [np.fromiter(itertools.chain.from_iterable(x), np.int64, int(k.sum())) for x, k in zip(encoded, n)]

    def _write(self, ids, a0, size_a, b0, size_b, n, out: Aligned) -> None:
        """The parts' groups as text: every id with its separator, A and B runs in turn."""
        ends_run = np.cumsum(np.stack([size_a, size_b], 1).ravel())
        total = int(ends_run[-1]) if len(ends_run) else 0
        codes, side = np.empty(total, np.int64), np.zeros(total, bool)
        starts = ends_run - np.stack([size_a, size_b], 1).ravel()
        codes[ragged(starts[::2], size_a)] = ids[0]
        at_b = ragged(starts[1::2], size_b)
        codes[at_b] = ids[1]
        side[at_b] = True
        codes[ends_run[::2] - 1] += self.n_ids
        codes[ends_run[1::2] - 1] += 2 * self.n_ids
        words = list(map(self.written.__getitem__, codes.tolist()))
        stops = np.cumsum(n[0] + n[1]).tolist()
        out.texts += ["".join(words[a:b]) for a, b in zip([0] + stops[:-1], stops)]


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def parts_of(text: str | None) -> list[str]:
    """The parts of space + text; none for a text without tokens."""
    if not text or MARK in text:            # the model's mark reads back as a space
        return []
    return PART.findall(" " + text)


# ---- blocks ----------------------------------------------------------------------------------
BLOCK_SCHEMA = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
                "n_links array<long>, hashes array<string>, sizes array<int>, parts binary, link_counts binary, "
                "link_pairs binary, link_times binary, pairs array<long>, pair_docs array<int>")


class BlockBuilder:
    def __init__(self, first: int, aligner_: Aligner):
        self.first, self.aligner, self.seq = first, aligner_, itertools.count()
        self._clear()

    def _clear(self):
        self.local: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.tokens, self.size = [], [], 0

    def add(self, doc_id, text):
        found = parts_of(text)
        self.ids.append(doc_id)
        self.tokens.append(np.fromiter(map(self.local.__getitem__, found), np.int32, len(found)))
        self.size += len(found) + 1

    def finish(self) -> pa.RecordBatch:
        got = self.aligner.align(list(self.local))
        n_a, n_b, n_groups, bad, owner, codes, times = got.columns()
        order = np.argsort(owner, kind="stable")
        owner, codes, times = owner[order], codes[order], times[order]
        per_part = np.bincount(owner, minlength=len(n_a)).astype(np.int64)
        pairs, links = np.unique(codes, return_inverse=True)
        starts = np.cumsum(per_part) - per_part
        n_links = np.bincount(owner, times, len(n_a)).astype(np.int64)
        docs = np.zeros(len(pairs), np.int64)
        columns: list[list] = [[], [], [], [], []]
        for k, t in enumerate(self.tokens):
            if len(t) and bad[t].any():
                t = self.tokens[k] = t[:0]
            different = np.unique(t)
            docs[np.unique(links[ragged(starts[different], per_part[different])])] += 1
            for column, values in zip(columns, (n_a, n_b, n_groups, n_links)):
                column.append(int(values[t].sum()))
            text = "".join(map(got.texts.__getitem__, t.tolist()))
            columns[4].append(hashlib.sha256(text[:-1].encode()).hexdigest() if len(t) else "")
        row = [self.first + next(self.seq), self.ids, *columns, [len(t) for t in self.tokens],
               pack(np.concatenate(self.tokens)), pack(per_part), pack(links),
               times.astype("<i8").tobytes() if (times > 1).any() else b"", pairs.tolist(), docs.tolist()]
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [pa.int64(), longs, longs, longs, longs, longs, pa.list_(pa.string()), ints, pa.binary(), pa.binary(),
                 pa.binary(), pa.binary(), longs, ints]
        names = [f.strip().split(" ")[0] for f in BLOCK_SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)
        self._clear()
        return out


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    limit = BLOCK_PARTS

    def run(batches):
        block = BlockBuilder(TaskContext.get().partitionId() << 32, aligner(path_a, path_b))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    block.add(i, text)
                    if block.size >= limit:
                        yield block.finish()
        if block.ids:
            yield block.finish()
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, BLOCK_SCHEMA)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (no pair of its A id has a higher count)."""
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return (block_pairs(blocks).groupBy("pair").agg(F.sum("docs").alias("count"))
            .select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best")))


def block_pairs(blocks: DataFrame) -> DataFrame:
    return (blocks.select("block", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("local", "p"))
            .select("block", "local", F.col("p.pairs").alias("pair"), F.col("p.pair_docs").alias("docs")))


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    A text that is NULL or empty, or whose tokens' bytes are not those of space + text,
    has no tokens: zeros and ''. Each repeated row is a document of its own; ties for the
    best count are all best; other columns are ignored, whatever their names; an empty
    table gives no row.
    """
    need(docs, id_col, text_col)
    ship_package(docs.sparkSession)
    blocks = stored(aligned_blocks(docs, path_a, path_b, id_col, text_col), "aligned-blocks")
    counts = stored(pair_counts(blocks), "pair-counts")
    # named anew: the cogroup below may not see the same column on both sides
    back = block_pairs(blocks).join(counts, "pair").select(F.col("block").alias("of"), "local", "count", "best")

    def run(left, right):
        order = np.argsort(right.column("local").to_numpy())
        count, best = (right.column(k).to_numpy()[order] for k in ("count", "best"))
        tokens, per_part, links = (unpack(left.column(k)[0].as_py()) for k in ("parts", "link_counts", "link_pairs"))
        times = np.frombuffer(left.column("link_times")[0].as_py(), "<i8")
        times = times if len(times) else np.ones(len(links), np.int64)       # empty: every link once
        stops_of = np.cumsum(per_part)

        def per_text_part(values):
            total = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
            return total[stops_of] - total[stops_of - per_part]
        sums, bests = per_text_part(times * count[links]), per_text_part(times * best[links])
        sizes = np.array(left.column("sizes")[0].as_py(), np.int64)
        stops = np.cumsum(sizes)

        def per_document(values):
            total = np.concatenate([[0], np.cumsum(values[tokens])]).astype(np.int64)
            return total[stops] - total[stops - sizes]
        one = [left.column(k)[0].values for k in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*one, pa.array(per_document(bests)), pa.array(per_document(sums)), left.column("hashes")[0].values],
                        names=[f.split(" ")[0] for f in RESULT.split(", ")])
    return (blocks.drop("pairs", "pair_docs").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, RESULT))
