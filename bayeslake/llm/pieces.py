"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text, with spaces written as the mark U+2581, is cut into marked words that
no piece of the vocabulary can cross. The distinct new words of a chunk are
sorted, which puts them in the order of a depth-first walk over their trie;
the forward values of a prefix are kept on a stack and only the characters
below the common prefix with the word before are computed.

A forward value depends on the model's kind:

* unigram: the best sum of piece scores over the prefix;
* byte-pair merges: greedy merging gives every prefix exactly one sequence of
  pieces, and a piece may follow another one just if merging the two texts'
  concatenation leaves the two apart. So the value says which piece ends the
  prefix, and a piece extends it if it agrees with that one; agreement of two
  pieces is found once, by undoing the joins along their border, and remembered.

The pieces that may end at a place are listed by a trie of the pieces. Words are cut between characters that no piece
has side by side (a letter and most punctuation), so far fewer parts are distinct.

Characters outside the vocabulary are their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, ship_package

MARK = "▁"
#: Words in each of a worker's two memos, pairs of pieces whose agreement is remembered,
#: characters encoded at a time, and the longest word kept in the memo.
MEMO_WORDS = 250_000
MEMO_PAIRS = 1_000_000
CHUNK_CHARS = 1 << 20
MEMO_CHARS = 64
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2


class Vocabulary:
    """Pieces, scores and word cutting of a model file."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), None)
        self.longest = max(map(len, self.ids), default=1)
        self.chars = {c for p in self.ids for c in p}
        self.neighbours = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        lowest = min((s for _, s, k in pieces if k == NORMAL), default=0.0)
        self.unknown_score = lowest - 10
        marks_lead = all(MARK not in p.lstrip(MARK) for p in self.ids)
        line = "" if "\n" in self.chars else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" + ("|\n+" if line else ""), re.S) \
            if marks_lead else re.compile(r".+", re.S)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode()
                    for p, _, k in pieces]

    def parts(self, word: str) -> list[str]:
        """The word, cut between characters that no piece has side by side."""
        near = self.neighbours
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in near]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0] + cuts, cuts + [len(word)])]

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type,
                   norm.add_dummy_prefix)


class Lattice:
    """Encodes sorted words over shared prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.last_join: dict[int, tuple[int, int] | None] = {}
        self.lengths = [len(p) for p, _, _ in vocabulary.pieces]
        order = {x: r for r, x in enumerate(sorted({vocabulary.scores[i] for i in vocabulary.ids.values()}, reverse=True))}
        self.rank = {p: order[vocabulary.scores[i]] for p, i in vocabulary.ids.items()}
        self._build()

    # ---- the trie of the pieces ----------------------------------------------------------
    def _build(self) -> None:
        """A trie of the pieces whose nodes know the longest other node that they end
        with (``fail``) and the longest piece that they end with (``ends``); pieces
        know the next shorter piece that they end with. So the pieces that may end
        at a place are listed longest first, without reading back over the text."""
        self.next: list[dict[str, int]] = [{}]
        self.ends, self.fail, self.shorter = [-1], [0], {}
        level: list[tuple[int, int, str, str]] = []       # node, parent, character, text
        at = {"": 0}
        for piece in sorted(self.v.ids, key=len):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in at:
                    at[piece[:k]] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.fail.append(0)
                    self.next[at[piece[:k - 1]]][piece[k - 1]] = at[piece[:k]]
                    level.append((at[piece[:k]], at[piece[:k - 1]], piece[k - 1], piece[:k]))
        ids = self.v.ids
        for node, parent, c, text in sorted(level, key=lambda e: len(e[3])):
            if parent:
                f = self.fail[parent]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[node] = self.next[f].get(c, 0)
            longest = self.ends[self.fail[node]]
            piece = ids.get(text)
            if piece is not None:
                self.shorter[piece] = longest
            self.ends[node] = longest if piece is None else piece
        #: ``next`` with the moves that go through ``fail``, filled in as they occur.
        self.moves = [dict(d) for d in self.next]

    def _move(self, node: int, c: str) -> int:
        f = node
        while f and c not in self.next[f]:
            f = self.fail[f]
        got = self.moves[node][c] = self.next[f].get(c, 0)
        return got

    # ---- greedy merging of a text ----------------------------------------------------------
    def _joins(self, text: str):
        """Joins the neighbours whose concatenation is the best-scored piece, the
        first of equal ones, until none is a piece; yields (start, middle, end)
        of each. A heap of candidate pairs over linked parts: n log n."""
        n, rank, longest = len(text), self.rank, self.v.longest
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))     # of the part that starts here; 0: none does
        # a candidate as one number: rank of its score, then its start, then its length
        wide, long = (longest + 1) * (n + 1), longest + 1
        heap = [r * wide + i * long + 2 for i in range(n - 1) if (r := rank.get(text[i:i + 2])) is not None]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            i, stop = divmod(pop(heap) % wide, long)
            stop += i
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue                                # one of the two is another part by now
            yield i, mid, stop
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                size = end[stop] - i
                if size <= longest and (r := rank.get(text[i:i + size])) is not None:
                    push(heap, r * wide + i * long + size)
            k = before[i]
            if k >= 0 and stop - k <= longest and (r := rank.get(text[k:stop])) is not None:
                push(heap, r * wide + k * long + stop - k)

    def merge(self, text: str) -> list[str]:
        ends = {i: i + 1 for i in range(len(text))}
        for i, mid, stop in self._joins(text):
            ends[i] = stop
            del ends[mid]
        return [text[i:j] for i, j in ends.items()]

    def _halves(self, i: int):
        """The two pieces whose join is the last one in merging piece ``i``; None for
        a single character. False where the joins' scores do not fall from first to
        last, or the piece is not merged whole: its joins can't be undone in order."""
        got = self.last_join.get(i, 0)
        if got == 0:
            piece, got = self.v.pieces[i][0], None
            if len(piece) > 1:
                joins = list(self._joins(piece))
                ids, scores = self.v.ids, self.v.scores
                falling = [scores[ids[piece[x:z]]] for x, _, z in joins]
                whole = len(joins) == len(piece) - 1 and falling == sorted(falling, reverse=True)
                got = (ids.get(piece[:joins[-1][1]]), ids.get(piece[joins[-1][1]:])) if whole else False
            self.last_join[i] = got
        return got

    def _stay_apart(self, a: int, b: int):
        """Whether no join across the border of two pieces comes before those
        that make them. The joins along the border are undone from the last:
        the two parts that touch there could join only while both are there,
        until a part's own next join. None where the order isn't known."""
        pieces, ids, scores = self.v.pieces, self.v.ids, self.v.scores
        until = float("-inf")
        while True:
            j = ids.get(pieces[a][0] + pieces[b][0])
            if j is not None and scores[j] >= until:
                return False if scores[j] > until else None
            left, right = self._halves(a), self._halves(b)
            if left is False or right is False or (left and None in left) or (right and None in right):
                return None
            if left is None and right is None:
                return True
            if right is None or (left is not None and scores[a] < scores[b]):
                until, a = scores[a], left[1]
            else:
                until, b = scores[b], right[0]

    def agree(self, before: int, piece: int) -> bool:
        """Do the two stay apart, and whole, when their texts are merged together?
        ``before`` is -1 where nothing binds."""
        key = before * len(self.v.pieces) + piece
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            text = self.v.pieces[piece][0]
            if before < 0:
                ok = self.merge(text) == [text]
            else:
                ok = self._stay_apart(before, piece)
                if ok is None:
                    first = self.v.pieces[before][0]
                    ok = self.merge(first + text) == [first, text]
            self.pairs[key] = ok
        return ok

    # ---- forward values -------------------------------------------------------------------
    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Piece ids of distinct words, in the depth-first order of their trie."""
        walk = self._merges if self.v.kind == MERGES else self._unigram
        out, last, state = {}, "", None
        for word in sorted(words):
            # scores of equal merges leave the choice to their place: such runs of marks are merged plainly
            if self.v.kind == MERGES and MARK + MARK in word:
                out[word] = [i for p in self.merge(word) for i in self._ids(p)]
                continue
            n = len(os.path.commonprefix((word, last)))
            out[word], state = walk(word, n, state)
            last = word
        return out

    def _merges(self, word: str, n: int, state: tuple | None):
        """forward[n]: id of the piece that ends the first n characters, -1 where
        nothing binds (the start, a character outside the vocabulary), None where
        no pieces make up the prefix; nodes[n]: the trie's node there. The first
        ``n`` values of the word before hold for this one too."""
        forward, nodes = ([-1], [0]) if state is None else state
        del forward[n + 1:], nodes[n + 1:]
        pairs, moves, ends, shorter = self.pairs, self.moves, self.ends, self.shorter
        chars, lengths, size, node = self.v.chars, self.lengths, len(self.v.pieces), nodes[n]
        for stop in range(n, len(word)):
            c = word[stop]
            step = moves[node].get(c)
            node = self._move(node, c) if step is None else step
            nodes.append(node)
            piece = ends[node]
            while piece >= 0:
                before = forward[stop + 1 - lengths[piece]]
                if before is not None:
                    ok = pairs.get(before * size + piece)
                    if ok or (ok is None and self.agree(before, piece)):
                        break                           # the only one
                piece = shorter[piece]
            if piece >= 0:
                forward.append(piece)
            else:                                       # stands alone; nothing merges across it
                forward.append(None if c in chars or forward[stop] is None else -1)
        if forward[-1] is None:
            return [i for p in self.merge(word) for i in self._ids(p)], (forward, nodes)
        ids, at = [], len(word)
        while at:
            piece = forward[at]
            if piece < 0:
                ids += reversed(self._ids(word[at - 1]))
                at -= 1
            else:
                ids.append(piece)
                at -= lengths[piece]
        ids.reverse()
        return ids, (forward, nodes)

    def _unigram(self, word: str, n: int, state: tuple | None):
        """forward[n]: (best sum of scores, start of the last piece) of the first n
        characters, None where no pieces make up the prefix."""
        forward, nodes = ([(0.0, 0)], [0]) if state is None else state
        del forward[n + 1:], nodes[n + 1:]
        v = self.v
        for stop in range(n, len(word)):
            c = word[stop]
            nodes.append(self._move(nodes[stop], c))
            best, piece = None, self.ends[nodes[-1]]
            while piece >= 0:
                start = stop + 1 - self.lengths[piece]
                before = forward[start]
                if before is not None:
                    s = before[0] + v.scores[piece]
                    if best is None or s > best[0]:     # of equal ones the longest piece
                        best = (s, start)
                piece = self.shorter[piece]
            if best is None and c not in v.ids and forward[stop] is not None:
                best = (forward[stop][0] + v.unknown_score, stop)
            forward.append(best)
        if forward[-1] is None:
            return [i for p in self.merge(word) for i in self._ids(p)], (forward, nodes)
        cuts, at = [], len(word)
        while at:
            cuts.append((forward[at][1], at))
            at = forward[at][1]
        return [i for a, b in reversed(cuts) for i in self._ids(word[a:b])], (forward, nodes)

    def _ids(self, piece: str) -> list[int]:
        i = self.v.ids.get(piece)
        if i is not None:
            return [i]
        if self.v.bytes:
            return [self.v.bytes[b] for b in piece.encode()]
        return [self.v.unknown]


class Codec:
    """Whole-text encoding and decoding with memos of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.lattice = vocabulary, Lattice(vocabulary)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian uint32 bytes."""
        out, chunk, size = [], [], 0
        for t in texts:
            chunk.append(t)
            size += len(t)
            if size > CHUNK_CHARS:
                out += self._chunk(chunk)
                chunk, size = [], 0
        return out + self._chunk(chunk)

    def _chunk(self, texts):
        """Words are looked up in the memo; new ones are cut where no piece crosses, so
        that many share their parts, and the distinct new parts make up the trie."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        lead = MARK if self.v.dummy_prefix else ""
        cut = [self.v.words.findall(lead + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*cut).difference(memo)
        known = [w for w in new if w in old]
        memo.update((w, old[w]) for w in known)
        new.difference_update(known)
        parts = {w: self.v.parts(w) for w in new}
        atoms = set().union(*parts.values())
        ids = {}
        for p in atoms:
            got = memo.get(p) or old.get(p)
            if got is not None:
                ids[p] = got
        for p, found in self.lattice.encode([p for p in atoms if p not in ids]).items():
            ids[p] = array("I", found).tobytes()
        memo.update((w, b"".join([ids[p] for p in ps])) for w, ps in parts.items())
        out = [b"".join(map(memo.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        memo.update((p, b) for p, b in ids.items() if len(p) <= MEMO_CHARS)
        return out

    def decode(self, ids: bytes) -> str:
        raw = self.v.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])
        if self.v.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(Vocabulary.load(path))
    return _CODECS[path]


# ---- DataFrame operators --------------------------------------------------------------------
def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids (little-endian uint32 bytes) of every whole text.

    A NULL or empty text has no ids; repeated rows are encoded alike; other
    columns are ignored; an empty table gives no row.
    """
    need(docs, id_col, text_col)
    ship_package(docs.sparkSession)

    def run(batches):
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = c.encode(["" if t is None else t for t in batch.column(1).slice(at, 256).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array([len(b) // 4 for b in ids], pa.int64()),
                     pa.array(ids, pa.binary())], names=["doc_id", "n_ids", "ids"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_ids long, ids binary")


def decode_documents(encoded: DataFrame, model: str, *, ids_col: str = "ids") -> DataFrame:
    """doc_id, n_ids, ids_crc32, text: the ids turned back into text. NULL ids give an empty text."""
    need(encoded, "doc_id", "n_ids", ids_col)
    ship_package(encoded.sparkSession)

    def run(batches):
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = [b or b"" for b in batch.column(2).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), batch.column(1).slice(at, 256),
                     pa.array([zlib.crc32(b) for b in ids], pa.int64()), pa.array([c.decode(b) for b in ids], pa.string())],
                    names=["doc_id", "n_ids", "ids_crc32", "text"])
    return encoded.select("doc_id", "n_ids", ids_col).mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, text string")
