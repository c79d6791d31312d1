"""Whole-text encoding with the tokenizers library inside Python workers.

A text is cut at white space, and before punctuation that ends a plain word,
into pieces that the tokenizer's own pre-tokenizer never joins. Each distinct
piece is encoded once per worker by the library, and a text's ids are the
concatenation. A plain word or a run of plain punctuation is one pre-token,
so the library's model takes it directly. Where the tokenizer removes white
space, Arrow finds a chunk's distinct words and cuts these, so Python sees a
piece once a chunk and not once an occurrence. Tokenizers of another shape, and
texts with the four separators U+001C..U+001F on which the library and Python
disagree about white space, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

#: Pieces in each of a worker's two memos. When the young one is full it becomes
#: the old one, so pieces that go on being used stay and the rest is forgotten.
MEMO_PIECES = 400_000
#: Longer pieces are encoded each time, so one memo entry stays small.
MEMO_CHARS = 64
#: Characters split at a time, which bounds the piece lists in memory, and pieces
#: given to the library at a time, which bounds its results.
CHUNK_CHARS = 1 << 20
#: The same where Arrow holds the words: larger chunks repeat fewer of them.
WORD_CHUNK_CHARS = 1 << 22
LIBRARY_PIECES = 8192

# Letters whose lower case is one letter and whose normal form is themselves.
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_MARKS = ".,;:!?"
_MARK = f"[{_MARKS}]"
_LETTERS = "".join(c for c in map(chr, range(256)) if re.fullmatch(_LETTER, c))
# White space removed by the tokenizer; or one space belongs to the next word.
_DROPPED = re.compile(rf"{_LETTER}+(?={_MARK}*(?:\s|\Z))|{_MARK}+(?=\s|\Z)|\S+")
_LEADING = re.compile(rf" ?{_LETTER}+(?={_MARK}*(?:\s|\Z))|{_MARK}+(?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf" ?{_LETTER}+|{_MARK}+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_ENCODERS: dict[str, "Encoder"] = {}


def split_pattern(spec: dict):
    """Pattern whose matches can be encoded apart from each other, or None."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"])
           for t in spec.get("added_tokens") or []):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return _LEADING
    parts = [p.get("type") for p in pre.get("pretokenizers", [])]
    if (parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("behavior") == "Removed"
            and pre["pretokenizers"][0].get("invert")
            and r"[^\s\p{L}\p{N}]+" in pre["pretokenizers"][0]["pattern"].get("Regex", "")
            and {n.get("type") for n in norm.get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}):
        return _DROPPED
    return None


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = split_pattern(spec)
        self.added = [t["content"].lower() for t in spec.get("added_tokens") or []]
        self.lower = self.pattern is _DROPPED
        self.letters = byte_letters()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for at in range(0, len(texts), LIBRARY_PIECES)
                for e in self.tokenizer.encode_batch_fast(texts[at:at + LIBRARY_PIECES], add_special_tokens=False)]

    def _lower(self, text: str) -> str:
        """The text as the tokenizer's own lower case makes it, where Python's
        is sure to agree (Latin-1 text), so that fewer pieces are distinct."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(t in low for t in self.added) else low

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Distinct pieces: plain ones by the model, the others by the whole library."""
        out = dict.fromkeys(pieces, b"")
        other = []
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for w in pieces:
            if _PLAIN.fullmatch(w):
                token = (w.lower() if self.lower else w).encode().decode("latin-1").translate(letters)
                out[w] = array("I", [t.id for t in tokenize(token)]).tobytes()
            else:
                other.append(w)
        out.update(zip(other, self._library(other)))
        return list(out.values())

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.pattern is None:
            return [b for t in texts for b in self._library([t])]
        out: list[bytes] = []
        chunk: list[str] = []
        size, most = 0, WORD_CHUNK_CHARS if self.lower else CHUNK_CHARS
        for t in texts:
            chunk.append(t)
            size += len(t)
            if size >= most:
                out += self._chunk(chunk)
                chunk, size = [], 0
        return out + self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.old = {}, self.memo
        if self.lower:
            texts = [self._lower(t) for t in texts]
        whole = {i: self._library([t])[0] for i, t in enumerate(texts) if _ODD_SPACE.search(t)}
        texts = ["" if i in whole else t for i, t in enumerate(texts)]
        out = self._by_words(texts) if self.lower else self._by_pieces(texts)
        return [whole.get(i, b) for i, b in enumerate(out)]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        memo, need = self.memo, list(set().union(*cut).difference(self.memo))
        memo.update(zip(need, self._known(need)))
        out = [b"".join(map(memo.__getitem__, c)) for c in cut]
        for w in need:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """By the pieces of ``_DROPPED``: Arrow and Python agree about white space, and
        a word that is plain letters and then plain punctuation is cut between them."""
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        head, tail = pc.utf8_rtrim(words, characters=_MARKS), pc.utf8_ltrim(words, characters=_LETTERS)
        plain = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(tail)), pc.binary_length(words))
        parts = pa.concat_arrays([pc.if_else(plain, head, words), pc.if_else(plain, tail, "")]).dictionary_encode()
        known = self._known(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, sizes = _placed(ids, sizes, parts.indices.to_numpy().reshape(2, -1).T.ravel())
        ids, sizes = _placed(ids, sizes.reshape(-1, 2).sum(axis=1), coded.indices.to_numpy())
        data = ids.tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        return [data[a:b] for a, b in pairwise(ends.tolist())]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; the young memo keeps all but long ones."""
        memo, old = self.memo, self.old
        out = list(map(memo.get, pieces))
        lost = [i for i, b in enumerate(out) if b is None]
        for i in lost:
            out[i] = old.get(pieces[i])
        new = [i for i in lost if out[i] is None]
        for i, b in zip(new, self._pieces([pieces[i] for i in new])):
            out[i] = b
        memo.update((pieces[i], out[i]) for i in lost if len(pieces[i]) <= MEMO_CHARS)
        return out


def _placed(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups ``at`` of ``ids``, which holds groups of these sizes, and their sizes."""
    return ids[ragged((np.cumsum(sizes) - sizes)[at], sizes[at])], sizes[at]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizer file, special tokens included (read on the driver)."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
