"""The alignment against whole-text encodings by the libraries and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from bayeslake.llm import alignment as A, catalog  # noqa: E402
from bayeslake.llm.tokenizing import byte_letters  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The result by encoding whole texts, sets of ends and a list of all links."""
    tok = Tokenizer.from_file(PATH_A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    letter = {c: b for b, c in byte_letters().items()}
    entry = {i: bytes(letter[c] for c in t) for t, i in tok.get_vocab(with_added_tokens=False).items() if all(c in letter for c in t)}

    def bytes_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
    docs = []
    for i, text in rows:
        groups = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            ba, bb = [entry.get(x, b"?") for x in a], [bytes_b(x) for x in b]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                where = defaultdict(lambda: ([], []))
                ends = [set(), set()]
                for s, pieces in zip(ends, (ba, bb)):
                    n = 0
                    for p in pieces:
                        n += len(p)
                        s.add(n)
                cuts = sorted(ends[0] & ends[1])
                for side, (ids, pieces) in enumerate(((a, ba), (b, bb))):
                    n, g = 0, 0
                    for x, p in zip(ids, pieces):
                        n += len(p)
                        while n > cuts[g]:
                            g += 1
                        where[g][side].append(x)
                groups = [where[g] for g in sorted(where)]
        docs.append((i, groups))
    links = [(i, groups, [(x, y) for a, b in groups for x in a for y in b]) for i, groups in docs]
    count = Counter(p for _, _, ls in links for p in set(ls))
    high = defaultdict(int)
    for (x, _), n in count.items():
        high[x] = max(high[x], n)
    return sorted(((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls), sum(count[p] == high[p[0]] for p in ls),
                    sum(count[p] for p in ls), hashlib.sha256(";".join(
                        f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g).encode()).hexdigest() if g else "")
                   for i, g, ls in links), key=repr)


def test_galloping_finds_the_common_ends():
    rng = random.Random(1)
    sides, want, shift = ([], []), [], 0
    for _ in range(300):
        a, b = (sorted(rng.sample(range(400), rng.randrange(0, 200))) for _ in "ab")
        for side, x in zip(sides, (a, b)):
            side.append([shift + v for v in x])
        want += [shift + v for v in sorted(set(a) & set(b))]
        shift += 1000
    ends = [np.array([v for x in side for v in x]) for side in sides]
    i, j = A.common_ends(ends, [np.array(list(map(len, side))) for side in sides])
    assert ends[0][i].tolist() == want == ends[1][j].tolist()


def test_odd_texts_equal_the_libraries(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "  a", "a  b   c    ", "\n\n a\n", "a\tb\t c\x0b d", "日本語テキスト 日本", "😀 x", "<|endoftext|> <s> </s> <0x0A>",
             "don't I'll we've", "   ", "é́ x", "1234 12 3", "x" * 3000, "a" * 17 + " " * 40 + "b", "\x00\x01 a", "▁a ▁", "ﬁ ﷺ",
             "a b  c\u0085d", "a\x1cb \x1d c", "a   b", "\r\n x\r\n\r\ny", "the the the", "the the the", "-" * 500, " \n" * 200]
    texts += ["".join(rng.choice(" \n\tabcé日'.,0<|▁ \x1e") if rng.random() < .98 else "😀" for _ in range(rng.randrange(60)))
              for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "the end"), (5, "the end")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string").repartition(3)
    got = sorted((tuple(r) for r in A.align_documents(docs, PATH_A, PATH_B).collect()), key=repr)
    assert got == plain(rows)
    assert A.align_documents(docs.limit(0), PATH_A, PATH_B).collect() == []


def test_query_equals_the_libraries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in catalog.op13_tokenizer_alignment(spark, SF).collect()), key=repr)
    assert got == plain(rows)


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    aligner = A.Aligner(PATH_A, PATH_B)
    text = " " + "".join(chr(0x4e00 + i * 7 % 3000) for i in range(400))
    got = []
    for limit in (A.LISTED_LINKS, 1):
        monkeypatch.setattr(A, "LISTED_LINKS", limit)
        found = aligner.align([text, " the"])
        links = Counter()
        for _, code, n in zip(*[np.concatenate(x).tolist() for x in (found.owner, found.codes, found.times)]):
            links[code] += n
        got.append((found.texts, links, np.concatenate(found.counts, axis=1).tolist()))
    assert got[0] == got[1]


def test_blocks_do_not_change_the_result(monkeypatch):
    rows = [(1, "the cat sat on the mat"), (2, "the cat"), (3, None), (4, "a mat, the mat")]
    aligner = A.Aligner(PATH_A, PATH_B)
    whole, single = A.BlockBuilder(0, aligner), A.BlockBuilder(1 << 32, aligner)
    parts = []
    for r in rows:
        whole.add(*r)
        single.add(*r)
        parts.append(single.finish())
    one = whole.finish().to_pylist()[0]
    many = [p.to_pylist()[0] for p in parts]
    for k in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "hashes"):
        assert one[k] == [x for m in many for x in m[k]]
    total = Counter()
    for m in many:
        total.update(dict(zip(m["pairs"], m["pair_docs"])))
    assert total == Counter(dict(zip(one["pairs"], one["pair_docs"])))


def test_packed_numbers_round_trip():
    from bayeslake.llm.common import pack, unpack
    for x in ([], [0], list(range(1000)), [2**31 - 1, 0, 5]):
        assert unpack(pack(np.array(x, np.int64))).tolist() == x
