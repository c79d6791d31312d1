"""The SentencePiece codec against the library, the unigram lattice against all segmentations."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from bayeslake.llm import catalog, pieces as S  # noqa: E402

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b   c    ", "\n\n a\n", "a\tb", "日本語テキスト", "😀 x", "<s> a </s> <0x0A>", "aaaa aaaaaaa", "   ",
       "é́", "1234 12 3", "x" * 3000, "a" * 17 + " " * 40 + "b", "\x00\x01", "▁a ▁", "ﬁ ﷺ"]


def library(texts):
    return sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)


def test_odd_texts_equal_the_library():
    codec = S.Codec(S.Vocabulary.load(MODEL))
    got = [np.frombuffer(b, "<u4").tolist() for b in codec.encode(ODD)]
    assert got == library(ODD)
    assert [codec.decode(b) for b in codec.encode(ODD)] == [t.replace(S.MARK, " ") for t in ODD]


def test_query_equals_the_library_and_decodes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in catalog.op4_sentencepiece(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, ids in zip(docs, library([d.text or "" for d in docs])):
        r = got[d.doc_id]
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_crc32 == zlib.crc32((d.text or "").encode())


def best_sum(word, scores):
    """Highest total over all segmentations."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        if all(p in scores for p in parts):
            s = sum(scores[p] for p in parts)
            best = s if best is None else max(best, s)
    return best


def test_unigram_lattice_equals_all_segmentations():
    rng = random.Random(1)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(25)} | set("abc"))
    v = S.Vocabulary([("<unk>", 0.0, S.UNKNOWN)] + [(p, -rng.random() * 5, S.NORMAL) for p in pieces], S.UNIGRAM, False)
    scores = {p: s for p, s, k in v.pieces if k == S.NORMAL}
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 10))) for _ in range(200)})
    for w, ids in S.Lattice(v).encode(words).items():
        parts = [v.pieces[i][0] for i in ids]
        assert "".join(parts) == w and sum(scores[p] for p in parts) == pytest.approx(best_sum(w, scores))
    assert S.Lattice(v).encode(["azb"]) == {"azb": [v.ids["a"], 0, v.ids["b"]]}


def test_merge_lattice_equals_merging():
    rng = random.Random(2)
    for _ in range(20):
        # byte-pair vocabularies: every piece is the join of two earlier ones
        pieces = list("abc")
        while len(pieces) < 25:
            p = rng.choice(pieces) + rng.choice(pieces)
            if p not in pieces and len(p) < 8:
                pieces.append(p)
        v = S.Vocabulary([(p, -float(i), S.NORMAL) for i, p in enumerate(pieces)], S.MERGES, False)
        lattice = S.Lattice(v)
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(200)}
        for w, ids in lattice.encode(list(words)).items():
            assert [pieces[i] for i in ids] == lattice.merge(w), (pieces, w)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b", 3), (2, "a b", 4), (2, "a b", 5)],
                               "doc_id long, text string, n_ids int")
    enc = S.encode_documents(df, MODEL)
    out = sorted(((r.doc_id or 0, r.n_ids, r.text) for r in S.decode_documents(enc, MODEL).collect()))
    assert out == [(0, 2, "a b"), (1, 0, ""), (1, 0, ""), (2, 2, "a b"), (2, 2, "a b")]
    assert S.encode_documents(df.where(F.lit(False)), MODEL).collect() == []


def test_long_runs_equal_the_library_and_take_no_time():
    import time
    codec = S.Codec(S.Vocabulary.load(MODEL))
    codec.encode(["warm up"])
    runs = [" " * 200_000, "a" + " " * 100_000 + "b", "=" * 50_000, "x y " * 50_000, "\n" * 20_000]
    began = time.process_time()
    got = codec.encode(runs)
    assert time.process_time() - began < 10
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == library(runs)


def test_runs_of_every_length_equal_the_library():
    codec = S.Codec(S.Vocabulary.load(MODEL))
    runs = [c * n for c in " =-a" for n in list(range(1, 70)) + [127, 128, 129, 1000, 1023]]
    assert [np.frombuffer(b, "<u4").tolist() for b in codec.encode(runs)] == library(runs)


def test_pieces_stay_apart_as_merging_says():
    """Undoing joins along the border against merging the two texts again."""
    lattice = S.Lattice(S.Vocabulary.load(MODEL))
    rng = random.Random(5)
    ids = [i for p, i in lattice.v.ids.items() if len(p) < 9]
    known = 0
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        said = lattice._stay_apart(a, b)
        texts = [lattice.v.pieces[i][0] for i in (a, b)]
        if said is not None:
            known += 1
            assert said == (lattice.merge("".join(texts)) == texts), texts
    assert known > 2000


def test_words_are_cut_only_where_no_piece_crosses():
    v = S.Vocabulary.load(MODEL)
    assert "".join(v.parts("▁word,another;x")) == "▁word,another;x"
    for word in ("▁word,", "▁don't", "x=3.14", "▁(a)[b]"):
        cuts = list(itertools.accumulate(map(len, v.parts(word))))[:-1]
        assert all(word[i - 1:i + 1] not in p for i in cuts for p in v.ids)
