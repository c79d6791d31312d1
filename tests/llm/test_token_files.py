"""Token files: packing round trips, whole-table digests, random access, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from bayeslake.llm import catalog, token_files as TF, tokenizing  # noqa: E402
from bayeslake.llm.tokenizing import Encoder  # noqa: E402
from bayeslake.session import scratch_path  # noqa: E402

SF = "/root/testdata/sf0.01"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype("<u4")
    packed = TF.pack_bits(ids, width)
    assert len(packed) == (1001 * width + 7) // 8
    assert (TF.unpack_bits(packed, width, 0, 1001) == ids).all()
    for a, b in ((0, 1), (5, 5), (17, 900), (1000, 1001)):
        assert (TF.unpack_bits(packed, width, a, b) == ids[a:b]).all()


def test_width_is_the_fewest_bits():
    assert [TF.id_width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        TF.pack_bits(np.array([8]), 3)


ODD = ["", " ", "\n", "a", " a  b\tc \n\n d", "x" * 5000, "don't  stop\r\n", "ÁÅ ﬁ ΣΣ", "a\x1cb\x1d c",
       "<|endoftext|> a<|endoftext|>b <|startoftext|>", " a b　 c", "\U0001f600\U0001f600 x", "  \n \n\tend  ", "Straße, ÀÉ. Ünï!? x.y, z... ...a ,b 'S it's, ſ ²x Ⅷ. a\u0301. e\u0301, K Å",
       "<|ENDOFTEXT|> Ab İI K", "ÀB µ ß Ÿ Œ", "end. ", "a,b c,\nd,\n\ne;  f: g"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_equal_the_library_on_whole_texts(path):
    whole = Tokenizer.from_file(path)
    got = Encoder(path).encode(ODD)
    for text, b in zip(ODD, got):
        assert np.frombuffer(b, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


class Counting(dict):
    looked_up = 0

    def get(self, key, default=None):
        self.looked_up += 1
        return super().get(key, default)

    def __getitem__(self, key):
        self.looked_up += 1
        return super().__getitem__(key)


def test_pieces_are_looked_up_once_a_chunk():
    enc = Encoder(WORD)
    enc.memo = Counting()
    got = enc.encode(["one two, (three) " * 2000, "two. one, " * 1000])
    assert enc.memo.looked_up <= 10
    whole = Tokenizer.from_file(WORD)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [
        whole.encode(t, add_special_tokens=False).ids for t in ("one two, (three) " * 2000, "two. one, " * 1000)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_random_texts_over_many_chunks_and_memos(path, monkeypatch):
    for name in ("CHUNK_CHARS", "WORD_CHUNK_CHARS", "MEMO_PIECES"):
        monkeypatch.setattr(tokenizing, name, 150)
    rng = np.random.default_rng(5)
    some = list("aBéÀßÿ×÷.,;:!?'-%9½x\0\n") + [chr(c) for c in range(0x3001) if chr(c).isspace()] + [
        "'s", "Ab", "é.", "e\u0301", "日本", "Ж", "y" * 70, "z" * 70 + ".", " ", " ", ". ", ", "]
    if path == WORD:
        some.append("<|endoftext|>")
    texts = ["".join(rng.choice(some, rng.integers(0, 30))) for _ in range(2000)]
    whole, enc = Tokenizer.from_file(path), Encoder(path)
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(part)]
        for text, ids in zip(part, got):
            assert ids == whole.encode(text, add_special_tokens=False).ids, repr(text)


def brute(rows, path, end):
    whole, out, start = Tokenizer.from_file(path), [], 0
    for key, text in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = catalog.op1_token_files(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(docs, WORD, 1)


def test_random_access_odd_rows_and_empty_table(spark):
    rows = [(3, None, 1), (1, "b b", 2), (None, "n", 3), (1, "a", 4), (1, "a", 5), (7, "long " * 3000, 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    path = scratch_path(spark, "tf")
    TF.write_token_files(docs, path, BYTE, end_id=2, block_ids=64, partitions=3)
    got = TF.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got][0] is None and [r.doc_id for r in got][1:] == [1, 1, 1, 3, 7, 9]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    assert flat[-1] == 2 and got[4].n_tokens == 1
    for a, b in ((0, 1), (3, 40), (20, len(flat)), (len(flat), len(flat) + 5)):
        part = TF.read_range(spark, path, a, b).orderBy("position").collect()
        assert [r.id for r in part] == flat[a:b].tolist()
    empty = scratch_path(spark, "tf")
    TF.write_token_files(docs.where(F.lit(False)), empty, BYTE, end_id=2)
    assert TF.document_digests(spark, empty).collect() == []
