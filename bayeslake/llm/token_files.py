"""Token-ID files: fixed-width bit-packed blocks with offsets.

A token file set is a folder of Parquet files, one per shard of ascending
``doc_id``. Each row is one block of whole documents:

    shard int, block int      place in ascending order
    first long                ids of this shard before the block
    doc_ids array<long>       documents in the block, in order
    counts array<long>        ids of each document
    width int                 bits per id
    payload binary            the ids, ``width`` bits each, low bit first

``width`` is the fewest bits that hold every id of the vocabulary, so id i of
a block is the ``width`` bits from bit ``i * width``: numpy unpacks any range
without reading what lies before it, and ``first`` plus the shard totals
locate any global id position. Spark's writer commits the files, so a lost
executor or a repeated task leaves no partial block.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need, ship_package, shuffle_partitions
from .tokenizing import WORD_CHUNK_CHARS, encoder, vocabulary_size

BLOCK_IDS = 1 << 16

BLOCK_SCHEMA = ("shard int, block int, first long, doc_ids array<bigint>, counts array<bigint>, "
                "width int, payload binary")
_BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()),
                          ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                          ("width", pa.int32()), ("payload", pa.binary())])


# ---- bit packing ---------------------------------------------------------------------
def id_width(vocab_size: int) -> int:
    """Fewest bits that hold ids 0 .. vocab_size - 1."""
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids as ``width``-bit numbers, low bit first, padded to a whole byte."""
    ids = np.asarray(ids, dtype="<u4")
    if ids.size and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} needs more than {width} bits")
    if width in (8, 16, 32):                        # the same bytes, without single bits
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_bits(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """ids ``start`` .. ``stop - 1`` of a block, touching only their bytes."""
    if stop <= start:
        return np.zeros(0, "<u4")
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f"<u{size}", stop - start, start * size).astype("<u4")
    lo, hi = start * width // 8, (stop * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, hi - lo, lo), bitorder="little")
    skip = start * width - lo * 8
    grid = bits[skip:skip + (stop - start) * width].reshape(-1, width)
    wide = np.zeros((grid.shape[0], 32), np.uint8)
    wide[:, :width] = grid
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


# ---- writing ---------------------------------------------------------------------------
def _encode_blocks(path: str, end_id: int | None, width: int, block_ids: int):
    def run(batches):
        enc, shard = encoder(path), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        block = first = held = 0
        ids: list[bytes] = []
        docs: list = []

        def flush():
            nonlocal block, first, held, ids, docs
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = pa.RecordBatch.from_pydict(
                {"shard": [shard], "block": [block], "first": [first], "doc_ids": [docs],
                 "counts": [[len(b) // 4 for b in ids]], "width": [width],
                 "payload": [pack_bits(flat, width)]}, schema=_BLOCK_ARROW)
            block, first, held, ids, docs = block + 1, first + flat.size, 0, [], []
            return row

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            n = max(1, len(keys) * WORD_CHUNK_CHARS // max(1, texts.nbytes))     # texts in hand at a time
            for at in range(0, len(keys), n):
                part = ["" if t is None else t for t in texts.slice(at, n).to_pylist()]
                for key, b in zip(keys.slice(at, n).to_pylist(), enc.encode(part)):
                    docs.append(key)
                    ids.append(b + end)
                    held += len(ids[-1]) // 4
                    if held >= block_ids:
                        yield flush()
        if docs:
            yield flush()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text",
                      block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Encode every whole text and write the token files to ``path``.

    Documents are range-partitioned and sorted by id (NULL ids first); rows
    with one id are ordered by a hash of their text, and that hash also lets
    a range boundary fall between them. A NULL text counts as empty and holds only the
    end id; an empty table writes no block; other columns are ignored. A
    task holds one block and a few texts at a time.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    ship_package(spark)
    width = id_width(max(vocabulary_size(tokenizer), 0 if end_id is None else end_id + 1))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    (d.repartitionByRange(partitions or shuffle_partitions(spark), *order)
      .sortWithinPartitions(*order)
      .mapInArrow(_encode_blocks(tokenizer, end_id, width, block_ids), BLOCK_SCHEMA)
      .write.option("compression", "none").parquet(path))


# ---- reading ---------------------------------------------------------------------------
def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The block table with ``start``, the global position of its first id.

    Shard totals (a row per shard, as many as the writing tasks) are summed
    up and broadcast.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    total = F.expr("aggregate(counts, 0L, (s, x) -> s + x)")
    per_shard = blocks.select("shard", total.alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = per_shard.select("shard", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (blocks.join(F.broadcast(before), "shard")
            .select("*", (F.col("_before") + F.col("first")).alias("start")).drop("_before"))


def _documents(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            start, docs, counts, width, payload = (c[at].as_py() for c in batch.columns)
            ids = unpack_bits(payload, width, 0, sum(counts))
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(docs, pa.int64()),
                "start": pa.array(start + ends - counts, pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids": pa.array([ids[e - n:e].tobytes() for e, n in zip(ends, counts)], pa.binary())})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens and its ids as
    little-endian uint32 bytes, unpacked block by block."""
    ship_package(spark)
    return (read_blocks(spark, path).select("start", "doc_ids", "counts", "width", "payload")
            .mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary"))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Random access: (position, id) of the global positions start .. stop - 1.
    Only the blocks that hold them are unpacked, and of those only the ids asked for."""
    ship_package(spark)

    def cut(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                first, counts, width, payload = (c[at].as_py() for c in batch.columns)
                lo, hi = max(0, start - first), min(sum(counts), stop - first)
                yield pa.RecordBatch.from_pydict({
                    "position": pa.array(np.arange(first + lo, first + hi), pa.int64()),
                    "id": pa.array(unpack_bits(payload, width, lo, hi).astype(np.int64), pa.int64())})

    n = F.expr("aggregate(counts, 0L, (s, x) -> s + x)")
    return (read_blocks(spark, path).where((F.col("start") < stop) & (F.col("start") + n > start))
            .select("start", "counts", "width", "payload").mapInArrow(cut, "position long, id long"))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    return read_documents(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
