"""Jump consistent hashing of documents to shards, in SQL functions alone.

The hash (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash
Algorithm", 2014) walks a 64-bit linear congruential sequence seeded with the
key; only the key and the number of shards decide, and one more shard takes
rows only into itself. There is no ring or other table to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, need, shuffle_partitions, stored

# Fixed values of the published hash.
MULTIPLIER = 2862933555777941757
TWO64 = 1 << 64


def jump_hash(key: str, shards: int) -> Column:
    """Shard 0 .. shards - 1 of the long column ``key``, read as an unsigned
    64-bit number (NULL as 0).

    The state of the sequence is an exact decimal. Jumps go strictly
    forward, so ``shards`` steps always suffice; steps after the last jump
    only compare.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    two64 = f"CAST({TWO64} AS DECIMAL(20,0))"
    state = f"CAST(pmod(s.k * CAST({MULTIPLIER} AS DECIMAL(19,0)) + 1, {two64}) AS DECIMAL(20,0))"
    jump = f"CAST(floor((s.j + 1) * (2147483648D / CAST(({state} div 8589934592) + 1 AS DOUBLE))) AS BIGINT)"
    first = f"CAST(coalesce(`{key}`, 0L) AS DECIMAL(20,0))"
    first = f"CAST(CASE WHEN `{key}` < 0 THEN {first} + {two64} ELSE {first} END AS DECIMAL(20,0))"
    return F.expr(
        f"aggregate(sequence(1, {shards}), named_struct('k', {first}, 'b', -1L, 'j', 0L), "
        f"(s, i) -> CASE WHEN s.j >= {shards}L THEN s ELSE named_struct('k', {state}, 'b', s.j, 'j', {jump}) END, "
        f"s -> CAST(s.b AS INT))")


def assign_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text",
                  overhead: int = 16) -> DataFrame:
    """One row per document: its id, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus ``overhead``; ``slot``
    numbers the rows of a shard from 0 without gaps, by id (NULL first), then
    crc and size; ``grown_shard`` is the shard if there were one more. NULL
    ids hash as 0, a NULL text has no
    bytes and the crc of the empty text, repeated rows get slots of their
    own, an empty table gives no row; other columns are ignored.

    Slots need the rows before in the same shard. The digests are dealt out in
    ranges of that order (equal rows by their place, so no id fills a range),
    numbered within (shard, range), a group no larger than a range however few
    the shards, and shifted by the counts of the ranges before (one row for
    each range and shard). Texts are read once and never shuffled.
    """
    need(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", jump_hash("doc_id", shards).alias("shard"),
                       jump_hash("doc_id", shards + 1).alias("grown_shard"),
                       F.monotonically_increasing_id().alias("place"))
    rows = stored(rows, "shard-rows")
    rows = stored(rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "text_crc32", "size", "place")
                  .drop("place").withColumn("part", F.spark_partition_id()), "shard-ranges")
    before = (rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "part", F.coalesce(F.sum("n").over(
                  Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)).alias("before")))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("local", local).join(before, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("local") - 1).alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, *, id_col: str = "doc_id") -> None:
    """Write the whole rows of ``docs`` to ``path`` in one folder per shard
    (``shard_id=...``). Each task writes its own rows of each shard, so no
    shard, however large, is gathered."""
    need(docs, id_col)
    key, shard = fresh(docs, "shard_key", "shard_id")
    (docs.withColumn(key, F.col(id_col).cast("long")).withColumn(shard, jump_hash(key, shards)).drop(key)
     .write.partitionBy(shard).parquet(path))
