"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table
from . import (alignment, embeddings, hard_negatives, hidden_markov, licences, line_dedup, minhash, packing, pieces,
               quality, sharding, token_files, toxicity)


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; where they lie is the installation's matter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path,
                                  tokenizer or tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.document_digests(spark, path)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  tokenizer or tokenizer_path("byte_bpe_50k.json"),
                                  capacity=1024, end_id=2, keep_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain).drop("text")
    return scored.withColumn("toxic", F.col("p_toxic") > toxicity.THRESHOLD)


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = model or tokenizer_path("piece_bpe_32k.model")
    decoded = pieces.decode_documents(pieces.encode_documents(docs, model), model)
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit_rules(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select(
        "doc_id", *[f"statistics.{c}" for c in quality.STATISTICS], "base_failed", "kept")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), similarity=0.8)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
            .select("doc_id", "n_lines", "n_dropped",
                    F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read_table(spark, sf_dir, "documents"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), 40)


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_documents(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None,
                             path_b: str | None = None) -> DataFrame:
    return alignment.align_documents(read_table(spark, sf_dir, "documents"), path_a or tokenizer_path("byte_bpe_50k.json"),
                                     path_b or tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_best_fit_packing, op3_toxicity, op4_sentencepiece,
                                op5_quality_rules, op6_minhash_near_dedup, op7_embedding_near_dedup, op8_line_dedup,
                                op9_licence_scan, op10_jump_sharding, op11_hidden_markov,
                                op12_hard_negatives, op13_tokenizer_alignment)}


#: DuckDB SQL over the same tables, where SQL can express the result.
ORACLE = {
    "op8_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
shared AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
    SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.keeper AS dropped
    FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op12_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
           CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same)
    WHERE k <= 5)
SELECT * FROM (
    SELECT p.anchor_id, p.id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
           s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
WHERE rank <= 10""",
    "op10_jump_sharding": r"""
WITH RECURSIVE crc_steps(i, c, k) AS (
    SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS (
    SELECT doc_id, octet_length(b) AS n,
           list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS v FROM d),
crcs AS (
    SELECT doc_id, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), v),
           lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS crc
    FROM bytes, crc_table),
jump(n, doc_id, k, b, j) AS (
    SELECT n, doc_id, CAST(CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616 ELSE doc_id END AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT)
    FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (40), (41)) s(n)
    UNION ALL
    SELECT n, doc_id, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jump WHERE j < n)),
shards AS (SELECT doc_id, n, CAST(max(b) AS INTEGER) AS shard FROM jump GROUP BY doc_id, n)
SELECT c.doc_id, CAST(c.n + 16 AS BIGINT) AS size, c.crc AS text_crc32, 'key' AS law, a.shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY c.doc_id, c.crc, c.n) - 1 AS slot, g.shard AS grown_shard
FROM crcs c JOIN shards a ON a.doc_id = c.doc_id AND a.n = 40 JOIN shards g ON g.doc_id = c.doc_id AND g.n = 41""",
}
