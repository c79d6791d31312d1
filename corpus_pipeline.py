"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again before the next one. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayeslake.llm import line_dedup, minhash, packing, quality, toxicity
from bayeslake.llm.catalog import tokenizer_path
from bayeslake.llm.common import fresh, stored
from bayeslake.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and every learned rule."""
    rules = quality.fit_rules(docs, read_table(spark, sf_dir, "labels"))
    names = tuple(fresh(docs, "statistics", "base_failed", "kept"))
    return quality.judge(docs, rules, names=names).where(F.col(names[2])).select(*docs.columns)


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not flag."""
    chain = toxicity.fit_chain(docs, read_table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "toxic")
    return toxicity.flag(docs, chain, name=name).where(~F.col(name)).select(*docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; ``n_chars`` follows the text."""
    counts = tuple(fresh(docs, "n_lines", "n_dropped"))
    out = line_dedup.dedup_lines(docs, counts=counts).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in packed sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2, keep_ids=False)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_chain), ("line_dedup", shared_lines),
          ("minhash_near_dedup", near_duplicates), ("best_fit_packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Learned rules, the classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
