"""The corpus pipeline: one operator of ``sheetloom.llm`` per stage, documents in, token ids out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import bloom_dedup, bpe, mixture, simhash, toxicity
from sheetloom.llm.shared import table, written

#: What the corpus counts as near-duplicates: words of a shingle, and similarity of the shingle sets.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the model, fitted on the given labels, finds toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return bloom_dedup.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates by shingle similarity."""
    return simhash.drop_near(docs, NEAR_SHINGLE, NEAR_SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; one that is taken twice is there twice."""
    return mixture.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and whether they decode to its text."""
    spec = bpe.vocabulary()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode_column(texts.withColumn("whole", F.sha2(F.col("text").cast("binary"), 256)), spec, decoded="decoded")
    exact = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("whole")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mix_sources),
    ("bpe", encode),
]

#: The models and the graph search of the stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
