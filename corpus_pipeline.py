"""From raw documents to token ids: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm import decontamination, pieces, secrets, shingles, toxicity
from tablegauge.llm.common import table
from tablegauge.session import scratch_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labels of the source tables."""
    return toxicity.without_toxic(docs, toxicity.learned_from(spark, sf_dir))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar, the one with the smallest id."""
    return shingles.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked and their length counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, the text they stand for, and whether the reference implementation agrees."""
    found = pieces.encoded(docs)
    return found.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", F.col("decoded").alias("text"), "parity")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_per_group),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", mask_secrets),
    ("sentencepiece", to_pieces),
]
#: Field models, signatures and byte-pair merges have no SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs


query = run
