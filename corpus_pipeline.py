"""A cleaning and tokenizing pipeline over the table documents, as a list of stages.

Each stage works on all that the one before it kept, is written as Parquet in the
shared folder and read again by the next. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import bpe, decontaminate, quality, simhash, substring
from reelspark.session import bound_batches, shared_path, ship, spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules or the isolation forest reject go."""
    ship(spark)
    bound_batches(spark)
    return quality.clean(spread(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: links at a Jaccard similarity of 0.8 of five-word shingles."""
    ship(spark)
    bound_batches(spark)
    return simhash.clean(spread(docs), shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; so do documents of which nothing is left."""
    ship(spark)
    bound_batches(spark)
    kept = substring.clean(spread(docs)).where("text IS NULL OR length(trim(text)) > 0")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    bound_batches(spark)
    return decontaminate.clean(spread(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the digests of ids and decoded text."""
    ship(spark)
    bound_batches(spark)
    tokens = bpe.encode(spread(docs), decode=True)
    return tokens.select(*(c for c in docs.columns if c != "text"), "ids", *bpe.digests(F.col("ids"), F.col("decoded")))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe", encode_tokens),
]
#: SimHash groups and the isolation forest are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
