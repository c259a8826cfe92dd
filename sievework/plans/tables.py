"""The driver's tables as the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per vector: its lane is its label, its core its id modulo 100."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("lane"), (F.col("vec_id") % 100).alias("core_id"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of dense retrieval: every twentieth vector, numbered from 0, so that fusion pairs it with a question."""
    return load(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.floor(F.col("vec_id") / 20).alias("query_id"), "embedding")
