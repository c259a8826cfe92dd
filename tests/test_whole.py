"""Queries over whole query sets, on small tables written for it."""

import pytest
from pyspark.sql import functions as F

from sievework.plans import catalogue


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    i = F.col("id")
    spark.range(130).select(i.alias("vec_id"), F.array(*[F.cos(i * k).cast("float") for k in range(1, 5)]).alias("embedding"), (i % 3).cast("int").alias("label")).write.parquet(f"{at}/embeddings.parquet")
    spark.range(60).select(i.alias("doc_id"), F.concat(F.lit("The control film held word"), i % 50, F.lit(" under light for hours.")).alias("text")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{at}/documents.parquet")
    spark.range(50).select(i.alias("item_id"), F.concat(F.lit("What holds word"), i, F.lit(" under light?")).alias("text")).write.parquet(f"{at}/benchmark.parquet")
    return at


def ids(spark, folder, name, column):
    return {r[0] for r in catalogue.QUERIES[name](spark, folder).select(column).distinct().collect()}


@pytest.mark.parametrize("name", ["dense_dot_topk", "lane_zscore_topk", "core_aggregate"])
def test_every_twentieth_vector_asks(spark, folder, name):
    assert ids(spark, folder, name, "query_id") == set(range(7))


@pytest.mark.parametrize("name", ["lexical_first_core", "fts_first_core", "rrf_fusion", "hybrid_results"])
def test_every_question_asks(spark, folder, name):
    assert ids(spark, folder, name, "query_id") == set(range(50))


@pytest.mark.parametrize("name", ["deep_packets", "record_ranking"])
def test_every_item_asks(spark, folder, name):
    assert ids(spark, folder, name, "item_id") == set(range(50))


def test_all_options_count(spark, folder):
    assert catalogue.QUERIES["mcq_accuracy"](spark, folder).first()["items"] == 50
