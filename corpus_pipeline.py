"""The corpus pipeline: quality, exact copies, near copies, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`, whatever these are. A stage works on all rows
that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import exact_dedup, mixing, packing, quality, setsketch
from sievework.llm.queries import vocabulary
from sievework.llm.work import delete, folder, scratch


#: Columns that stages read by name.
READ = ("doc_id", "text", "source")


def with_own_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of `docs`, also where a stage adds columns of the same names."""
    aside = {c: f"__own_{c}" for c in docs.columns if c not in READ}
    found = stage(docs.withColumnsRenamed(aside))
    return found.drop(*aside).withColumnsRenamed({v: k for k, v in aside.items()})


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the table of labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_own_columns(docs, lambda d: quality.scored(d, labels).filter("predicted = 1")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the least doc_id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over shingles of five words."""
    return with_own_columns(docs, lambda d: setsketch.near_duplicates(d).filter("kept")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts, sources weighing the square root of their number of documents."""
    return with_own_columns(docs, mixing.poisson_mix).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its place in a sequence."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder before the next.

    A stage's own intermediate tables are deleted when its result is written, and that result when the next is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(docs.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
