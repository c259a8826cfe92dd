"""Stored indexes: postings for lexical search, embedding shards, and a compressed evidence store."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.tokens import bm25_tokens
from sievework.operators.retrieval import B, K1, ranked

#: The version that a stored index must have.
VERSION = "postings-1"


def save_index(docs: DataFrame, path: str, doc_id: str, text: str = "text") -> None:
    """Documents' lengths, postings by term, and statistics, as Parquet tables.

    Postings are sorted by term within range partitions, so that a search reads
    only the row groups of its terms. A repeated or null id raises an error.
    """
    words = docs.select(doc_id, bm25_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    ids = words.agg(F.count("*").alias("n"), F.count_distinct(doc_id).alias("d")).first()
    if ids["n"] != ids["d"]:
        raise ValueError("documents need distinct ids")
    lengths = words.select(doc_id, F.size("words").alias("length"))
    postings = words.select(doc_id, F.explode("words").alias("term")).groupBy("term", doc_id).agg(F.count("*").alias("tf"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    postings.repartitionByRange(parts, "term").sortWithinPartitions("term", doc_id).write.mode("overwrite").parquet(f"{path}/postings")
    lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("average")).withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, questions: DataFrame, question: str, doc_id: str, top: int = 240) -> DataFrame:
    """BM25 over a stored index: (question, document, score, rank)."""
    stats = spark.read.parquet(f"{path}/stats").first()
    if stats is None or stats["version"] != VERSION:
        raise ValueError("unsupported index version")
    asked = questions.select(question, F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))
    postings = spark.read.parquet(f"{path}/postings")
    df = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    askers = asked.groupBy("term").agg(F.collect_list(question).alias("__askers")).join(df, "term")
    n, average = stats["n_docs"], stats["average"] or 1.0
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
    # By document, so that pairs of questions and documents are summed where they are made.
    weighed = postings.join(askers, "term").repartition(doc_id).join(spark.read.parquet(f"{path}/lengths"), doc_id).select(doc_id, weight.alias("__weight"), "__askers")
    each = weighed.select(doc_id, "__weight", F.explode("__askers").alias(question))
    scored = each.groupBy(question, doc_id).agg(F.round(F.sum("__weight"), 9).alias("score")).filter("score > 0")
    return ranked(scored, [question], [F.desc("score"), F.asc(doc_id)], top)


def shard_faults(shards: DataFrame, row: str, vector: str, tolerance: float = 0.01) -> DataFrame:
    """(row, fault): row numbers that repeat or are missing, and vectors that are not of unit length."""
    last = shards.agg(F.max(row)).first()[0]
    whole = shards.sparkSession.range(0 if last is None else max(0, last + 1)).withColumnRenamed("id", row)
    missing = whole.join(shards, row, "left_anti").select(row, F.lit("missing").alias("fault"))
    again = shards.groupBy(row).agg(F.count("*").alias("c")).filter("c > 1").select(row, F.lit("repeated").alias("fault"))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return missing.unionByName(again).unionByName(shards.filter(F.abs(norm - 1) > tolerance).select(row, F.lit("not_unit").alias("fault")))


def merged_shards(shards: list[DataFrame], row: str) -> DataFrame:
    """Shards as one table, ordered by row; each row belongs to one shard."""
    whole = shards[0]
    for s in shards[1:]:
        whole = whole.unionByName(s)
    return whole.orderBy(row)


def inflated(store: DataFrame, payload: str, schema: T.StructType, name: str = "payload") -> DataFrame:
    """A store of compressed JSON with its payload as a struct; an empty or unreadable payload is null."""
    names = [c for c in store.columns if c != payload]
    out = T.StructType([*[store.schema[c] for c in names], T.StructField("__json", T.StringType())])

    def text(data: bytes | None) -> str | None:
        try:
            return zlib.decompress(data).decode() if data else None
        except (zlib.error, UnicodeDecodeError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(payload)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([text(x) for x in batch.column(at).to_pylist()], pa.string())], names=[*names, "__json"])

    return store.mapInArrow(run, out).withColumn(name, F.from_json("__json", schema)).drop("__json")


def lookup(store: DataFrame, wanted: DataFrame, core: str, order: str) -> DataFrame:
    """The store's rows of the wanted cores, numbered within each."""
    return store.join(wanted.select(core).distinct(), core, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(core).orderBy(order)))
