"""Job 1: keeps a full-text index of a growing table of documents.

A stream over the table's files takes those that it hasn't taken before, up to
`max_files` a micro-batch, and ends when there are no more. Each micro-batch
writes the postings of its new documents under its own number:

    output/batch=<number>/bucket=<bucket of the term>/*.parquet

with (term, doc_id, tf, positions, length), and a row of the empty term for each
document, in bucket -1. `sievework.sources.fulltext.search` searches the table as
it stands. What has been taken is in the stream's checkpoint, which belongs to
the output: keep or delete both.

It can be stopped and run again at any time. A micro-batch that was cut off is
run again over the same files, and replaces what it had written; a run without
new files writes nothing.

Rows without an id are counted and left out. Of one id the first micro-batch that
has it counts, and within that the least text: a document that comes again, in
another file or later, changes nothing.

    python -m jobs.fulltext --config jobs/fulltext.json --documents /data/documents --output /data/index --checkpoint /data/index-checkpoint
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.tokens import bm25_tokens
from sievework.sources import fulltext
from sievework.streaming.windows import stream_of

log = logging.getLogger("jobs.fulltext")

OPTIONS = {"documents": str, "output": str, "checkpoint": str, "doc_id": str, "text": str, "buckets": int, "max_files": int}


def index_schema(key: T.StructField) -> T.StructType:
    fields = [("batch", T.IntegerType()), ("bucket", T.IntegerType()), ("term", T.StringType()), (key.name, key.dataType), ("tf", T.IntegerType()), ("positions", T.ArrayType(T.IntegerType())), ("length", T.IntegerType())]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def read_index(spark: SparkSession, output: str, key: T.StructField) -> DataFrame:
    """The index as it stands; an empty table before the first micro-batch."""
    schema = index_schema(key)
    try:
        return spark.read.schema(schema).parquet(output)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text", buckets: int = fulltext.BUCKETS, max_files: int = 1000) -> dict:
    """Takes the files of `documents` that are new since the last run into the index, and returns what was read and written."""
    stream = stream_of(spark, documents, maxFilesPerTrigger=str(max_files))
    key = stream.schema[doc_id]
    done = {"batches": 0, "rows_read": 0, "rows_without_id": 0, "documents_written": 0, "postings_written": 0}

    def index(batch: DataFrame, number: int) -> None:
        read, written = Observation(), Observation()
        given = batch.select(doc_id, text).observe(read, F.count("*").alias("rows"), F.count_if(F.col(doc_id).isNull()).alias("nulls"))
        new = given
        if number:
            earlier = read_index(batch.sparkSession, output, key).filter((F.col("batch") < number) & (F.col("bucket") == fulltext.OWN))
            new = given.join(earlier.select(doc_id), doc_id, "left_anti")
        own = F.col("term") == ""
        rows = fulltext.postings(new, doc_id, text, bm25_tokens, buckets).observe(written, F.count_if(own).alias("documents"), F.count_if(~own).alias("postings"))
        fulltext.laid_out(rows, doc_id).write.mode("overwrite").partitionBy("bucket").parquet(f"{output}/batch={number}")
        counts = read.get | written.get
        log.info("batch %d: read %d rows of %s, %d without id; wrote %d documents and %d postings to %s", number, counts["rows"], documents, counts["nulls"], counts["documents"], counts["postings"], output)
        for total, name in zip(("rows_read", "rows_without_id", "documents_written", "postings_written"), ("rows", "nulls", "documents", "postings")):
            done[total] += counts[name]
        done["batches"] += 1

    query = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not done["batches"]:
        log.info("no new files in %s", documents)
    return done


if __name__ == "__main__":
    from jobs.command import main

    main(run, "jobs.fulltext", OPTIONS)
