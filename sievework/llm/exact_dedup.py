"""Exact deduplication as a stateful stream with disk-backed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.work import folder, table

#: The state store that keeps its state on disk, with snapshots in the checkpoint.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A state store holds memory of its own, however few entries it has, and its entries are on disk: a third as many stores as
#: there are shuffle partitions.
STORES = 3
#: All state partitions of an executor share this memory, however many there are; the rest is on
#: disk, without room reserved ahead. A micro-batch checkpoints its changes, not all of the state.
ROCKSDB_OPTIONS = {"boundedMemoryUsage": "true", "maxMemoryUsageMB": "100", "writeBufferSizeMB": "2", "blockCacheSizeMB": "2", "allowFAllocate": "false", "changelogCheckpointing.enabled": "true"}


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _arrivals(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest and locator of each row; a locator is the file and the row in it."""
    return docs.select(
        "*",
        digest(normalised(F.col(text))).alias("__dup_digest"),
        F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__dup_place"),
    )


def bounded(spark: SparkSession, path: str, batches: int = 4, most: int = 1 << 30) -> dict[str, str]:
    """Options for micro-batches of a part of the table's files, at most `most` bytes (or one file) each."""
    size = int(str(spark.read.parquet(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return {"maxBytesPerTrigger": str(max(1, min(most, -(-size // batches))))}


def streamed_state(spark: SparkSession, path: str, key: str, text: str, digest: Callable[[Column], Column], options: dict[str, str]) -> DataFrame:
    """(digest, first, n) of all texts under `path`, gathered by a stream.

    The stream's state has for each digest, without expiry, the place of the
    least key seen (its identifier and content locator) and how often the digest
    came. It lives in RocksDB on the executors' disks; its changes go to the
    checkpoint with each micro-batch, so a lost executor resumes from the last.
    The folder is fresh, so a restarted driver begins anew. Rows of a digest are
    combined before the shuffle, so copies cost one state update per task. Each
    micro-batch writes the entries it changed under its own number, which a
    repeated batch overwrites.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name, value in ROCKSDB_OPTIONS.items():
        session.conf.set(f"spark.sql.streaming.stateStore.rocksdb.{name}", value)
    # Executors let go of a stopped stream's stores at their next maintenance, a minute later by default.
    session.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "5s")
    session.conf.set("spark.sql.shuffle.partitions", str(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // STORES)))
    base, path = folder(spark, "dedup-state"), path.rstrip("/")
    schema = spark.read.parquet(path).schema
    one = f"{path[:-1]}[{path[-1]}]"  # the same path as a pattern: a stream takes a single file only by a pattern
    arrivals = _arrivals(session.readStream.schema(schema).options(**options).parquet(one), key, text, digest)
    state = arrivals.groupBy(F.col("__dup_digest").alias("digest")).agg(F.min("__dup_place").alias("first"), F.count("*").alias("n"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch={number}")

    stream = state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    if stream.lastProgress is None and not spark.read.parquet(path).head(1):
        return spark.createDataFrame([], state.schema)
    changes = spark.read.option("basePath", f"{base}/changes").parquet(f"{base}/changes")
    latest = F.max_by(F.struct("first", "n"), "batch").alias("entry")
    return changes.groupBy("digest").agg(latest).select("digest", "entry.first", "entry.n")


def _grouped(spark: SparkSession, path: str, key: str, text: str, digest: Callable[[Column], Column], columns: list[str], options: dict[str, str]) -> DataFrame:
    """The columns, the row's place and digest, and its group's first place and size."""
    state = streamed_state(spark, path, key, text, digest, options)
    rows = _arrivals(spark.read.parquet(path), key, text, digest)
    met = rows.join(state, rows["__dup_digest"] == state["digest"]).select(
        *[rows[c] for c in columns], F.col("__dup_place"), F.col("__dup_digest"), F.col("first").alias("__dup_first"), F.col("n").alias("__dup_n"), F.when(F.col("n") > 1, normalised(rows[text])).alias("__dup_text")
    )
    met = table(met, "dedup-rows")
    hits = met.filter("__dup_n > 1")
    kept = hits.filter(F.col("__dup_place") == F.col("__dup_first")).select("__dup_digest", F.col("__dup_text").alias("__dup_bytes"))
    checked = hits.join(kept, "__dup_digest").withColumn("__dup_other", F.when(F.col("__dup_text") != F.col("__dup_bytes"), F.col("__dup_text"))).drop("__dup_text", "__dup_bytes", "__dup_first", "__dup_n")
    group = [F.col("__dup_digest").alias("__dup_group"), F.col("__dup_other").alias("__dup_bytes")]
    groups = checked.groupBy(*group).agg(F.min("__dup_place").alias("__dup_first"), F.count("*").alias("__dup_n"))
    same = (F.col("__dup_digest") == F.col("__dup_group")) & F.col("__dup_other").eqNullSafe(F.col("__dup_bytes"))
    repeated = checked.join(groups, same).select(*columns, "__dup_place", "__dup_digest", "__dup_first", "__dup_n")
    single = met.filter("__dup_n = 1").select(*columns, "__dup_place", "__dup_digest", "__dup_first", "__dup_n")
    return single.unionByName(repeated)


def exact_duplicates(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, columns: list[str] | None = None, **options: str) -> DataFrame:
    """The rows of the Parquet table at `path` with keep_id, group_size, kept and text_digest.

    Texts are equal when they are after each run of ASCII white space is one
    space; null is empty. A stream over the table's files keeps for each digest
    the row of the least key (streamed_state()). A hit, a row whose digest came
    before or after, is checked byte by byte against that row's text, found by
    its locator; rows that differ in spite of an equal digest are grouped by
    their bytes. Null keys come last; of rows with the same key, the first in
    the table's files. Of each group the least row is `kept`.

    `columns` are those to return besides (by default, the key); `options` go to
    the stream's file source (maxFilesPerTrigger, maxBytesPerTrigger). Columns
    of the added names are replaced.
    """
    own = ["keep_id", "group_size", "kept", "text_digest"]
    columns = [c for c in columns or [key] if c not in own]
    found = _grouped(spark, path, key, text, digest, columns, options)
    return found.select(*columns, F.col("__dup_first.key").alias("keep_id"), F.col("__dup_n").alias("group_size"), (F.col("__dup_place") == F.col("__dup_first")).alias("kept"), F.col("__dup_digest").alias("text_digest"))


def stored_at(docs: DataFrame) -> str | None:
    """The folder of Parquet files that `docs` reads as it is, without partition columns; None if it is anything else."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    relation = plan.relation()
    roots = relation.location().rootPaths()
    if relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat" or relation.partitionSchema().nonEmpty() or roots.size() != 1:
        return None
    return roots.head().toString()


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of any DataFrame that exact_duplicates() keeps, with its columns.

    A stream reads files, so anything but a stored table is written first.
    """
    spark, path = docs.sparkSession, stored_at(docs)
    if path is None:
        path = folder(spark, "dedup-docs")
        docs.write.option("compression", "zstd").parquet(path)
    found = _grouped(spark, path, key, text, sha256, docs.columns, bounded(spark, path))
    return found.filter(F.col("__dup_place") == F.col("__dup_first")).select(*docs.columns)
