"""Streams of events: windows, sessions, duplicates, append logs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from sievework.sources.work import folder


def stream_of(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The Parquet files of a path as a stream. The path goes in as a pattern, which also takes a single file."""
    path = path.rstrip("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed(events: DataFrame, time: str, keys: list[str], width: str, measures: list[Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Measures per window and key; `late` is how long a stream waits."""
    typed = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = typed.withWatermark(time, late) if late else typed
    window = F.window(time, width, slide) if slide else F.window(time, width)
    found = rows.groupBy(window.alias("w"), *keys).agg(*measures)
    return found.select(F.col("w.start").alias("window_start"), *[c for c in found.columns if c != "w"])


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Each key's sessions: events apart by less than `gap`."""
    found = events.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("events"))
    return found.select(key, F.col("s.start").alias("session_start"), "events")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The stream's result after all that there is: each micro-batch replaces (complete) or adds under its number."""
    spark = stream.sparkSession
    base = folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        target = f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out" if mode == "complete" else f"{base}/out/*")


def deduplicated(events: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """The first event of each key; with a time, keys are forgotten after `late`."""
    if time and late:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


class Progress(StreamingQueryListener):
    """Rows, rate and state of each micro-batch, kept in `seen`."""

    def __init__(self) -> None:
        self.seen: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.seen.append({"state": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.seen.append({"state": "running", "id": str(p.id), "rows": p.numInputRows, "rate": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.seen.append({"state": "failed" if event.exception else "done", "id": str(event.id)})


def observed(rows: DataFrame, name: str):  # noqa: ANN201
    """Rows with a count that is known once they have been read."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("rows")), seen


STATUS = T.StructType([T.StructField("state", T.StringType()), T.StructField("done", T.LongType()), T.StructField("total", T.LongType()), T.StructField("seconds", T.DoubleType())])


def status_row(spark: SparkSession, state: str, done: int, total: int, seconds: float) -> DataFrame:
    """A progress document: counts, rate and time left."""
    rate = F.try_divide("done", "seconds")
    return spark.createDataFrame([(state, done, total, seconds)], STATUS).withColumn("rate", rate).withColumn("seconds_left", F.try_divide(F.col("total") - F.col("done"), rate))
