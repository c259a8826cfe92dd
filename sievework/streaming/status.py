"""The state of runs as a table: what a driver wrote about them is there after it is gone."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = T.StructType(
    [
        T.StructField("at", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("done", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("run", T.StringType()),
    ]
)


def put(spark: SparkSession, path: str, run: str, state: str, done: int, total: int | None, seconds: float, error: str | None = None) -> None:
    """Adds one row about a run, as a file of its own, which readers see whole or not at all."""
    row = (time.time_ns() // 1000, state, done, total, float(seconds), error, run)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").partitionBy("run").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(run, state, done, total, seconds, error, rate, seconds_left): the last row of each run, the rate in rows a second."""
    fields = [f for f in SCHEMA.fieldNames() if f not in ("run", "at")]
    last = history(spark, path).groupBy("run").agg(F.max_by(F.struct(*fields), "at").alias("s")).select("run", "s.*")
    rate = F.try_divide("done", "seconds")
    return last.withColumn("rate", rate).withColumn("seconds_left", F.when(F.col("state") == "running", F.try_divide(F.col("total") - F.col("done"), "rate")))


class StatusTable(StreamingQueryListener):
    """Writes a row for each start, micro-batch and end of the session's streams; a stream's run is its id, which restarts keep.

    `total` is how many rows are expected, if that is known. Rows and seconds of
    a stream that goes on from its checkpoint count from this start.
    """

    def __init__(self, spark: SparkSession, path: str, total: int | None = None) -> None:
        self.spark, self.path, self.total = spark, path, total
        self.done: dict[str, int] = {}
        self.begun: dict[str, float] = {}

    def _put(self, run: str, state: str, error: str | None = None) -> None:
        put(self.spark, self.path, run, state, self.done[run], self.total, time.monotonic() - self.begun[run], error)

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        run = str(event.id)
        self.done[run], self.begun[run] = 0, time.monotonic()
        self._put(run, "started")

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        run = str(event.progress.id)
        self.done[run] += event.progress.numInputRows
        self._put(run, "running")

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self._put(str(event.id), "failed" if event.exception else "done", event.exception)
