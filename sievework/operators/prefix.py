"""Running sums over a whole table, without sorting it in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.work import table

#: Ranges of the order key, at most; their sums are the only thing that one task sees of all rows.
RANGES = 4096


def running_sum(df: DataFrame, order: str, value: str, name: str, ties: list[str] | None = None) -> DataFrame:
    """`df` with `name`: the sum of `value` over all rows with a lesser `order`, an integer key.

    Nulls come first; rows of equal keys are told apart by the columns `ties`, if
    keys repeat, and lie in one range. Quantiles of the key cut it into ranges of about as many rows each, whatever
    its gaps; each range is summed, the ranges' sums are accumulated, and rows
    are accumulated within their range.
    """
    many = int(min(RANGES, df.count() // 1000))
    cuts = np.array(sorted({int(x) for x in df.approxQuantile(order, [i / (many + 1) for i in range(1, many + 1)], 0.25 / (many + 1))}) if many else [], dtype=np.int64)

    @F.pandas_udf("int")
    def placed(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    ranged = df.withColumn("__range", placed(F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))) if len(cuts) else F.lit(0))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.sum(value).alias("__s")).withColumn("__start", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    within = Window.partitionBy("__range").orderBy(order, *(ties or ())).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, "__range").withColumn(name, F.col("__start") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__range", "__start")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `name`: each row's number, from 1, in order of the columns; rows alike in all of them are numbered in any order.

    Rows are dealt to ranges of the order and sorted there, and written with
    their place in the range; the ranges' sizes, one number for each, give where a
    range begins. Give a stored table: ranges are sampled from it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # An id that rises with the row holds the partition above its lower 33 bits.
    at = F.monotonically_increasing_id()
    placed = table(ranged.select("*", F.shiftrightunsigned(at, 33).alias("__range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "numbered")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__place") + 1).drop("__range", "__place", "__start")
