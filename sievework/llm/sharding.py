"""Shards of near-equal size by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.work import table


def sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`docs` with a size (UTF-8 bytes and 1), a CRC, and a place in the order that is cut into ranges.

    The order is by a hash of the text, then a hash of the key: equal texts are
    together, in a random order, and a large group of them can be cut.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "__shard_size": (F.octet_length(whole) + 1).cast("long"),
            "__shard_crc": F.crc32(whole.cast("binary")),
            "__shard_high": F.xxhash64(whole),
            "__shard_low": F.xxhash64(F.col(key).cast("string"), F.lit("low")),
        }
    )


def splitters(rows: DataFrame, ranges: int, per: int = 64) -> np.ndarray:
    """Places (high, low) between ranges of about equal size, from a sample weighted by size.

    About `ranges` * `per` rows are drawn, each with a probability in
    proportion to its size (a row large enough is drawn for certain), by a hash
    of its place: a lost task draws the same rows again. Where the two samples
    around a boundary have different texts, the boundary is moved to the start
    of the second's, so only groups of many copies are cut.
    """
    total = rows.agg(F.sum("__shard_size")).first()[0] or 0
    if not total:
        return np.empty((0, 2), np.int64)
    rate = ranges * per / total
    chance = F.least(F.lit(1.0), F.col("__shard_size") * rate)
    drawn = (F.xxhash64("__shard_high", "__shard_low", F.lit("draw")).cast("double") / F.lit(2.0**64) + 0.5) < chance
    got = rows.filter(drawn).select("__shard_high", "__shard_low", (F.col("__shard_size") / chance).alias("weight")).toArrow()
    high, low, weight = (got.column(i).to_numpy() for i in range(3))
    order = np.lexsort((low, high))
    high, low, weight = high[order], low[order], np.cumsum(weight[order])
    if not len(high):
        return np.empty((0, 2), np.int64)
    at = np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges))
    at = at[(at > 0) & (at < len(high))]
    first = np.where(high[at - 1] == high[at], low[at], np.iinfo(np.int64).min)
    return np.unique(np.stack([high[at], first], 1), axis=0)


def ranged(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """The range of each row, by binary search; only the two hashes go through Python."""
    high = cuts[:, 0]
    low_of: dict[int, np.ndarray] = {int(h): cuts[high == h, 1] for h in np.unique(high)}
    distinct = np.array(sorted(low_of), dtype=np.int64)
    before = np.concatenate(([0], np.cumsum([len(low_of[int(h)]) for h in distinct]))).astype(np.int64)

    @F.pandas_udf("int")
    def place(high: pd.Series, low: pd.Series) -> pd.Series:
        h, lo = high.to_numpy(), low.to_numpy()
        at = np.searchsorted(distinct, h)
        out = before[at]
        same = np.flatnonzero((at < len(distinct)) & (distinct[np.minimum(at, max(0, len(distinct) - 1))] == h)) if len(distinct) else np.empty(0, int)
        for value in np.unique(h[same]):
            mine = same[h[same] == value]
            out[mine] += np.searchsorted(low_of[int(value)], lo[mine], side="right")
        return pd.Series(out.astype(np.int32))

    return rows.withColumn("__shard_range", place("__shard_high", "__shard_low"))


def sharded(docs: DataFrame, shards: int = 8, rows_per_range: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` in shards of near-equal bytes, with size, text_crc32, law, shard, slot and grown_shard.

    A row's size is its text's UTF-8 bytes and 1. Splitters from a size-weighted
    sample cut the order of sizes() into many ranges (at least 16 a shard and 8 a
    shuffle partition, at most 16,384; beyond that ranges grow, and a task sorts
    its range on disk). The ranges' exact sizes
    come to the driver, and shards are runs of ranges. A range in which a shard's
    share ends is overfull and subdivided: its groups of equal texts go to the
    side where the middle of their bytes falls, and a group larger than a
    thousandth of a shard is cut between rows. So shards differ by about a
    thousandth of a shard, or one row, at most, and each shard has its rows in
    slots 0, 1, ...

    grown_shard is null: this law (`bytes`) does not fix where rows go when a
    shard is added. A null text is empty, a null key hashes as one. Equal rows
    are told apart by nothing; they take neighbouring slots. Columns of the
    added names are replaced.
    """
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = docs.drop(*own)
    rows = sizes(docs, key, text)
    many = rows.count()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = int(min(16_384, max(16 * shards, 8 * parts, many // rows_per_range)))
    rows = table(ranged(rows, splitters(rows, ranges)), "shard-rows")
    whole = rows.groupBy("__shard_range").agg(F.sum("__shard_size").alias("bytes")).orderBy("__shard_range").toPandas()
    ends = np.cumsum(whole["bytes"].to_numpy(dtype=np.int64))
    total = int(ends[-1]) if len(ends) else 0
    target = total / shards
    begins = {int(r): int(e - b) for r, e, b in zip(whole["__shard_range"], ends, whole["bytes"], strict=True)}
    starts = docs.sparkSession.createDataFrame([(int(r), int(b)) for r, b in begins.items()], "__shard_range int, __shard_begin long")
    order = ["__shard_high", "__shard_low", F.col(key).asc_nulls_first()]
    in_range = Window.partitionBy("__shard_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("__shard_range", "__shard_high")
    at = F.col("__shard_begin") + F.coalesce(F.sum("__shard_size").over(in_range), F.lit(0))
    met = (
        rows.join(F.broadcast(starts), "__shard_range")
        .withColumn("__shard_at", at)
        .withColumn("__shard_group", F.sum("__shard_size").over(group))
        .withColumn("__shard_first", F.min("__shard_at").over(group))
    )
    middle = F.when(F.col("__shard_group") <= target / 1000, F.col("__shard_first") + F.col("__shard_group") / 2).otherwise(F.col("__shard_at") + F.col("__shard_size") / 2)
    met = met.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / max(target, 1e-9))).cast("int"))
    mine = Window.partitionBy("__shard_range").orderBy("shard", *order)
    met = table(met.withColumn("__shard_rank", F.row_number().over(mine)), "shard-ranks")
    counts = met.groupBy("__shard_range", "shard").agg(F.count("*").alias("n"), F.min("__shard_rank").alias("r")).orderBy("shard", "__shard_range").toPandas()
    counts["base"] = counts.groupby("shard")["n"].cumsum() - counts["n"] - counts["r"]
    bases = docs.sparkSession.createDataFrame([tuple(int(x) for x in r) for r in counts[["__shard_range", "shard", "base"]].itertuples(index=False)], "__shard_range int, shard int, __shard_base long")
    return met.join(F.broadcast(bases), ["__shard_range", "shard"]).select(
        *docs.columns,
        F.col("__shard_size").alias("size"),
        F.col("__shard_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__shard_base") + F.col("__shard_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
