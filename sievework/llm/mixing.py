"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.work import table

#: A rate above this is drawn as a sum of independent Poisson counts of at most this mean.
STEP = 16.0
#: Counts told apart in one draw; the mass of Poisson(STEP) beyond is under 2**-53.
LEVELS = 80


def unit(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts: its first 52 bits."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def cumulative(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... below LEVELS, as an array."""
    log_factorials = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(LEVELS)])
    mass = F.transform(log_factorials, lambda x, k: F.exp(k * F.log(rate) - rate - x))
    sums = F.aggregate(
        mass,
        F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("all")),
        lambda acc, p: F.struct((acc["total"] + p).alias("total"), F.concat(acc["all"], F.array(acc["total"] + p)).alias("all")),
    )
    return F.when(rate > 0, sums["all"])


def inverted(cdf: Column, u: Column) -> Column:
    """The smallest count whose cumulative probability exceeds u; 0 where there is no cdf."""
    return F.coalesce(F.size(F.filter(cdf, lambda c: c <= u)), F.lit(0))


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, size: float, source: str) -> DataFrame:
    """One row per source: how often each of its documents repeats on average."""
    per = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__mix_source")).agg(F.count("*").alias("__mix_n"))
    if weights is None:
        weight = F.pow(F.col("__mix_n").cast("double"), F.lit(temperature))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else None
        weight = F.coalesce(given[F.col("__mix_source")], F.lit(0.0)) if weights else F.lit(0.0)
    per = per.withColumn("__mix_weight", weight)
    totals = per.agg(F.sum("__mix_n").alias("n"), F.sum("__mix_weight").alias("w"))
    whole, mass = totals.select("n").scalar(), totals.select("w").scalar()
    rate = F.when(mass > 0, F.col("__mix_weight") / mass * whole * F.lit(float(size)) / F.col("__mix_n")).otherwise(0.0)
    return (
        per.withColumn("__mix_rate", rate)
        .withColumn("__mix_steps", F.floor(F.col("__mix_rate") / STEP).cast("int"))
        .withColumn("__mix_cdf", cumulative(F.col("__mix_rate") - F.floor(F.col("__mix_rate") / STEP) * STEP))
        .withColumn("__mix_step_cdf", F.when(F.col("__mix_steps") > 0, cumulative(F.lit(STEP))))
        .drop("__mix_n", "__mix_weight")
    )


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    size: float = 1.0,
    seed: str = "mix",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """`docs` repeated so that sources approach their target shares, in a random global order.

    A source with weight w and n of all N documents gets the rate
    w / sum(w) * N * size / n. Each document draws its number of copies from
    the Poisson distribution of that mean, by inverting it at a number hashed
    from seed and key, and the copies are sorted by a hash over the cluster (a
    partition for each of spark.sql.shuffle.partitions, in order).
    Without `weights` a source weighs n ** temperature; with them, a source not
    named has weight 0.

    Added columns: mix_rate, mix_copies (of this document), mix_copy (from 1)
    and mix_order (the sort key); columns of these names in `docs` are replaced.
    A null source counts as the source "", a null key as the key "". Rows with
    the same key draw the same count. An empty table stays empty.

    Only counts of sources are shuffled before the copies are made. The rates
    are written as a small table first, so that Spark knows its size when it
    plans the join: it broadcasts the rates if they are below its threshold,
    and otherwise joins by a shuffle in which a hot source is split.
    """
    own = ["mix_rate", "mix_copies", "mix_copy", "mix_order"]
    docs = docs.drop(*own)
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    named = docs.withColumn("__mix_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    steps = F.aggregate(
        F.when(F.col("__mix_steps") > 0, F.sequence(F.lit(1), F.col("__mix_steps"))).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda total, j: total + inverted(F.col("__mix_step_cdf"), unit(F.lit(seed), ident, j.cast("string"))),
    )
    count = inverted(F.col("__mix_cdf"), unit(F.lit(seed), ident, F.lit("0"))) + steps
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), ident, F.col("mix_copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The sort key is uniform over 60 bits, so its range needs no sample: a sampled sort would draw everything twice.
    place = F.least(F.lit(parts - 1), F.floor(F.col("mix_order") / F.lit(2.0**60) * parts)).cast("int")
    return (
        named.join(table(rates(docs, weights, temperature, size, source), "mix-rates"), "__mix_source")
        .withColumn("mix_copies", count)
        .filter("mix_copies > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .withColumn("mix_order", order)
        .withColumnRenamed("__mix_rate", "mix_rate")
        .select(*docs.columns, *own)
        .repartitionById(parts, place)
        .sortWithinPartitions("mix_order", key, "mix_copy")
    )
