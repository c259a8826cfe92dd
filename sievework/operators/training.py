"""Preparation of training examples: packing, weighting, schedules and resumption."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.nextfit import next_fit
from sievework.operators.prefix import running_sum
from sievework.sources.work import table

#: The label of positions that are not learned.
IGNORED = -100


def contiguous_blocks(docs: DataFrame, key: str, tokens: str, length: int, end: int, pad: int) -> DataFrame:
    """(block, input_ids, valid): the stream of all documents' ids, each followed by `end`, cut every `length`.

    The ids are made once, into a table, whose rows are numbered; a running sum
    over their lengths in order of the key, an integer (nulls first, of equal keys
    the lesser digest of the ids), gives each row its place in the stream. A row
    sends a slice to each block it reaches, and a block joins its slices.
    """
    stream = docs.select(F.col(key).alias("__key"), F.concat(F.coalesce(F.col(tokens), F.array().cast("array<int>")), F.array(F.lit(end))).alias("__ids")).filter(F.size("__ids") > 1)
    stream = table(stream.select("*", F.size("__ids").alias("__n"), F.xxhash64("__ids").alias("__digest"), F.monotonically_increasing_id().alias("__row")), "ids")
    places = running_sum(stream.select("__key", "__n", "__digest", "__row"), "__key", "__n", "__at", ["__digest", "__row"])
    placed = stream.join(places.select("__row", "__at"), "__row")
    blocks = F.sequence(F.floor(F.col("__at") / length), F.floor((F.col("__at") + F.col("__n") - 1) / length))
    cut = placed.withColumn("block", F.explode(blocks))
    start = F.greatest(F.lit(0), F.col("block") * length - F.col("__at")).cast("int")
    stop = F.least(F.col("__n"), (F.col("block") + 1) * length - F.col("__at")).cast("int")
    slices = cut.select("block", F.struct(F.col("__at").alias("at"), F.slice("__ids", start + 1, stop - start).alias("ids")).alias("s"))
    joined = slices.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["ids"])).alias("__ids"))
    valid = F.size("__ids")
    return joined.select("block", F.concat("__ids", F.array_repeat(F.lit(pad), length - valid)).alias("input_ids"), valid.alias("valid"))


def weighted_example(prefix: Column, answer: Column, weight: Column, length: int, least_prefix: int) -> Column:
    """input_ids, labels and weights of one example: the answer cut to fit, the prefix cut at its left."""
    answer = F.slice(answer, 1, length - least_prefix)
    room = F.least(F.size(prefix), F.lit(length) - F.size(answer))
    front = F.slice(prefix, F.greatest(F.size(prefix) - room + 1, F.lit(1)), room)
    share = weight / F.size(answer)
    return F.struct(
        F.concat(front, answer).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(IGNORED), F.size(front)), answer).alias("labels"),
        F.concat(F.array_repeat(F.lit(0.0), F.size(front)), F.transform(answer, lambda _: share)).alias("weights"),
    )


def valid_chat(messages: Column, roles: tuple[str, ...] = ("system", "user", "assistant")) -> Column:
    """Whether a whole message list has exactly these roles and no blank content."""
    same = F.transform(messages, lambda m: m["role"]) == F.array(*[F.lit(r) for r in roles])
    return same & ~F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == "")


def encoded_chats(rows: DataFrame, messages: str, prefix: str, full: str, most: int, targets: int = 4) -> DataFrame:
    """`rows` with labels and the fault that forbids their use, or null.

    `prefix` and `full` are the ids of the messages without and with the answer,
    made by a tokenizer. The full ids must begin with the prefix's, which are
    not learned, have at most `most` ids, and leave at least `targets` of them.
    """
    n, m = F.size(prefix), F.size(full)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(full, n + 1, F.greatest(m - n, F.lit(0))))
    fault = (
        F.when(~F.coalesce(valid_chat(F.col(messages)), F.lit(False)), "roles")
        .when(F.coalesce(F.slice(full, 1, n) != F.col(prefix), F.lit(True)), "prefix")
        .when(m > most, "length")
        .when(m - n < targets, "targets")
    )
    return rows.withColumn("fault", fault).withColumn("labels", F.when(F.col("fault").isNull(), labels))


def packed_examples(rows: DataFrame, group: str, key: str, ids: str, labels: str, weights: str, capacity: int, pad: int, sample_weight: str, seed: int = 0) -> DataFrame:
    """Blocks of examples in an order shuffled by `seed`: a new block when the next doesn't fit, closed when exactly full.

    Columns: the group, block, input_ids, labels and weights (the group's last
    block padded to `capacity`), valid, learned, samples and sample_weight. Rows
    are numbered first, so each is packed once, whatever its key: null and equal
    keys are rows of their own (equal keys in order of their contents), null
    groups are one. A block without learned ids or weight raises an error, as
    does a group whose blocks' weights aren't its examples'; blocks are written
    and checked before they are returned.
    """
    numbered = rows.select(F.col(group).alias("group"), F.col(key).cast("string").alias("key"), F.col(ids).alias("i"), F.col(labels).alias("l"), F.col(weights).alias("w"), F.col(sample_weight).cast("double").alias("weight"), F.monotonically_increasing_id().alias("row"))
    numbered = table(numbered, "examples")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "key").cast("binary"))
    sized = numbered.select("group", "row", F.size("i").alias("size"), order.alias("order"), "key", F.xxhash64("i", "l", "w", "weight").alias("digest"))
    placed = table(next_fit(sized, "group", "row", "size", capacity, ["order", "key", "digest"], flush_full=True), "places")
    parts = F.array_sort(F.collect_list(F.struct("place", "i", "l", "w")))
    joined = lambda c: F.flatten(F.transform("parts", lambda x: x[c]))
    met = numbered.join(placed.select("row", "block", "place"), "row")
    blocks = met.groupBy("group", "block").agg(parts.alias("parts"), F.count("*").alias("samples"), F.sum("weight").alias("sample_weight"))
    last = placed.groupBy(F.col("group").alias("of")).agg(F.max("block").alias("last"))
    whole = blocks.join(last, F.col("group").eqNullSafe(F.col("of"))).select("group", "block", "samples", "sample_weight", joined("i").alias("input_ids"), joined("l").alias("labels"), joined("w").alias("weights"), (F.col("block") == F.col("last")).alias("ends"))
    gap = F.when(F.col("ends"), F.lit(capacity) - F.size("input_ids")).otherwise(0)
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), gap)).alias(c)
    learned = F.size(F.filter("labels", lambda x: x != IGNORED))
    sound = F.when((learned > 0) & (F.col("sample_weight") > 0), learned).otherwise(F.raise_error(F.lit("a block has nothing to learn")).cast("int"))
    made = whole.select(F.col("group").alias(group), "block", fill("input_ids", pad), fill("labels", IGNORED), fill("weights", 0.0), F.size("input_ids").alias("valid"), sound.alias("learned"), "samples", "sample_weight")
    made = table(made, "blocks")
    lost = conserved(made, numbered.select(F.col("group").alias(group), F.col("weight").alias("__weight")), group, "__weight").filter("not conserved").take(5)
    if lost:
        raise ValueError(f"the weights of groups changed in packing: {[tuple(r) for r in lost]}")
    return made


def conserved(blocks: DataFrame, rows: DataFrame, group: str, weight: str, tolerance: float = 1e-5) -> DataFrame:
    """(group, before, after, conserved): whether the blocks' weights are their examples', within `tolerance` of the larger of 1 and the sum."""
    before = rows.groupBy(F.col(group).alias("__g")).agg(F.sum(F.col(weight).cast("double")).alias("before"))
    after = blocks.groupBy(F.col(group).alias("__h")).agg(F.sum("sample_weight").alias("after"))
    both = before.join(after, F.col("__g").eqNullSafe(F.col("__h")), "full_outer").select(F.coalesce("__g", "__h").alias(group), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("before", "after")])
    return both.withColumn("conserved", F.abs(F.col("before") - F.col("after")) <= tolerance * F.greatest(F.lit(1.0), F.abs("before")))


def learning_rate(step: Column, warmup: int, total: int) -> Column:
    """The factor of a linear warm-up and a cosine fall."""
    progress = F.least((step - warmup) / max(1, total - warmup), F.lit(1.0))
    return F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(math.pi * progress))))


def kept_checkpoints(steps: DataFrame, step: str, recent: int, milestone: int) -> DataFrame:
    """Which checkpoints stay: the last `recent` and every milestone. A run has few checkpoints."""
    nth = F.row_number().over(Window.orderBy(F.desc(step)))
    return steps.withColumn("kept", (nth <= recent) | (F.col(step) % milestone == 0))


def moving_mean(rows: DataFrame, run: str, step: str, loss: str, width: int = 20) -> DataFrame:
    frame = Window.partitionBy(run).orderBy(step).rowsBetween(1 - width, 0)
    return rows.withColumn("recent_mean", F.avg(loss).over(frame))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is not done yet."""
    return work.join(done.select(key), key, "left_anti")


def packing_summary(blocks: DataFrame, size: str, capacity: int) -> DataFrame:
    return blocks.agg(F.count("*").alias("blocks"), F.sum(size).alias("valid_tokens"), (F.sum(size) / (F.count("*") * capacity)).alias("utilisation"))


def padded(arrays: DataFrame, array: str, pad: int) -> DataFrame:
    """All arrays as long as the longest of their batch."""
    longest = F.max(F.size(array)).over(Window.partitionBy("batch"))
    return arrays.withColumn("__n", longest).withColumn(array, F.concat(array, F.array_repeat(F.lit(pad), (F.col("__n") - F.size(array)).cast("int")))).drop("__n")
