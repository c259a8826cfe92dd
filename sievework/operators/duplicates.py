"""Pairs of texts in a group that duplicate each other, without comparing all of a group's texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.cleaning import EVIDENCE_STOPWORDS, squeezed
from sievework.functions.tokens import evidence_tokens, with_value
from sievework.sources.work import table

#: Fixed value: texts of this length or more duplicate one that contains them.
CONTAINED = 90
#: Characters of a block: any CONTAINED characters hold a whole one of those that a text is cut into.
BLOCK = CONTAINED // 2
#: Parts into which the rows of a common word are dealt, by rows a part.
PART_ROWS = 1000


def _blocks(text: Column, whole: bool) -> Column:
    """Hashes of the text's consecutive blocks, or of runs as long at its first BLOCK places. A text that contains another has one of its runs as a block."""

    def hashes(letters: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(letters) - BLOCK + 1, F.lit(BLOCK)) if whole else F.sequence(F.lit(1), F.lit(BLOCK))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(letters, i, BLOCK), ""))))

    return with_value(F.split(text, ""), hashes)


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The two sides' rows with equal keys, a common key's rows dealt to several tasks: the left's split, the right's repeated."""
    sizes = left.groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > PART_ROWS).select(*on, F.ceil(F.col("__n") / PART_ROWS).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    a = left.join(sizes, on, "left").withColumn("__part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("__parts")
    b = right.join(sizes, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return a.join(b, [*on, "__part"])


def duplicate_links(rows: DataFrame, group: str, key: str, text: str, threshold: float = 0.68) -> tuple[DataFrame, DataFrame]:
    """(group, a, b), links between different texts, and (group, key, id), the text of each row; a text is named by its least key.

    Linked are texts that are equal but for case and white space, of which one
    contains the other (both of 90 characters or more), or whose words'
    similarity is `threshold` or more.

    Similar sets share one of their rarest
    words, of which a set of n has n - ceil(threshold n) + 1 to compare by; sets
    of unlike sizes aren't compared. Of a text that contains another, a block of 45
    characters begins at one of the other's first 45 places, so a text is compared
    only with those that have one of its runs as a block. What meets is checked by the whole rule. Nulls
    are empty texts; null groups have no pairs; keys are distinct within a group.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    plain = F.lower(squeezed(F.coalesce(F.col(text), F.lit("")), " "))
    held = table(rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).select(group, F.col(key).alias("k"), plain.alias("x"), F.array_distinct(evidence_tokens(F.coalesce(F.col(text), F.lit("")), EVIDENCE_STOPWORDS)).alias("w")), "duplicate-rows")
    # One row stands for all with its text; what words two texts have follows from more than the plain text, so they stand apart by both.
    same = [group, "x", "w"]
    kinds = held.groupBy(*same).agg(F.min("k").alias("id"), F.count("*").alias("copies"))
    kinds = table(kinds.withColumn("n", F.size("w")), "duplicate-texts")
    members = table(held.join(kinds.select(*same, "id"), same).select(group, "k", "id"), "duplicate-members")

    each = kinds.select(group, "id", "n", F.explode("w").alias("word"))
    df = each.groupBy(group, "word").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy(group, "id").orderBy("df", "word"))
    kept = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    few = table(each.join(df, [group, "word"]).withColumn("place", rare).filter((F.col("place") <= kept) & (F.col("df") > 1)).select(group, "id", "n", "word"), "duplicate-rare-words")
    side = lambda df_, name, *more: df_.select(group, *more, F.col("id").alias(name), F.col("n").alias(f"n_{name}"))
    by_word = _met(side(few, "a", "word"), side(few, "b", "word"), [group, "word"]).filter((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9)).select(group, "a", "b")

    long = kinds.filter(F.length("x") >= CONTAINED)
    inner = long.select(group, "id", "n", F.explode(_blocks(F.col("x"), False)).alias("gram"))
    outer = long.select(group, "id", "n", F.explode(_blocks(F.col("x"), True)).alias("gram"))
    within = _met(side(inner, "a", "gram"), side(outer, "b", "gram"), [group, "gram"]).filter("a <> b").select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Texts that are equal but for their words' case sensitive parts.
    twins = kinds.groupBy(group, "x").agg(F.array_sort(F.collect_set("id")).alias("l")).filter(F.size("l") > 1).select(group, F.col("l")[0].alias("a"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("b"))

    candidates = by_word.unionByName(within).unionByName(twins).distinct()
    of = lambda name, x, w: kinds.select(group, F.col("id").alias(name), F.col("x").alias(x), F.col("w").alias(w))
    met = candidates.join(of("a", "x", "v"), [group, "a"]).join(of("b", "y", "w"), [group, "b"])
    contained = (F.least(F.length("x"), F.length("y")) >= CONTAINED) & (F.contains("x", "y") | F.contains("y", "x"))
    shared = F.size(F.array_intersect("v", "w"))
    alike = shared / F.greatest(F.lit(1), F.size("v") + F.size("w") - shared) >= threshold
    return met.filter((F.col("x") == F.col("y")) | contained | alike).select(group, "a", "b"), members.withColumnRenamed("k", key)


def duplicate_pairs(rows: DataFrame, group: str, key: str, text: str, threshold: float = 0.68) -> DataFrame:
    """(group, key_a, key_b), the lesser key first: all pairs of rows whose texts are equal or linked by duplicate_links()."""
    links, members = duplicate_links(rows, group, key, text, threshold)
    members = members.withColumnRenamed(key, "k")
    links = table(links, "duplicate-links")
    mine = lambda name, k: members.select(group, F.col("id").alias(name), F.col("k").alias(k))
    between = links.join(mine("a", "p"), [group, "a"]).join(mine("b", "q"), [group, "b"]).select(group, "p", "q")
    copies = mine("a", "p").join(mine("a", "q"), [group, "a"]).filter("p < q").select(group, "p", "q")
    return between.unionByName(copies).select(group, F.least("p", "q").alias(f"{key}_a"), F.greatest("p", "q").alias(f"{key}_b"))
