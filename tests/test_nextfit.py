"""Next-fit packing in ranges against the sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import nextfit, training


def sequential(sizes, capacity, flush):
    """(block, place) of each size in turn."""
    out, block, used, n = [], 0, None, 0
    for s in sizes:
        if used is not None and used + s > capacity:
            block, used, n = block + 1, None, 0
        out.append((block, n))
        used, n = (used or 0) + s, n + 1
        if flush and used == capacity:
            block, used, n = block + 1, None, 0
    return out


def wanted(rows, capacity, flush):
    out, groups = [], {}
    for g, k, n in rows:
        groups.setdefault(g, []).append((k, n))
    for g, items in groups.items():
        items.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        out += [(g, k, b, p) for (k, _), (b, p) in zip(items, sequential([n for _, n in items], capacity, flush), strict=True)]
    return sorted(out, key=str)


@pytest.mark.parametrize("flush", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_ranges_are_the_sequential_rule(spark, flush, seed):
    """Groups that end within ranges, one that takes up most, and one of single rows; sizes from empty to whole blocks."""
    r = random.Random(seed)
    capacity = r.choice([1, 5, 16, 64])
    rows = [(g, k, r.choice([0, 1, capacity, r.randint(0, capacity)])) for g, n in (("a", 150), (None, 40), ("b", 1), ("c", 300), ("d", 2)) for k in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, n int")
    found = nextfit.next_fit(df, "g", "k", "n", capacity, flush_full=flush, range_rows=r.choice([7, 13, 60, 10_000]))
    assert sorted(map(tuple, found.collect()), key=str) == wanted(rows, capacity, flush)


def test_many_levels_and_one_group(spark, monkeypatch):
    """One group of all rows is dealt to many ranges, composed in a tree of three levels."""
    monkeypatch.setattr(nextfit, "FAN", 3)
    r = random.Random(5)
    rows = [("all", k, r.randint(0, 9)) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, n int")
    found = nextfit.next_fit(df, "g", "k", "n", 9, range_rows=20)
    assert sorted(map(tuple, found.collect()), key=str) == wanted(rows, 9, False)


def test_equal_and_null_rows_stay(spark):
    rows = [("g", None, 2)] * 40 + [("g", 1, 3)] * 40
    df = spark.createDataFrame(rows, "g string, k int, n int")
    found = nextfit.next_fit(df, "g", "k", "n", 5, range_rows=6).collect()
    want = sequential([2] * 40 + [3] * 40, 5, False)
    assert sorted(((r["block"], r["place"]) for r in found)) == sorted(want) and [r["k"] for r in found].count(None) == 40
    assert nextfit.next_fit(df.limit(0), "g", "k", "n", 5).count() == 0


def test_bad_rows(spark):
    for bad, why in (((None,), "without a size"), ((6,), "exceeds the block length 5")):
        df = spark.createDataFrame([("g", 1, *bad)], "g string, k int, n int")
        with pytest.raises(Exception, match=why):
            nextfit.next_fit(df, "g", "k", "n", 5).collect()


def test_examples_keep_their_weight(spark):
    """Null and equal keys are examples of their own; groups that are null, too; each group's weight is conserved."""
    rows = [(g, k, [7] * n, [7] * n, [1.0] * n, w) for g, k, n, w in (("a", 1, 3, 1.0), ("a", 1, 3, 2.0), ("a", None, 4, 1.5), (None, None, 2, 0.5), (None, 2, 8, 1.0), ("b", 9, 8, 1.0))]
    df = spark.createDataFrame(rows, "g string, k int, i array<int>, l array<int>, w array<double>, sw double")
    blocks = training.packed_examples(df, "g", "k", "i", "l", "w", 8, 0, "sw", seed=1).collect()
    per = {}
    for b in blocks:
        per.setdefault(b["g"], []).append(b)
        assert b["valid"] <= 8 and len(b["input_ids"]) == len(b["labels"]) == len(b["weights"])
    assert {g: (sum(b["samples"] for b in x), sum(b["sample_weight"] for b in x), sum(b["learned"] for b in x)) for g, x in per.items()} == {"a": (3, 4.5, 10), None: (2, 1.5, 10), "b": (1, 1.0, 8)}
    lost = training.conserved(spark.createDataFrame(blocks).withColumn("sample_weight", F.col("sample_weight") * F.when(F.col("g") == "a", 1.01).otherwise(1)), df, "g", "sw")
    assert {r["g"]: r["conserved"] for r in lost.collect()} == {"a": False, None: True, "b": True}
    with pytest.raises(Exception, match="nothing to learn"):
        training.packed_examples(df.withColumn("l", F.transform("l", lambda _: F.lit(training.IGNORED))), "g", "k", "i", "l", "w", 8, 0, "sw").collect()
