"""The gate's ratio: exact where it reaches the bar, and gated once."""

import random
import time

from pyspark.sql import functions as F

from sievework.functions import python as Y
from sievework.operators import patches as P


def test_ratios_from_the_bar_on_are_exact_and_others_are_nothing(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(60):
        a = "".join(draw.choice("abcd e") for _ in range(draw.randrange(0, 60)))
        b = list(a)
        for _ in range(draw.randrange(0, 6)):
            b.insert(draw.randrange(0, len(b) + 1), draw.choice("abcd e"))
        rows.append((a, ["", "another text", "".join(b)]))
    rows += [("", []), (None, [None]), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b array<string>")
    for exact, near in df.select(Y.best_ratio("a", "b"), Y.near_ratio(F.col("a"), F.col("b"), P.NEAR)).collect():
        assert near == (exact if exact >= P.NEAR else 0.0)


def test_texts_of_other_lengths_are_not_aligned():
    a, b = "the control film " * 400, "a light hour of " * 300
    began = time.perf_counter()
    assert Y._near(a, b, P.NEAR) == 0.0
    assert time.perf_counter() - began < 0.05
