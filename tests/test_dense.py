"""Dense retrieval in blocks and slices, against all pairs in plain Python."""

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import dense as D


def score(q, v):
    if q is None or v is None or len(q) != len(v) or None in q or None in v:
        return None
    total = 0.0
    for x, y in zip(q, v, strict=True):
        total += x * y
    return total if not math.isfinite(total) else float(Decimal(repr(total)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) + 0.0


def order(s, i):
    return (s is None, not (s is not None and math.isnan(s)), -(s if s is not None and not math.isnan(s) else 0.0), i)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(np.float32(math.cos(i // 2 * k))) for k in range(1, 6)], None if i == 31 else i % 3) for i in range(90)]
    rows[4], rows[5], rows[9], rows[10], rows[12] = (4, None, 1), (5, [1.0, None, 0.0, 0.0, 0.0], 2), (9, [1.0], 0), (10, [float("nan")] * 5, 1), (12, [], 0)
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, lane int")


def test_blocks_and_slices_find_what_all_pairs_do(vectors):
    rows, df = vectors
    asked = df.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("q"), "embedding")
    found = D.dense_top(asked, df, "q", "vec_id", 7, block=10, most=13)
    got = {(r["q"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    for q in range(0, 90, 5):
        want = sorted(((i, score(rows[q][1], v)) for i, v, _ in rows), key=lambda x: order(x[1], x[0]))[:7]
        assert str([got[q, n + 1] for n in range(7)]) == str(want)
    assert len(got) == 18 * 7


def test_lanes_keep_their_means_over_slices(vectors):
    rows, df = vectors
    fine = df.filter("vec_id not in (4, 5, 9, 10, 12)")
    asked = fine.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    found = {(r["q"], r["lane"], r["lane_rank"]): (r["vec_id"], r["z"]) for r in D.lane_top(asked, fine, "q", "lane", "vec_id", 4, block=25, most=11).collect()}
    for q in range(0, 90, 20):
        for lane in range(3):
            own = [(i, score(rows[q][1], v)) for i, v, at in rows if at == lane and i not in (4, 5, 9, 10, 12)]
            mean, std = np.mean([s for _, s in own]), max(np.std([s for _, s in own]), 1e-6)
            for n, (i, s) in enumerate(sorted(own, key=lambda x: order(x[1], x[0]))[:4]):
                assert found[q, lane, n + 1][0] == i
                assert found[q, lane, n + 1][1] == pytest.approx((s - mean) / std, abs=2e-9)
    assert len(found) == 5 * 3 * 4


def test_pairs_leave_their_group_as_its_best_hits_only(vectors):
    _, df = vectors
    parts = D.dense_parts(df.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("q"), "embedding"), df, "q", "vec_id", 2, most=45)
    assert parts.count() <= 18 * 2 * 2


def test_halves_go_away_from_zero_as_in_spark(spark):
    given = [0.0000000005, -0.0000000005, 1.0000000025, 0.1234567895, -2.5000000015, 1e-12, -1e-12, 123456.7890123455, 5e6 + 0.25, math.inf]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x double").select(F.round("x", 9)).collect()]
    assert D.nine_decimals(np.array([given]))[0].tolist() == want
