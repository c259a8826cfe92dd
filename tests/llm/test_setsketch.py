"""Estimates, what they rule out, and recall of links, against full sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import setsketch as S
from sievework.llm import words
from tests.llm.test_operators import brute_components


def sketches_of(sets):
    return np.stack([S.registers(S.minima(words.mix(np.array(sorted(s), np.uint64)), np.array([0])))[:, 0] for s in sets])


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.8, 0.85])
def test_error_of_the_estimate(similarity):
    rng = np.random.default_rng(int(similarity * 100))
    size = 400
    shared = round(2 * size * similarity / (1 + similarity))
    pools = [rng.choice(1 << 40, 2 * size - shared, replace=False) for _ in range(150)]
    a, b = [p[:size] for p in pools], [p[size - shared :] for p in pools]
    found = S.likelihood_estimates(sketches_of(a), sketches_of(b), np.full(150, size), np.full(150, size))
    error = found - shared / (2 * size - shared)
    assert np.abs(error).max() < S.margin(similarity) and abs(error.mean()) < 0.01 and error.std() < 1.3 * S.margin(similarity) / 5


def test_recall_at_the_threshold(spark):
    """Pairs of texts just at 0.85, each in a table of its own words: all links are found."""
    rows = []
    for f in range(300):
        base = [f"f{f}w{i}" for i in range(202)]
        near = [*base[:186], *[f"f{f}x{i}" for i in range(16)]]  # 184 of 216 shingles of three words
        rows += [(2 * f, " ".join(base)), (2 * f + 1, " ".join(near))]
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert found.filter("kept").count() == 300


def bucket(rng, centers, each, edits):
    """Texts of one vocabulary in clusters: within one they are near, between clusters far, though all share much."""
    common = [f"c{i}" for i in range(150)]
    rows = []
    for c in range(centers):
        own = [f"o{c}x{i}" for i in range(45)]
        for _ in range(each):
            text = [*common, *own]
            for at in rng.integers(150, 195, edits):
                text[at] = f"e{int(rng.integers(0, 10**9))}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(("centers", "each", "edits"), [(12, 6, 3), (25, 3, 6), (40, 2, 1)])
def test_groups_with_far_rows(spark, centers, each, edits):
    rows = bucket(np.random.default_rng(centers), centers, each, edits)
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert [found[k] for k, _ in rows] == brute_components(rows, 3, 85)[1]


def test_pruning_loses_no_link(spark, monkeypatch):
    """With bands that all rows share, one pivot meets everything: far rows get a second pivot and keep their links."""
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):
        base = [f"b{c}w{i}" for i in range(80)]
        for _ in range(4):
            text = list(base)
            for at in rng.integers(0, 80, 2):
                text[at] = f"e{int(rng.integers(0, 10**9))}"
            rows.append((len(rows), " ".join(text)))
    seen = {}
    plain = S.pruned

    def watched(pairs, sketches, percent):
        every = sketches.select(F.lit(0).cast("long").alias("a"), F.col("row").alias("b"))
        least = every.agg(F.min("b")).first()[0]
        pairs = every.withColumn("a", F.lit(least).cast("long")).filter(F.col("b") != least)
        kept = plain(pairs, sketches, percent)
        seen.update(before=pairs.count(), first=kept.filter(F.col("a") == least).count())
        return kept

    monkeypatch.setattr(S, "pruned", watched)
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert seen["before"] == 119 and seen["first"] <= 3
    assert [found[k] for k, _ in rows] == brute_components(rows, 3, 85)[1]


def test_blocks_in_bytes(spark):
    rows = bucket(np.random.default_rng(3), 10, 5, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 85)[1]
    plain = S.remaining
    S.remaining = lambda seen, found, percent: plain(seen, found, percent, block=3, most=500)
    try:
        found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs, 3, 85).collect()}
    finally:
        S.remaining = plain
    assert [found[k] for k, _ in rows] == want


def test_pairs_meet_their_pivot_three_times_at_most(spark, monkeypatch):
    """Once for the estimates, once for the second pivot, once for the outer rows: each is a join of all pairs."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):  # one group of near copies, some of which are not linked with the least one
        words = list(base)
        for k in rng.choice(60, int(rng.integers(0, 11)), replace=False):
            words[k] = f"x{i}-{k}"
        texts.append((i, " ".join(words)))
    met, whole = [], S.with_pivot
    monkeypatch.setattr(S, "with_pivot", lambda pairs, pivots, *how: met.append(pairs.count()) or whole(pairs, pivots, *how))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs, 2, 80).collect()}
    assert len(met) == 3

    sets = [{tuple(t.split()[i : i + 2]) for i in range(59)} for _, t in texts]
    want = list(range(120))
    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert found == dict(enumerate(want))
