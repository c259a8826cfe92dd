"""The quality network against a plain forward pass, and its score as a function of the text alone."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import quality as Q


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    return Q.Network(rng.normal(0, 1, (Q.WIDTH, 256, Q.FILTERS)).astype(np.float32), rng.normal(0, 1, (Q.LEVELS, Q.FILTERS)).astype(np.float32), rng.normal(0, 1, Q.FILTERS).astype(np.float32), rng.normal(0, 1, Q.FILTERS).astype(np.float32), 0.3)


def plain_levels(data):
    ends = [any(i - lag >= 3 and data[i - 3 : i + 1] == data[i - 3 - lag : i + 1 - lag] for lag in range(3, 21)) for i in range(len(data))]
    return [min(sum(ends[max(0, i - 23) : i + 1]) * Q.LEVELS // 25, Q.LEVELS - 1) for i in range(len(data))]


def plain_score(net, text):
    body = text or bytes([Q.PAD])
    data = body + bytes([Q.PAD]) * Q.WIDTH
    level = plain_levels(data)
    logits = []
    for first in range(0, max(1, len(body) - (Q.CHUNK - Q.STRIDE)), Q.STRIDE):
        total = net.bias
        for f in range(Q.FILTERS):
            best = max(net.levels[level[p + Q.WIDTH - 1], f] + net.offset[f] + sum(net.bytes_[j][data[p + j], f] for j in range(Q.WIDTH)) for p in range(first, min(first + Q.CHUNK, len(body))))
            total += max(best, 0) * net.out[f]
        logits.append(total)
    return 1 / (1 + np.exp(max(logits)))


TEXTS = [b"", b"a", b"ab" * 5, b"the quick brown fox " * 40, b"aaaaaaa" * 90, bytes(range(256)) * 3, b"one two three " * 3]


def test_forward_pass(net):
    assert net.good(TEXTS) == pytest.approx([plain_score(net, t) for t in TEXTS], abs=1e-5)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(TEXTS) | st.binary(max_size=60), min_size=1, max_size=12))
def test_score_depends_on_the_text_alone(net, texts):
    found = net.good(texts)
    assert found.tolist() == [net.good([t])[0] for t in texts] and found[::-1].tolist() == net.good(texts[::-1]).tolist()


def test_any_partitioning_gives_the_same(spark):
    rows = [(i, ("plain words here " if i % 3 else "### $$ ### ") * (i % 17)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(2, 0), (4, 5)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] for r in Q.scored(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(7).orderBy("text").repartition(3)))
    assert one == many


def test_bound_on_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert np.all(Q.trained(docs, labels, most=10).out == 0)
    assert not np.all(Q.trained(docs, labels).out == 0)
