"""Fingerprints against a plain version, and every row's neighbour among null and large keys."""

import hashlib
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import syncmers as S

MASK = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_anchors(text):
    power = 0x9E3779B97F4A7C15
    inner = []
    for i in range(len(text) - S.INNER + 1):
        h = 0
        for c in text[i : i + S.INNER]:
            h = (h * power + ord(c)) & MASK
        inner.append(plain_mix(h))
    if len(text) < S.INNER:
        return [(int.from_bytes(hashlib.sha256(text.encode("utf-32-le")).digest()[:8], "little"), 0)] if text else []
    span, found = S.K - S.INNER, []
    for i in range(len(text) - S.K + 1):
        window = inner[i : i + span + 1]
        if min(window) in (window[0], window[-1]):
            middle = plain_mix((window[span // 2] + power) & MASK)
            found.append((plain_mix(((window[0] * power & MASK) ^ ((middle + window[-1]) & MASK)) & MASK), i))
    return found or [(h, i) for i, h in enumerate(inner)]


def plain_print(text):
    first = {}
    for h, p in plain_anchors(text):
        first.setdefault(h, p)
    return dict(sorted(first.items())[: max(S.KEPT, -(-len(first) // S.DENSITY))])


def plain_likeness(a, b):
    x, y = plain_print(a), plain_print(b)
    if not x or not y:
        return float(len(x) == len(y))
    union = sorted({*x, *y})[: max(S.KEPT, min(len(x), len(y)))]
    both = [h for h in union if h in x and h in y]
    if not both:
        return 0.0
    middle = statistics.median(x[h] - y[h] for h in both)
    return sum(abs(x[h] - y[h] - middle) <= S.SHIFT * max(len(a), len(b)) + S.K for h in both) / len(union)


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


letters = st.text(alphabet="ab é\U0001f600", max_size=120)


@settings(max_examples=150, deadline=None)
@given(letters, letters, letters)
def test_fingerprint_and_likeness(front, a, b):
    for text in (a, front + a):
        assert S.Fingerprint(points(text)).text() == "".join(f"{p:08x}{h:016x}" for h, p in plain_print(text).items())
    assert S.Fingerprint(points(front + a)).likeness(S.Fingerprint(points(a + b))) == plain_likeness(front + a, a + b)


def test_long_texts_keep_more():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghij "), 60_000))
    mine = S.Fingerprint(points(text))
    assert len(mine.hashes) > 2 * S.KEPT and mine.text() == "".join(f"{p:08x}{h:016x}" for h, p in plain_print(text).items())
    assert 0.9 < mine.likeness(S.Fingerprint(points(text[:58_000]))) < 1


@pytest.mark.parametrize("per", [1000, 60])
def test_null_and_large_keys(spark, per, monkeypatch):
    plain = S.splitters
    monkeypatch.setattr(S, "splitters", lambda docs, key, _: plain(docs, key, per))
    keys = [None] * 4 + [2**53 + i for i in range(2000)] + [-(2**63) + i for i in range(3)] + [2**63 - 1 - i for i in range(1000)] + list(range(-500, 501))
    rows = [(k, f"text number {i} " * (i % 5)) for i, k in enumerate(keys)]
    found = S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (k, t) in enumerate(ordered):
        after, cut = ordered[(i + 1) % len(ordered)][1], len(t) // 4
        want.append((str(k), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest(), plain_likeness(t, after)))
    assert sorted((str(r["doc_id"]), r["edited_sha256"], r["near_next"]) for r in found) == sorted(want)


def test_keys_that_are_no_integers(spark):
    with pytest.raises(TypeError):
        S.fingerprints(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_one_row_follows_itself(spark):
    (r,) = S.fingerprints(spark.createDataFrame([(None, "abcd efgh ijkl mnop")], "doc_id long, text string")).collect()
    assert r["near_next"] == 1.0 and r["doc_id"] is None
