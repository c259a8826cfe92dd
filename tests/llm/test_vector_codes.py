"""Vector codes against a plain version that measures every entry in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from sievework.llm import vector_codes
from sievework.llm.vector_codes import VantageTree, compressed

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int, part string"


def plain(rows, entries=16, rounds=6):
    """(key, label, code, error, label_error, sha256) of (key, vector, label) rows."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = -(-max(len(r[1]) for r in kept) // 8) * 8
    step = width // 8
    whole = [[math.floor(x * 4096) if abs(x) < 2**40 else int(x) * 4096 for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    parts = [[w[m * step : (m + 1) * step] for m in range(8)] for w in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[list(parts[i][m]) for i in first] for m in range(8)]

    def nearest(m, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[m]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for m in range(8):
            at = [nearest(m, p[m])[1] for p in parts]
            for k in range(len(books[m])):
                own = [p[m] for p, a in zip(parts, at) if a == k]
                if own:
                    new[m][k] = [sum(c) // len(own) for c in zip(*own)]
        books = new
    found = [[nearest(m, p[m]) for m in range(8)] for p in parts]
    errors = [sum(d for d, _ in f) for f in found]
    errors = [e if e < 2**63 else None for e in errors]
    total = {}
    for r, e in zip(kept, errors):
        total.setdefault(r[2], []).append(e)
    summed = {k: None if None in v or sum(v) >= 2**63 else sum(v) for k, v in total.items()}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], r[2], "".join(f"{k:02x}" for _, k in f), e, summed[r[2]], digest) for r, f, e in zip(kept, found, errors)]


def check(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA).repartition(5)
    found = [tuple(r) for r in compressed(table, **options).collect()]
    assert sorted(found, key=repr) == sorted(plain(rows), key=repr)


def numbers(seed, n, width, span=1.0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, span), 3) for _ in range(width)], rng.choice([1, 2, 3, None])) for i in range(n)]


def test_against_brute_force(spark):
    rows = numbers(1, 300, 24)
    rows += [(400 + i, list(rows[i % 40][1]), 1) for i in range(200)]  # copies
    rows += [(None, [0.5] * 24, None), (None, [0.25] * 24, None), (7, [0.0] * 24, 2), (7, [-0.1] * 24, 2)]  # null and repeated keys
    rows += [(900, None, 1), (901, [math.nan] * 24, 1), (902, [None] + [0.0] * 23, 1), (903, [math.inf] * 24, 1), (-5, [-math.inf] * 24, 1)]
    check(spark, rows)


def test_ties_take_the_lower_index(spark):
    rng = random.Random(2)
    check(spark, [(i, [rng.choice([0.0, 1 / 4096, 2 / 4096]) for _ in range(8)], i % 2) for i in range(120)])


def test_hot_vector_and_unused_entries(spark):
    check(spark, [(i, [0.125] * 16, 0) for i in range(500)] + numbers(3, 5, 16))


def test_unlike_and_odd_lengths(spark):
    rows = numbers(4, 60, 11)
    check(spark, rows + [(100, [], None), (101, [1.0], 1), (102, [0.5] * 13, 1)])
    check(spark, [(1, [], None), (2, [], 3)])


def test_large_components_are_exact(spark):
    check(spark, numbers(5, 60, 8) + [(100, [1e30] * 8, 1), (101, [-1e18, 3.0] * 4, 2), (102, [1.7e308] * 8, None), (103, [2.0**40] * 8, 2)])
    check(spark, [(i, [1e300 + i * 1e299] * 8, i % 2) for i in range(40)])


def test_few_and_no_rows(spark):
    check(spark, numbers(6, 3, 8))
    check(spark, [])
    check(spark, [(1, None, 1), (2, [math.nan], 1)])


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 2)
    check(spark, numbers(7, 150, 16))


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("span", [2, 60, 5000, 1 << 26])
def test_tree_equals_brute_force(kind, span):
    rng = np.random.default_rng(span)
    for n in (1, 2, 5, 16, 40):
        entries, parts = rng.integers(-span, span, (n, 4)), rng.integers(-span, span, (300, 4))
        at, squares = VantageTree(entries.astype(kind)).nearest(parts.astype(kind))
        away = ((parts[:, None] - entries[None]) ** 2).sum(-1)
        assert (at == away.argmin(1)).all() and (squares == away.min(1)).all()


def test_tree_leaves_entries_out():
    rng = np.random.default_rng(0)
    entries = rng.integers(-4000, 4000, (64, 2))
    parts = entries[rng.integers(0, 64, 500)] + rng.integers(-20, 20, (500, 2))
    tree, measured = VantageTree(entries), []
    visit = tree._visit

    def counted(node, parts, rows, best, at):
        measured.append(len(rows) * len(node[0]))
        visit(node, parts, rows, best, at)

    tree._visit = counted
    tree.nearest(parts)
    assert sum(measured) < 0.5 * 500 * 64
