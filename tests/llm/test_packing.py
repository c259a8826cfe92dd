"""Every piece goes to the sequence of lowest cost of all that have room."""

import collections

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import packing


def plain(lengths, capacity, linear, quadratic):
    rest, out, opened = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, opened, 0))
            opened += 1
        if n % capacity:
            rest.append([n % capacity, d, n - n % capacity])
    total = sum(r[0] for r in rest)
    sizes = [capacity] * (total // capacity)
    bit = capacity
    while bit:
        if total % capacity & bit:
            sizes.append(bit)
        bit //= 2
    used, cost = [0] * len(sizes), [0.0] * len(sizes)
    while rest:
        rest.sort(key=lambda r: (-r[0], r[1], r[2]))
        n, d, start = rest.pop(0)
        with_room = [s for s in range(len(sizes)) if sizes[s] - used[s] >= n]
        s = min(with_room, key=lambda s: (cost[s], s)) if with_room else max(range(len(sizes)), key=lambda s: (sizes[s] - used[s], -s))
        k = min(n, sizes[s] - used[s])
        out.append((d, start, k, opened + s, used[s]))
        used[s] += k
        cost[s] += linear * k + quadratic * k * k
        if k < n:
            rest.append([n - k, d, start + k])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_assignment(lengths):
    assert packing.assign(lengths, 64, 1.0, 0.5) == plain(lengths, 64, 1.0, 0.5)


def test_only_what_fits_nowhere_is_cut():
    lengths = np.random.default_rng(1).integers(1, 4096, 3000).tolist()
    cut = collections.Counter(r[0] for r in packing.assign(lengths, 4096, 1.0, 1 / 4096))
    assert sum(n > 1 for n in cut.values()) < 0.4 * len(lengths)
