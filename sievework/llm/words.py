"""Words and shingles of UTF-8 texts as 64-bit hashes, a block of texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once, at least; a longer text makes a block by itself.
BLOCK = 1 << 20
#: Longer words are hashed by BLAKE2: a polynomial modulo 2 ** 64 has known collisions from 1,024 letters on, for any base.
LONG = 255
#: A fixed odd base of the polynomial hash, and the seed of its table of byte values.
BASE, SEED = 0x9E3779B97F4A7C15, 20240229

_VALUES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i below n at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[bytes], least: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `least` bytes each."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= least:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's number of words.

    A to Z are lower-cased; words are runs of bytes other than ASCII white space.
    Different words share a hash with a probability of about 2 ** -64, so of V
    words some two do with one of about V ** 2 / 2 ** 65.
    """
    split = [t.lower().split() for t in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    joined = b" ".join(b" ".join(x) for x in split if x)
    if not joined:
        return np.empty(0, np.uint64), counts
    data = np.frombuffer(joined + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    up, down = _powers(len(data))
    sums = np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64)
    before = np.where(starts > 0, sums[np.maximum(starts - 1, 0)], np.uint64(0))
    out = mix((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out, counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words within each text, and each text's number of them.

    A text with words, but fewer than `size`, has its whole sequence as its one
    shingle; a text without words has none.
    """
    total = len(words)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    firsts = np.repeat(np.cumsum(counts) - counts - (np.cumsum(many) - many), many) + np.arange(many.sum())
    length = np.repeat(np.minimum(counts, size), many)
    out = np.zeros(len(firsts), np.uint64)
    for j in range(size):
        take = length > j
        out[take] = mix(out[take] * np.uint64(BASE) + words[np.minimum(firsts[take] + j, total - 1)] + np.uint64(j + 1))
    return out, many
