"""Language-model scoring by a probabilistic suffix tree over words and the bytes that spell them.

Contexts are of two kinds. Runs of up to `depth` bytes before a byte are few; the
most diverging are sent to the workers. Whole words before a word are as many as
the corpus has, the frequent ones too; they are met by a shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievework.llm.words import BLOCK, blocks, hashed_words, mix
from sievework.llm.work import column, scratch, table, text_bytes

#: Stands before a text's first byte in contexts; no UTF-8 text holds it. SPACE ends a word.
FRONT, SPACE = 0xFF, 0x20
#: Bytes that lower-cased words and their ends are made of: not A to Z, other white space, or what UTF-8 never has.
BYTES = bytes(b for b in range(0xF5) if not (0x41 <= b <= 0x5A or 0x09 <= b <= 0x0D or b in (0xC0, 0xC1)))
#: What one task holds of counts before it hands them on.
HELD = 3_000_000
#: Words seen less often are not sent to the workers. Words of training texts for one part of the words after words.
SENT, PART = 4, 2_000_000
#: Steps of a word's log10 in 1.
STEPS = 1 << 16
#: Bytes of text hashed and spelled at once: they stay in the processor's cache.
PIECE = 1 << 18
WORD, GRAM, END = 0, 1, 2


def fold(key: object, of: int = 5) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % of


def byte_stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words, each ended by one space, with `depth` FRONT bytes before each text; and which bytes are words'."""
    front = bytes([FRONT]) * depth
    data = np.frombuffer(front + b"".join(front + b" ".join(x) + b" " if (x := t.lower().split()) else b"" for t in texts), np.uint8)
    return data, data != FRONT


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


class Counter:
    """Counts of 64-bit keys in sorted arrays, merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            u, n = np.unique(keys, return_counts=True)
            self.parts.append((u, n))
            self.size += len(u)

    def full(self) -> bool:
        if self.size > HELD:
            self.parts = [merged(self.parts)]
            self.size = len(self.parts[0][0])
        return self.size > HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merged(self.parts) if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.size = [], 0
        return out


def corpus_counts(docs: DataFrame, key: str, text: str, depth: int, trained: Callable[[object], bool]) -> DataFrame:
    """Over all training texts: how often each word, and each run of depth + 1 bytes, occurs.

    Columns kind (WORD, GRAM or END), key and n. A word's key is its hash; a
    run's key is its bytes, the last lowest. The row of kind END counts the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {WORD: Counter(), GRAM: Counter()}
        texts_seen = 0

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = held[kind].take()
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            texts = [t for k, t in zip(column(batch, key).to_pylist(), text_bytes(column(batch, text)), strict=True) if trained(k)]
            texts_seen += len(texts)
            for i, j in blocks(texts):
                held[WORD].add(hashed_words(texts[i:j])[0])
                data, real = byte_stream(texts[i:j], depth)
                grams = np.zeros(max(0, len(data) - depth), np.uint64)
                for d in range(depth + 1 if len(grams) else 0):
                    grams = grams << np.uint64(8) | data[d : len(data) - depth + d]
                held[GRAM].add(grams[real[depth:]])
                for kind, counter in held.items():
                    if counter.full():
                        yield from out(kind)
        for kind in held:
            yield from out(kind)
        if texts_seen:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.int32()), pa.array([0], pa.int64()), pa.array([texts_seen], pa.int64())], names=["kind", "key", "n"])

    return docs.select(key, text).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """A suffix tree as an automaton: a state for each retained context, the root first."""

    depth: int
    symbols: np.ndarray  # byte -> symbol
    following: np.ndarray  # (state, symbol) -> state
    logp: np.ndarray  # (state, symbol) -> log10 of the probability

    def score(self, data: np.ndarray) -> np.ndarray:
        """log10 P of each byte after the first `depth`, given the bytes before it.

        The longest retained suffix depends on the last `depth` bytes alone, so
        stretches are scored side by side, each started `depth` bytes early.
        """
        total = len(data) - self.depth
        width = 256
        rows = max(1, -(-total // width))
        padded = np.zeros(rows * width + self.depth, np.int32)
        padded[: len(data)] = self.symbols[data]
        seen = np.lib.stride_tricks.as_strided(padded, (rows, width + self.depth), (padded.strides[0] * width, padded.strides[0]))
        across = np.ascontiguousarray(seen.T)
        n = self.logp.shape[1]
        follow, logp = self.following.ravel(), self.logp.ravel()
        state, out = np.zeros(rows, np.int32), np.empty((width, rows), np.float32)
        for t in range(width + self.depth):
            at = state * np.int32(n) + across[t]
            if t >= self.depth:
                np.take(logp, at, out=out[t - self.depth])
            state = follow[at]
        return out.T.ravel()[:total]


def grow(counts: dict[int, tuple[np.ndarray, np.ndarray]], depth: int, least: float, states: int, alphabet: bytes = BYTES) -> Tree:
    """The tree from counts[d]: keys of d + 1 bytes (a context of d, then the next byte) and how often.

    Contexts seen `least` times are candidates. One is retained if its next
    bytes diverge from its suffix's: their log likelihood ratio must exceed half
    its free parameters times the log of its count. With it go its suffixes and
    prefixes, so the longest retained suffix can be followed byte by byte. At
    most about `states` of the most diverging are retained, which bounds what is
    sent to the workers. Next-byte distributions are smoothed towards the suffix's
    by the number of distinct next bytes.

    Each state's probabilities of the bytes of `alphabet` (and others seen) sum
    to one. A word has a byte, so where one begins, after SPACE or FRONT, SPACE
    has none; these two contexts are always there. So the probabilities of all
    words, each ended by SPACE, sum to one.
    """
    ends = np.unique(np.concatenate([k & np.uint64(255) for k, _ in counts.values()] + [np.array([SPACE], np.uint64)])).astype(np.int64)
    seen = np.union1d(ends, [FRONT])
    width = len(seen) + 1  # the last symbol is any other byte
    symbols = np.full(256, width - 1, np.int32)
    symbols[seen] = np.arange(len(seen))
    space = symbols[SPACE]
    root = np.zeros(width)
    k, n = counts.get(0, (np.empty(0, np.uint64), np.empty(0, np.int64)))
    root[symbols[k.astype(np.int64)]] = n
    others = len(set(alphabet) - set(ends.tolist()))
    smooth = np.zeros(width)
    smooth[symbols[ends]] = 0.5
    smooth[-1] = 0.5 * others
    start = (root + smooth) / (root.sum() + smooth.sum())
    levels = [{"keys": np.zeros(1, np.uint64), "p": start[None, :], "gain": np.zeros(1), "up": np.zeros(1, int)}]
    totals = (k, n)
    for d in range(1, depth + 1):
        k, n = counts.get(d, (np.empty(0, np.uint64), np.empty(0, np.int64)))
        at = np.searchsorted(totals[0], k >> np.uint64(8))
        at = np.minimum(at, max(0, len(totals[0]) - 1))
        total = np.where(totals[0][at] == k >> np.uint64(8), totals[1][at], 0) if len(totals[0]) else np.zeros(len(k))
        of = k >> np.uint64(8)
        before = np.unique(of, return_inverse=True)[1]
        total = np.maximum(total, np.bincount(before, weights=n)[before] if len(k) else 0)
        forced = [] if d > 1 else [SPACE, FRONT]
        ok = (total >= least) | np.isin(of, np.array(forced, np.uint64))
        keys = np.union1d(of[ok], np.array(forced, np.uint64))
        index = np.searchsorted(keys, of[ok])
        whole = np.zeros(len(keys))
        whole[index] = total[ok]
        suffix = keys & np.uint64((1 << 8 * (d - 1)) - 1)
        prev = levels[-1]["keys"]
        up = np.minimum(np.searchsorted(prev, suffix), len(prev) - 1)
        mass = np.zeros((len(keys), width))
        mass[index, symbols[(k[ok] & np.uint64(255)).astype(np.int64)]] = n[ok]
        good = prev[up] == suffix
        keys, up, mass, whole = keys[good], up[good], mass[good], whole[good]
        parent = levels[-1]["p"][up]
        if d == 1:
            begins = np.flatnonzero(np.isin(keys, np.array(forced, np.uint64)))
            parent[begins, space] = 0
            parent[begins] /= np.maximum(parent[begins].sum(1), 1e-300)[:, None]
        kinds = (mass > 0).sum(1)
        whole = np.maximum(whole, mass.sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(mass > 0, mass * np.log(mass / whole[:, None] / parent), 0.0).sum(1)
        gain = ratio - 0.5 * kinds * np.log(np.maximum(whole, 2))
        rest = np.maximum(whole - mass.sum(1) + kinds, 1)[:, None]
        levels.append({"keys": keys, "p": (mass + rest * parent) / (mass.sum(1)[:, None] + rest), "gain": gain, "up": up})
        totals = (k, n)
    gains = np.concatenate([x["gain"] for x in levels[1:]]) if depth else np.zeros(0)
    bar = max(0.0, np.partition(gains, -states)[-states]) if len(gains) > states else 0.0
    keep = [x["gain"] > bar for x in levels]
    keep[0][:] = True
    if depth:
        keep[1] |= np.isin(levels[1]["keys"], np.array([SPACE, FRONT], np.uint64))
    for d in range(depth, 1, -1):
        mine = levels[d]["keys"][keep[d]]
        keep[d - 1][levels[d]["up"][keep[d]]] = True
        front = mine >> np.uint64(8)
        at = np.minimum(np.searchsorted(levels[d - 1]["keys"], front), len(levels[d - 1]["keys"]) - 1) if len(levels[d - 1]["keys"]) else np.zeros(len(front), int)
        there = levels[d - 1]["keys"][at] == front if len(front) else np.zeros(0, bool)
        keep[d - 1][at[there]] = True
        keep[d][np.flatnonzero(keep[d])[~there]] = False
    number = []
    count = 0
    for d in range(depth + 1):
        number.append(np.where(keep[d], np.cumsum(keep[d]) - 1 + count, -1))
        count += int(keep[d].sum())
    following, p = np.zeros((count, width), np.int32), np.zeros((count, width))
    for d in range(depth + 1):
        mine = number[d][keep[d]]
        p[mine] = levels[d]["p"][keep[d]]
        if d:
            following[mine] = following[number[d - 1][levels[d]["up"][keep[d]]]]
        if d < depth and keep[d + 1].any():
            longer = levels[d + 1]["keys"][keep[d + 1]]
            front = np.searchsorted(levels[d]["keys"], longer >> np.uint64(8))
            following[number[d][front], symbols[(longer & np.uint64(255)).astype(np.int64)]] = number[d + 1][keep[d + 1]]
    p[:, -1] /= others or 1
    with np.errstate(divide="ignore"):
        return Tree(depth, symbols, following, np.log10(p).astype(np.float32))


def gathered(counts: DataFrame, depth: int, share: float, states: int) -> Tree:
    """The tree of the counts of a corpus.

    Contexts as frequent as `share` of all bytes are candidates, so there are
    at most 1 / share of each length, and at most 16 / share of the runs that
    come to the driver: those at least a sixteenth as frequent as a candidate.
    The mass of rarer runs goes to the suffix's distribution.
    """
    grams = counts.filter(F.col("kind") == GRAM)
    total = grams.agg(F.sum("n")).first()[0] or 0
    least = max(2.0, share * total)
    floor = max(1.0, least / 16)
    mask = lambda d: F.lit((1 << 8 * (d + 1)) - 1)
    levels = F.array(*[F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(mask(d)).alias("key")) for d in range(depth)])
    with scratch(counts.sparkSession):
        shorter = table(grams.groupBy(F.col("key").bitwiseAND(mask(depth - 1)).alias("key")).agg(F.sum("n").alias("n")), "suffix-counts")
        below = shorter.select(F.explode(levels).alias("x"), "n").groupBy("x.d", "x.key").agg(F.sum("n").alias("n"))
        runs = below.unionByName(grams.select(F.lit(depth).alias("d"), "key", "n")).filter(F.col("n") >= floor).toArrow()
    d, key, n = (runs.column(i).to_numpy() for i in range(3))
    found = {}
    for i in range(depth + 1):
        order = np.argsort(key[d == i])
        found[i] = (key[d == i][order].astype(np.uint64), n[d == i][order])
    return grow(found, depth, least, states)


@dataclass
class Model:
    """What workers score words by: the tree, the words sent to them, and shares."""

    tree: Tree
    keys: np.ndarray  # hashes of the words sent, ascending
    n: np.ndarray  # how often each is in training texts
    barred: int  # words sent and seen this often are no contexts
    heavy: int  # the words after one seen this often are dealt over the parts
    parts: int
    scale: float
    among: float
    end_share: float
    ends: int
    unigram: float

    @property
    def share(self) -> float:
        return 1 - self.end_share

    @property
    def log_novel(self) -> float:
        return math.log10(self.share * (self.unigram * 0.5 / self.among + 1 - self.unigram))

    def plain(self, known: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of a word's probability without a word before, known so often and spelled so."""
        told = np.where(known > 0, math.log(self.share * self.unigram / self.among) + np.log(known + 0.5), -np.inf)
        return np.logaddexp(told, (self.log_novel + spelled) * math.log(10)) / math.log(10)

    def sent(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words were sent, and each one's place among them, else its hash."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), hashes
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return hit, np.where(hit, at, hashes)

    def often(self, codes: np.ndarray, hit: np.ndarray) -> np.ndarray:
        return np.where(hit, self.n[np.where(hit, codes, 0)], 0) if len(self.n) else np.zeros(len(codes), np.int64)


#: The columns of what is dealt over the parts: of words after words, packed, and of sums of a text.
DEALT = "__part int, __size int, __texts int, __packed binary"
SUMS = "__id long, __found long, __base double, __model double"


def differences(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each number less the one before, but those that are `first` as they are."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return out


def summed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The numbers of these differences()."""
    total, at = np.cumsum(x), np.flatnonzero(first)
    return total - np.repeat(total[at] - x[at], np.diff(np.append(at, len(x))))


def changes(x: np.ndarray) -> np.ndarray:
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.empty(0, bool)


def small(codes: np.ndarray, least: int) -> np.ndarray:
    """Words as small numbers: those below `least` as they are, the hashes of others by their rank."""
    others = (codes < 0) | (codes >= least)
    out = codes.copy()
    out[others] = least + np.unique(codes[others], return_inverse=True)[1]
    return out


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order by these numbers, none of them negative."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    whole = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits, strict=True):
        whole = whole << b | k
    return np.argsort(whole)


def packed(model: Model, prev: np.ndarray, word: np.ndarray, plain: np.ndarray, text: np.ndarray, ids: np.ndarray, learned: np.ndarray, known: np.ndarray | None = None) -> Iterator[dict[str, list]]:
    """Words after words of some texts, packed for each part: in order, equal ones of a text once.

    All after a word go to one part, unless it is heavy: then each pair has its own.
    `plain` is kept in steps of 2 ** -16, so a word's log10 is exact to 8e-6. Numbers
    are kept as differences, their lowest bytes first, which compress well. `known`
    is given for words whose count is still to be told to their text; -1: it is told.
    """
    part = (dealing(model, prev, word) % np.uint64(model.parts)).astype(np.int64)
    known = np.full(len(prev), -1) if known is None else known
    order = ordered(part, small(prev, len(model.n)), small(word, len(model.n)), text)
    columns = [x[order] for x in (part, prev, word, text.astype(np.int64), np.rint(plain * STEPS).astype(np.int64), known)]
    first = np.flatnonzero(np.any([changes(x) for x in columns], axis=0))
    times = np.diff(np.append(first, len(order)))
    part, prev, word, text, plain, known = (x[first] for x in columns)
    codec = pa.Codec("zstd")
    bounds = np.append(np.flatnonzero(changes(part)), len(part))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        used, at = np.unique(text[i:j], return_inverse=True)
        before = changes(prev[i:j])
        pair = before | changes(word[i:j])
        arrays = [np.diff(prev[i:j], prepend=0), differences(word[i:j], before), differences(plain[i:j], pair), differences(at, pair), times[i:j], known[i:j], ids[used], learned[used].astype(np.int64)]
        raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays)
        yield {"__part": [int(part[i])], "__size": [int(j - i)], "__texts": [len(used)], "__packed": [codec.compress(raw, asbytes=True)]}


def dealing(model: Model, prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What deals words after words: a hash of the word before; of the pair, if that word is heavy."""
    spread = (prev >= 0) & (prev < len(model.n))
    spread[spread] = model.n[prev[spread]] >= model.heavy
    key = mix(prev.view(np.uint64) + np.uint64(1))
    return np.where(spread, mix(key + word.view(np.uint64)), key)


def unpacked(size: int, texts: int, data: bytes) -> list[np.ndarray]:
    """The columns of packed(): prev, word, plain, text, times, known; then the texts' ids and which are learned."""
    sizes = [size] * 6 + [texts] * 2
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=8 * sum(sizes), asbytes=True), np.uint8)
    prev, word, plain, text, times, known, ids, learned = (np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).ravel() for x in np.split(raw, 8 * np.cumsum(sizes)[:-1]))
    prev = np.cumsum(prev)
    before = changes(prev)
    word = summed(word, before)
    pair = before | changes(word)
    return [prev, word, (summed(plain, pair) / STEPS).astype(np.float32), summed(text, pair).astype(np.int32), times.astype(np.int32), known.astype(np.int32), ids, learned.astype(np.int8)]


def contexts(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The words after words of one part, by pair, and of each word before the sums that tell if it is retained; some words before at a time."""
    found = [unpacked(*x) for batch in batches for x in zip(*(column(batch, c).to_pylist() for c in ("__size", "__texts", "__packed")), strict=True) if x[0] is not None]
    if not found:
        return
    shift = np.cumsum([0] + [len(x[6]) for x in found[:-1]])
    whole = [np.concatenate([x.pop(0) + np.int32(shift[i]) if c == 3 else x.pop(0) for i, x in enumerate(found)]) for c in range(8)]
    pieces = -(-len(whole[0]) // (PART // 4))
    of = (dealing(model, whole[0], whole[1]) // np.uint64(model.parts) % np.uint64(pieces)).astype(np.int32)
    for piece in range(pieces):
        mine = np.flatnonzero(of == piece)
        if len(mine):
            yield by_pair(model, *[x[mine] for x in whole[:6]], *whole[6:])


def by_pair(model: Model, prev: np.ndarray, word: np.ndarray, plain: np.ndarray, text: np.ndarray, times: np.ndarray, known: np.ndarray, ids: np.ndarray, learned: np.ndarray) -> dict[str, np.ndarray]:
    order = ordered(small(prev, len(model.n)), small(word, len(model.n)))
    prev, word, plain, text, times, known = prev[order], word[order], plain[order].astype(np.float64), text[order], times[order], known[order]
    counted = times * learned[text]
    before = changes(prev)
    pairs = np.flatnonzero(before | changes(word))
    n = np.add.reduceat(counted, pairs).astype(np.float64)
    begins = np.flatnonzero(before)
    first = np.searchsorted(pairs, begins)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.add.reduceat(np.where(n > 0, n * np.log(n * model.share), 0.0), first)
    return {
        "prev": prev[begins], "t": np.add.reduceat(n, first), "k": np.add.reduceat((n > 0).astype(np.float64), first),
        "ratio": whole - np.add.reduceat(counted * plain, begins) * math.log(10),
        "n": np.repeat(n, np.diff(np.append(pairs, len(prev)))), "of": np.cumsum(before) - 1, "plain": plain, "id": ids[text], "times": times, "known": known,
    }


def suffix_tree_scores(
    docs: DataFrame,
    trained: Callable[[object], bool],
    depth: int = 5,
    share: float = 1.5e-6,
    states: int = 100_000,
    unigram: float = 0.4,
    common: float = 1e-7,
    often: int | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """log10 P of every whole text, learned from the texts whose key is `trained`.

    A text is its words (A to Z lower-cased), then one end. The end's probability
    is (e + 0.5) / (N + 1), e of the N training tokens being ends; words share the
    rest. Without a word context, a word's probability is `unigram` times its
    relative frequency among words (add 0.5, over the words known and an unknown
    one) and 1 - `unigram` times that of its spelling; the unknown word's share is
    spelled too. A spelling is bytes and a space, each given the longest context
    of up to `depth` bytes that a probabilistic suffix tree retains (grow()), also
    over words.

    A word before is a context of the words after it in training texts: n of
    word w, t in all, k different ones. It is retained if t is at least 2 and the
    log likelihood ratio of n / t against the probabilities without it exceeds
    k / 2 * log(t). In it a word has (n + k * P) / (t + k) of the words' share, P
    being its share without it. Every word is a context, the most frequent too,
    unless `often` bars words seen that often and of a share of `common`. So the
    probabilities of all next tokens sum to one, and those of all texts to one.

    All words, byte runs and words after words of all training texts are counted.
    Counts of words of a share of at least `common` are sent to the workers, at
    most 1 / `common`, with the byte contexts, which `share` and `states` bound;
    those of all others are joined by a shuffle. Words after words are packed and
    dealt once, by the word before; those after a word too frequent for one part
    by pair, and the sums that tell if such a word is retained, of at most eight
    words a part, are taken before and sent. A word is known by a hash of 64 bits
    (words.hashed_words()), and so is a row, by its key and text.

    Columns: the key, held_out (not trained), n_tokens (with the end), n_known,
    train_tokens, base_score (relative frequencies alone) and score. A null or
    empty text is one end. A null key counts as "" to fold(). Repeated keys stay
    rows of their own. Without training texts all words are equally unknown.
    """
    spark = docs.sparkSession
    counts = table(corpus_counts(docs, key, text, depth, trained), "corpus-counts")
    words = counts.filter(F.col("kind") == WORD)
    in_words, distinct = words.agg(F.sum("n"), F.count("*")).first()
    ends = counts.filter(F.col("kind") == END).agg(F.sum("n")).first()[0] or 0
    in_words = in_words or 0
    total = in_words + ends
    scale = total + 0.5 * (distinct + (ends > 0) + 1)
    least = max(SENT if often is None else min(often, SENT), common * in_words)
    top = words.filter(F.col("n") >= least).toArrow()
    order = np.argsort(top_keys := top.column("key").to_numpy())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-in_words // PART))
    model = Model(
        tree=gathered(counts, depth, share, states), keys=top_keys[order], n=top.column("n").to_numpy()[order], barred=np.iinfo(np.int64).max if often is None else max(often, math.ceil(common * in_words)),
        heavy=max(2, in_words // (8 * parts)), parts=parts, scale=scale, among=in_words + 0.5 * (distinct + 1), end_share=(ends + 0.5) / (total + 1), ends=ends, unigram=unigram,
    )
    sent = spark.sparkContext.broadcast(model)
    of_text = f"{SUMS}, {DEALT}"
    whole = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("__tokens", T.LongType())])

    asked = T._parse_datatype_string(f"__id long, __learned boolean, __prev long, __word long, __spelled float, {DEALT}")
    schema = T.StructType(whole.fields + T._parse_datatype_string(of_text).fields)

    def scan(batches: Iterator[pa.RecordBatch], rare: bool) -> Iterator[pa.RecordBatch]:
        """Of each block of texts: sums of the texts and words that were sent, packed; or the `rare` ones that were not, and what follows heavy words in training texts, packed."""
        model, tree = sent.value, sent.value.tree
        for batch in batches:
            keys, texts = column(batch, key), text_bytes(column(batch, text))
            named = keys.to_pylist()
            taught = np.array([trained(k) for k in named], dtype=bool)
            for i, j in blocks(texts, 2 * BLOCK):
                pieces = [(i + a, i + b) for a, b in blocks(texts[i:j], PIECE)]
                hashes, n = (np.concatenate(x) for x in zip(*[hashed_words(texts[a:b]) for a, b in pieces], strict=True))
                ids = np.array([int.from_bytes(hashlib.blake2b(repr(k).encode() + b"\0" + t, digest_size=8).digest(), "little", signed=True) for k, t in zip(named[i:j], texts[i:j], strict=True)], np.int64)
                learned = taught[i:j]
                hit, codes = model.sent(hashes.view(np.int64))
                many = model.often(codes, hit)
                of = np.repeat(np.arange(j - i), n)
                prev, after = np.roll(codes, 1), np.zeros(len(codes), bool)
                after[1:] = (of[1:] == of[:-1]) & ~(hit[:-1] & (many[:-1] >= model.barred))
                told = hit
                if rare:
                    told = hit & after & learned[of]
                    told[1:] &= hit[:-1] & (many[:-1] >= model.heavy)
                wanted = told | ~hit if rare else told
                ends = np.cumsum(n)
                spelled = np.concatenate([spellings(tree, texts[a:b], wanted[ends[a - i] - n[a - i] : ends[b - i - 1]]) for a, b in pieces])
                x = np.flatnonzero(told & after)
                plain = model.plain(many[x], spelled[x])
                if rare:
                    for row in packed(model, prev[x], codes[x], plain, np.zeros(len(x), int), np.zeros(1, np.int64), np.ones(1, bool)):
                        yield filled(row, 1, asked)
                    r = np.flatnonzero(~hit)
                    for a in range(0, len(r), 100_000):
                        x = r[a : a + 100_000]
                        yield filled({"__id": ids[of[x]], "__learned": learned[of[x]], "__prev": pa.array(prev[x], mask=~after[x]), "__word": codes[x], "__spelled": spelled[x].astype(np.float32)}, len(x), asked)
                    continue
                for row in packed(model, prev[x], codes[x], plain, of[x], ids, learned):
                    yield filled(row, 1, schema)
                add = lambda at, x, of=of, m=j - i: np.bincount(of[at], weights=x, minlength=m)
                at, first = np.flatnonzero(hit), np.flatnonzero(hit & ~after)
                yield filled(
                    {
                        key: keys.slice(i, j - i), "held_out": ~learned, "__tokens": n + 1, "__id": ids, "__found": add(at, np.ones(len(at))).astype(np.int64) + (model.ends > 0), "__base": add(at, np.log10((many[at] + 0.5) / model.scale)) + math.log10((model.ends + 0.5) / model.scale),
                        "__model": add(first, model.plain(many[first], spelled[first])) + math.log10(model.end_share), "__part": (ids % model.parts).astype(np.int32),
                    }, j - i, schema,
                )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that were not sent, with their counts, as sums of texts and packed words."""
        model = sent.value
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if not held or batch is not None and sum(x.num_rows for x in held) < HELD // 6:
                continue
            rows, learned, prev, word, spelled, known = (pa.concat_arrays([x.column(c) for x in held]) for c in range(6))
            held = []
            ids, at = np.unique(rows.to_numpy(), return_inverse=True)
            taught = np.zeros(len(ids), bool)
            taught[at] = learned.to_numpy(zero_copy_only=False)
            known, word = known.to_numpy(), word.to_numpy()
            after = prev.is_valid().to_numpy(zero_copy_only=False)
            plain = model.plain(known, spelled.to_numpy().astype(np.float64))
            before = prev.fill_null(0).to_numpy()
            for row in packed(model, before[after], word[after], plain[after], at[after], ids, taught, known[after]):
                yield filled(row, 1, schema)
            alone = np.flatnonzero(~after)
            rows = ids[at[alone]]
            yield filled({"__id": rows, "__found": (known[alone] > 0).astype(np.int64), "__base": np.log10((known[alone] + 0.5) / model.scale), "__model": plain[alone], "__part": (rows % model.parts).astype(np.int32)}, len(rows), schema)

    rarer = words.filter(F.col("n") < least).select(F.col("key").alias("__word"), F.col("n").alias("__known"))
    first = table(docs.select(key, text).mapInArrow(lambda batches: scan(batches, True), asked), "suffix-rare")

    def met(rare: DataFrame) -> DataFrame:
        return rare.join(rarer, "__word", "left").select("__id", "__learned", "__prev", "__word", "__spelled", F.coalesce("__known", F.lit(0)).alias("__known")).mapInArrow(counted, schema)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(parts, F.col("__part"))

    rare = first.filter("__word is not null")
    numbers = [int(x) for x in np.flatnonzero(model.n >= model.heavy)]
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of heavy words before, the sums over one part."""
        for c in contexts(sent.value, batches):
            yield pa.RecordBatch.from_arrays([pa.array(c[x]) for x in ("prev", "t", "k", "ratio")], names=["prev", "t", "k", "ratio"])

    after_heavy = met(rare.filter(F.col("__learned") & F.col("__prev").isin(numbers))).filter("__size is not null").select("__part", "__size", "__texts", "__packed")
    heaviest = dealt(first.filter("__size is not null").select(*after_heavy.columns).unionByName(after_heavy)).mapInArrow(sums, "prev long, t double, k double, ratio double").groupBy("prev").agg(*[F.sum(x).alias(x) for x in ("t", "k", "ratio")]).orderBy("prev").toArrow()
    heavy = spark.sparkContext.broadcast([heaviest.column(c).to_numpy() for c in range(4)])
    results = T.StructType(whole.fields + T._parse_datatype_string(SUMS).fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of texts as they are, and those of the words of one part."""
        model, held, found = sent.value, [], []
        for batch in batches:
            sized = column(batch, "__size").is_valid()
            held.append(batch.filter(sized))
            yield batch.filter(pc.invert(sized)).select(results.fieldNames())
        for c in contexts(model, iter(held)):
            at = np.minimum(np.searchsorted(heavy.value[0], c["prev"]), max(0, len(heavy.value[0]) - 1))
            spread = heavy.value[0][at] == c["prev"] if len(heavy.value[0]) else np.zeros(len(at), bool)
            t, k, ratio = (np.where(spread, h[at], c[x]) if len(h) else c[x] for x, h in zip(("t", "k", "ratio"), heavy.value[1:], strict=True))
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.log(t)
                retained = (t >= 2) & (ratio - t * log > 0.5 * k * log)
                t, k, retained, plain = t[c["of"]], k[c["of"]], retained[c["of"]], c["plain"]
                inside = np.where(c["n"] > 0, np.log10((c["n"] * model.share + k * 10.0**plain) / (t + k)), plain + np.log10(k / (t + k)))
            told = c["known"] >= 0
            ids, of = np.unique(c["id"], return_inverse=True)
            add = lambda x, of=of, m=len(ids), times=c["times"]: np.bincount(of, weights=times * x, minlength=m)
            found.append((ids, add(np.where(retained, inside, plain)), add(np.where(told, np.log10((np.maximum(c["known"], 0) + 0.5) / model.scale), 0.0)), add(c["known"] > 0)))
        if not found:
            return
        ids, of = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        out = [np.bincount(of, weights=np.concatenate([x[c] for x in found])) for c in (1, 2, 3)]
        for a in range(0, len(ids), 100_000):
            z = slice(a, a + 100_000)
            yield filled({"__id": ids[z], "__model": out[0][z], "__base": out[1][z], "__found": out[2][z].astype(np.int64)}, len(ids[z]), results)

    alike = F.count("__tokens")
    return (
        dealt(docs.select(key, text).mapInArrow(lambda batches: scan(batches, False), schema).unionByName(met(rare)))
        .mapInArrow(score, results)
        .groupBy("__id")
        .agg(
            F.first(key, ignorenulls=True).alias(key), F.max("held_out").alias("held_out"), F.max("__tokens").alias("n_tokens"), alike.alias("__alike"),
            (F.sum("__found") / alike).cast("long").alias("n_known"), (F.sum("__base") / alike).alias("base_score"), (F.sum("__model") / alike).alias("score"),
        )
        .select("*", F.explode(F.sequence(F.lit(1), F.col("__alike").cast("int"))).alias("__row"))
        .select(key, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    )


def spellings(tree: Tree, texts: list[bytes], asked: np.ndarray) -> np.ndarray:
    """log10 that the tree spells each `asked` word of the texts so, given the bytes before it; of others 0."""
    out = np.zeros(len(asked))
    if not asked.any():
        return out
    data, real = byte_stream(texts, tree.depth)
    body, inside = data[tree.depth :], real[tree.depth :]
    begins = np.flatnonzero(inside & ((data[tree.depth - 1 : -1] == SPACE) | ~real[tree.depth - 1 : -1]) if tree.depth else inside)
    ends = np.flatnonzero(body == SPACE) + 1
    if 3 * np.count_nonzero(asked) < len(asked):
        lengths = (ends - begins)[asked] + tree.depth
        stops = np.cumsum(lengths)
        starts = stops - lengths
        data = data[np.arange(stops[-1]) + np.repeat(begins[asked] - starts, lengths)]
        logp = tree.score(data)
        out[asked] = np.add.reduceat(np.append(logp, np.float32(0)).astype(np.float64), np.stack([starts, stops - tree.depth], 1).ravel())[::2]
        return out
    logp = np.append(np.where(inside, tree.score(data), np.float32(0)).astype(np.float64), 0.0)
    return np.where(asked, np.add.reduceat(logp, np.stack([begins, ends], 1).ravel())[::2], 0.0)


def filled(found: dict[str, object], rows: int, schema: T.StructType) -> pa.RecordBatch:
    """A batch of `schema`; columns that are not found are null."""
    kinds = to_arrow_schema(schema)
    columns = [found[f.name] if f.name in found else pa.nulls(rows, f.type) for f in kinds]
    return pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds)
