"""Vector code compression: a codebook per part position, searched by vantage-point trees in whole numbers.

A vector's components become integers and are cut into equal parts. A part's
code is the nearest of its position's entries. Entries are found by a tree over
them: a vantage entry, and the others in a nearer and a farther half, each with
the least and greatest distance from the vantage. By the triangle inequality a
half is left out only if its bound exceeds the best distance; bounds are rounded
outwards and the comparison isn't strict, so neither rounding nor a tie can hide
an entry. What decides is the squared distance in integers.

Defined results:
- vectors that are null, or hold null, NaN or infinite components, are dropped;
- vectors of unlike lengths, or of lengths that parts don't divide, count as filled up with zeros to the least multiple
  of the parts that holds the longest (an empty vector is all zeros);
- the starting entries are the vectors of the least keys, nulls last, of equal keys the lesser vector first; fewer
  vectors than entries leave fewer entries, no vectors an empty result;
- components of any finite size are exact; an error beyond a long is null, as is a label's sum of such or beyond it;
- repeated rows are rows of their own, equal distances go to the lower index, null labels are one label;
- columns besides key, vector and label are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.work import column, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries that are measured at once instead of being cut further.
LEAF = 4
#: Rows measured at once.
BLOCK = 8192
#: Distances are rounded outwards by this share, far more than square roots and conversions can err.
SLACK = 2.0**-50
#: Totals of labels up to this many rows (some MB) are sent to every task; more are joined by salted keys.
BROADCAST_ROWS, SALTS = 50_000, 32
#: Bits of one limb of a sum.
LIMB = 32


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exact."""
    diff = a - b
    return (diff * diff).sum(axis=-1) if diff.dtype == object else np.einsum("...k,...k->...", diff, diff)


class VantageTree:
    """The nearest of some entries to each of many parts; entries and parts are rows of integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(list(range(len(entries))))

    def _node(self, members: list[int]) -> tuple:
        if len(members) <= LEAF:
            return (np.array(sorted(members)), ())
        vantage, *rest = members
        away = sorted((int(_squares(self.entries[m], self.entries[vantage])), m) for m in rest)
        halves = (away[: len(away) // 2], away[len(away) // 2 :])
        # A distance beyond a double has no bound; its half is always searched.
        bounds = [[math.sqrt(d) if d < 1 << 1000 else math.inf for d in (half[0][0], half[-1][0])] for half in halves]
        return (np.array([vantage]), tuple((0.0 if low == math.inf else low * (1 - SLACK), high * (1 + SLACK), self._node([m for _, m in half])) for (low, high), half in zip(bounds, halves)))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry, of equal ones the lower index."""
        wide = parts.dtype == object or self.entries.dtype == object
        best = np.full(len(parts), 1 << 4096, dtype=object) if wide else np.full(len(parts), np.iinfo(np.int64).max)
        at = np.full(len(parts), len(self.entries))
        self._visit(self.root, parts, np.arange(len(parts)), best, at)
        return at, best

    def _visit(self, node: tuple, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        members, halves = node
        found = _squares(parts[rows][:, None, :], self.entries[members][None])
        column_ = found.argmin(axis=1)  # the first of equal ones, and members ascend
        least, index = found[np.arange(len(rows)), column_], members[column_]
        better = ((least < best[rows]) | ((least == best[rows]) & (index < at[rows]))).astype(bool)
        best[rows[better]], at[rows[better]] = least[better], index[better]
        if not halves:
            return
        if best.dtype == object:  # no bounds in doubles: both halves are searched
            for *_, child in halves:
                self._visit(child, parts, rows, best, at)
            return
        away = np.sqrt(least.astype(np.float64))
        nearer = away <= halves[0][1]
        for first in (True, False):  # each part's own half, then the other, if that can still hold a nearer or equal entry
            for k, (low, high, child) in enumerate(halves):
                bound = np.maximum(away * (1 - SLACK) - high, low - away * (1 + SLACK)) * (1 - SLACK)
                limit = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
                take = rows[((nearer == (k == 0)) == first) & (bound <= limit)]
                if len(take):
                    self._visit(child, parts, take, best, at)


def _bits(width: int) -> int:
    """Components below 2 ** this have squared distances below 2 ** 62."""
    return (61 - max(1, width).bit_length()) // 2 - 1


def _scaled(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) > 2.0**52 else math.floor(x * scale)


def integers(vectors: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, filled up with zeros to `width`; an array of Python integers if they are large."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and float(np.abs(flat).max()) * scale >= 2.0 ** _bits(width):
        whole = np.array([_scaled(x, scale) for x in flat.tolist()], dtype=object)
    else:
        whole = np.floor(flat * scale).astype(np.int64)
    if (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), whole.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def _trees(codebooks: list[list[list[int]]], width: int) -> list[VantageTree]:
    """A tree for each part position."""
    small = all(abs(x) < 1 << _bits(width) for book in codebooks for entry in book for x in entry)
    return [VantageTree(np.array(book, dtype=np.int64 if small else object).reshape(len(book), -1)) for book in codebooks]


def _searched(batches: Iterable[pa.RecordBatch], trees: list[VantageTree], vector: str, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows with their parts, indexes and squared distances, as (row, part, ...)."""
    for whole in batches:
        for first in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(first, BLOCK)
            parts = integers(column(batch, vector), width, scale).reshape(batch.num_rows, len(trees), -1)
            found = [tree.nearest(parts[:, m]) for m, tree in enumerate(trees)]
            yield batch, parts, np.stack([x for x, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """A whole number as limbs of LIMB bits, the last one signed; their sums over many numbers fit into longs."""
    k = 0
    while not -(1 << LIMB) <= x < 1 << LIMB:
        yield k, x & ((1 << LIMB) - 1)
        x, k = x >> LIMB, k + 1
    yield k, x


def _sums(kept: DataFrame, codebooks: list[list[list[int]]], vector: str, width: int, scale: int) -> dict[tuple[int, int], list[int]]:
    """Of each used entry (part, index): the number of its parts, and the sums of their components.

    A task sends one row a used entry and component, summed by Spark; the result has no more rows than the codebooks have numbers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(codebooks, width)
        step = width // len(trees)
        narrow = np.zeros((len(trees), len(codebooks[0]), step + 1), np.int64)  # below 2 ** 28 each: room for 2 ** 35 rows a task
        broad: np.ndarray | None = None
        for _, parts, at, _ in _searched(batches, trees, vector, width, scale):
            if parts.dtype == object and broad is None:
                broad = np.zeros(narrow.shape, dtype=object)
            into = broad if parts.dtype == object else narrow
            for m in range(len(trees)):
                np.add.at(into[m, :, 0], at[:, m], 1)
                if parts.dtype == object:
                    np.add.at(into[m, :, 1:], at[:, m], parts[:, m])
                else:
                    order = np.argsort(at[:, m], kind="stable")
                    used, begins = np.unique(at[order, m], return_index=True)
                    into[m, used, 1:] += np.add.reduceat(parts[order, m], begins, axis=0)
        total = narrow if broad is None else narrow + broad
        rows = [(m, k, i, limb, value) for m in range(total.shape[0]) for k in range(total.shape[1]) if total[m, k, 0] for i in range(step + 1) for limb, value in _limbs(int(total[m, k, i]))]
        names = ["part", "entry", "place", "limb", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64() if j == 4 else pa.int32()) for j in range(5)], names)

    sums = kept.select(vector).mapInArrow(run, "part int, entry int, place int, limb int, value long").groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    out: dict[tuple[int, int], list[int]] = {}
    for r in sums.collect():
        out.setdefault((r["part"], r["entry"]), [0] * (width // len(codebooks) + 1))[r["place"]] += r["value"] << (LIMB * r["limb"])
    return out


def fitted(kept: DataFrame, key: str, vector: str, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[list[list[int]]]:
    """The codebooks after all rounds, as lists by part, entry and component."""
    first = kept.select(key, vector).orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).collect()
    whole = integers(pa.array([list(r[1]) for r in first], pa.list_(pa.float64())), width, scale).reshape(len(first), parts, -1)
    books = [[[int(x) for x in v[m]] for v in whole] for m in range(parts)]
    for _ in range(rounds):
        for (m, k), (n, *total) in _sums(kept, books, vector, width, scale).items():
            books[m][k] = [x // n for x in total]
    return books


def digest(codebooks: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of each usable vector.

    `vectors` is read once for its width, once for the first entries, and once a round and for the codes: give a stored
    table. Nothing but sums meets in the driver, as many numbers as the codebooks have.
    """
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    kept = vectors.filter(usable).select(F.col(key), x, F.col(label))
    widest = kept.agg(F.max(F.size(vector))).first()[0]
    schema = T.StructType([kept.schema[key], kept.schema[label], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if widest is None:
        return kept.select(key, label, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = -(-widest // parts) * parts
    books = fitted(kept, key, vector, width, parts, entries, rounds, scale)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books, width)
        digits = np.array([f"{i:02x}" for i in range(len(books[0]))])
        for batch, _, at, squares in _searched(batches, trees, vector, width, scale):
            codes = ["".join(r) for r in digits[at].tolist()]
            errors = [int(e) if e < 1 << 63 else None for e in squares.astype(object).sum(axis=1)] if squares.dtype == object else squares.sum(axis=1)
            yield pa.RecordBatch.from_arrays([column(batch, key), column(batch, label), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[key, label, "code", "error"])

    coded = table(kept.mapInArrow(run, schema), "vector-codes")
    whole = F.when(F.count("*") == F.count("error"), F.try_sum("error"))  # null if any of them is
    totals = table(coded.groupBy(F.col(label).alias("__label")).agg(whole.alias("label_error")), "label-errors")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    if totals.count() <= BROADCAST_ROWS:
        met = coded.join(F.broadcast(totals), same(label, "__label"), "left")
    else:
        salted = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = coded.withColumn("__of", F.pmod(F.xxhash64(key, "code"), F.lit(SALTS)).cast("int")).join(salted, same(label, "__label") & (F.col("__of") == F.col("__salt")), "left")
    return met.select(key, label, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
