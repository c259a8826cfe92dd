"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.words import mix
from sievework.llm.work import column

#: A k-mer is this many code points; it is chosen by its substrings of INNER code points.
K, INNER = 16, 6
#: Anchors that a fingerprint keeps, those of the least hashes, with their places: one of DENSITY, but at least KEPT.
KEPT, DENSITY = 64, 64
#: Anchors of a matching pair may be shifted against the others by this share of the text.
SHIFT = 0.1


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of a sequence of code points.

    A k-mer is one if the least hash of its INNER-mers is at its first or last
    place. Whether it is depends on its own code points only, so an edit
    changes no anchor that it does not touch. A sequence too short to have one
    has all its INNER-mers as anchors, or itself; an empty one has none.
    """
    n = len(points)
    if n < INNER:
        return _whole(points), np.zeros(min(n, 1), np.int64)
    power = np.uint64(0x9E3779B97F4A7C15)
    inner = np.zeros(n - INNER + 1, np.uint64)
    wide = points.astype(np.uint64)
    for j in range(INNER):
        inner = inner * power + wide[j : n - INNER + 1 + j]
    inner = mix(inner)
    if n < K:
        return inner, np.arange(len(inner))
    least = inner
    span = 1
    window = K - INNER + 1
    while span < window:  # the least of windows, by doubling
        step = min(span, window - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    places = np.flatnonzero((inner[: n - K + 1] == least) | (inner[K - INNER :] == least))
    if not len(places):
        return inner, np.arange(len(inner))
    first, middle, last = inner[places], inner[places + (K - INNER) // 2], inner[places + K - INNER]
    return mix(first * power ^ mix(middle + power) + last), places


def _whole(points: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(points.tobytes()).digest()[:8], np.uint64) if len(points) else np.empty(0, np.uint64)


class Fingerprint:
    """The anchors of least hashes, distinct, each at its first place; more of a longer text, one of DENSITY."""

    def __init__(self, points: np.ndarray):
        hashes, places = anchors(points)
        self.hashes, first = np.unique(hashes, return_index=True)
        kept = max(KEPT, -(-len(self.hashes) // DENSITY))
        self.hashes, self.places = self.hashes[:kept], places[first[:kept]]
        self.length = len(points)

    def text(self) -> str:
        """Each anchor as 8 hexadecimal digits of its place and 16 of its hash, by hash."""
        out = np.empty((len(self.hashes), 12), np.uint8)
        out[:, :4] = self.places.astype(">u4").view(np.uint8).reshape(-1, 4)
        out[:, 4:] = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        return out.tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """The share of the union's least anchors that both have, at matching places.

        As many of the union count as the smaller fingerprint has, KEPT at least:
        of these both fingerprints tell whether their text has them. Anchors
        match if their places are apart by about what the others' are: by the
        median shift, give or take SHIFT of the longer text. Two texts without
        anchors are alike, and one is not like another with some.
        """
        if not len(self.hashes) or not len(other.hashes):
            return float(len(self.hashes) == len(other.hashes))
        union = np.union1d(self.hashes, other.hashes)[: max(KEPT, min(len(self.hashes), len(other.hashes)))]
        shared, mine, theirs = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        shared = shared <= union[-1]
        if not shared.any():
            return 0.0
        shift = self.places[mine][shared] - other.places[theirs][shared]
        fits = np.abs(shift - np.median(shift)) <= SHIFT * max(self.length, other.length) + K
        return float(fits.sum() / len(union))


def splitters(docs: DataFrame, key: str, per: int) -> list[int]:
    """Keys that cut the table into ranges of about `per` rows; at most 16,384 of them, or four for each shuffle partition.

    Ranges only deal rows to tasks, which sort them on disk where they are large.
    """
    rows = docs.count()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = int(min(max(16_384, 4 * parts), rows // per))
    if many < 1:
        return []
    # The quantiles are doubles; a rounded splitter is still a splitter, as long as all rows see the same one.
    cuts = docs.select(F.col(key).alias("k")).filter("k is not null").approxQuantile("k", [i / (many + 1) for i in range(1, many + 1)], 1 / (4 * (many + 1)))
    return sorted({max(-(2**63), min(2**63 - 1, int(x))) for x in cuts})


def with_next(docs: DataFrame, key: str, text: str, per: int = 1000) -> tuple[DataFrame, list]:
    """The rows dealt into ranges of the key, each with the first row of the range after it.

    Columns: the key, text, range (__fp_range) and last (__fp_last: the row is
    there only as the one after the range's last). Only splitters and the first
    key of each range come to the driver, as many as splitters() says. Null keys
    are in a range of their own, the first. Nulls never reach the Python
    functions, where they would turn 64-bit keys into doubles.
    """
    cuts = np.array(splitters(docs, key, per), dtype=np.int64)
    number, there = F.coalesce(F.col(key).cast("long"), F.lit(0)), F.col(key).isNotNull()

    @F.pandas_udf("int")
    def placed(keys):
        import pandas as pd

        return pd.Series((np.searchsorted(cuts, keys.to_numpy(dtype=np.int64), side="right") + 1).astype(np.int32))

    keyed = docs.select(key, text).withColumn("__fp_range", F.when(there, placed(number) if len(cuts) else F.lit(1)).otherwise(0))
    firsts = keyed.groupBy("__fp_range").agg(F.min(key).alias("k")).orderBy("__fp_range").collect()
    order = [(r["__fp_range"], r["k"]) for r in firsts]
    before = {k: order[i - 1][0] for i, (_, k) in enumerate(order)}
    known = np.array(sorted(k for k in before if k is not None), dtype=np.int64)
    ranges = np.array([before[k] for k in known.tolist()], dtype=np.int32)

    @F.pandas_udf("int")
    def follows(keys):
        import pandas as pd

        keys = keys.to_numpy(dtype=np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return pd.Series(np.where(known[at] == keys, ranges[at], -1).astype(np.int32))

    follow = F.when(there, follows(number) if len(known) else F.lit(-1)).otherwise(before.get(None, -1))
    dealt = F.array(F.struct(F.col("__fp_range").alias("r"), F.lit(False).alias("last")), F.struct(F.col("__fp_before").alias("r"), F.lit(True).alias("last")))
    return keyed.withColumn("__fp_before", follow).withColumn("__fp", F.explode(F.filter(dealt, lambda x: x["r"] >= 0))).select(key, text, F.col("__fp.r").alias("__fp_range"), F.col("__fp.last").alias("__fp_last")), order


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, its edited text's, and how alike they and the next row's are.

    The edited text has, in place of the last floor(n / 4) of n code points, the
    first as many (or all) of the next text by ascending key; after the last
    comes the first. Rows are dealt by ranges of the key, which must be of an
    integer type (TypeError otherwise), and read in order, so each task holds two
    texts at a time. Rows with the same key are ordered by their text; null keys
    come first; a null text is empty; a single row follows itself.

    A fingerprint keeps at least KEPT anchors and one of DENSITY beyond, so it
    grows with its text; a likeness errs by about 1 / (2 * sqrt(KEPT)).

    Columns: the key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be of an integer type, not {docs.schema[key].dataType.simpleString()}")
    dealt, _ = with_next(docs, key, text)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = dealt.repartition(parts, "__fp_range").sortWithinPartitions(F.col("__fp_range"), F.col("__fp_last"), F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first())
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key, code points, fingerprint, range
        closed = -1  # the range whose following row has been seen
        for batch in batches:
            out: list[tuple] = []
            kind = column(batch, key).type
            for k, t, where, last in zip(*[column(batch, c).to_pylist() for c in (key, text, "__fp_range", "__fp_last")], strict=True):
                if last and closed == where:
                    continue
                points = np.frombuffer((t or "").encode("utf-32-le"), np.uint32)
                mine = Fingerprint(points)
                if held is not None and held[3] == where:
                    out.append(_row(held, points, mine))
                held = None if last else (k, points, mine, where)
                closed = where if last else -1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), *[pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], 1)]], names=schema.fieldNames())

    return met.mapInArrow(run, schema)


def _row(held: tuple, after: np.ndarray, after_print: Fingerprint) -> tuple:
    k, points, mine, _ = held
    cut = len(points) // 4
    edited = np.concatenate([points[: len(points) - cut], after[:cut]])
    changed = Fingerprint(edited)
    return k, len(points), hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest(), mine.text(), changed.text(), mine.likeness(changed), mine.likeness(after_print)
